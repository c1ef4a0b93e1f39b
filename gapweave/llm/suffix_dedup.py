"""Repeated substrings by a Burrows-Wheeler transform, removed byte by byte.

A byte goes if a string of L bytes that covers it also starts anywhere else. Whether
it does is decided on the Burrows-Wheeler transform of collections of text stretches:
intervals of suffixes with a common prefix are extended backwards, breadth first, so
that common-prefix lengths come up in increasing order, and the search stops at L. What
is then still one interval shares L bytes (after Beller, Gog, Ohlebusch and Schnattinger,
"Computing the longest common prefix array based on the Burrows-Wheeler transform").

Collections are made so that no repeat is lost and none spans two of them. Each string of
L bytes has a canonical anchor: of the k-byte strings inside, the one of least hash, the
first on a tie. Equal strings have equal anchors at equal places. The starts of a text fall
into runs of equal anchor; a run's stretch (its starts and L - 1 bytes more) goes to the
collection of its anchor's hash. Equal stretches are folded with their number before
they are shuffled, so copies of any number cost one stretch.

A collection that one transform would not hold (an anchor in boilerplate) is parted: its
members share the bytes of the anchor, and each string of L bytes that covers them holds
half of the L - k others on the left or on the right of it. Starts part by that side and by
those bytes; equal strings stay together, the shared part doubles, parts that have become
equal are folded again, and after some rounds (log2 L at most) every part fits or is one string.

Passages go the same way in words: what 50 words in a row of one row another row holds too,
whatever white space parts them and however few bytes they have, is counted beside the bytes.
There a stretch has words for bytes, and a word is a symbol of the transform, or several where a
collection has many words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import tune, written
from .textcore import blobs, inverse_powers, mixed, prefix_hash, range_hash, word_bounds

#: bytes of texts hashed at a time; their arrays stay in a cache
CHUNK_BYTES = 1 << 16


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w entries in a row."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


#: low bits of a hash that give way to a position when least hashes are sought
PLACE_BITS = 25


def _anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least of each w hashes in a row, the first on a tie; a block of positions at a time."""
    most = 1 << PLACE_BITS
    if w > most // 2:
        raise ValueError(f"windows of {w} hashes do not fit {PLACE_BITS} bits of position")
    place = np.uint64(most - 1)
    out = []
    for s in range(0, len(h) - w + 1, most - w + 1):  # a block's last window ends at its last position
        x = h[s : s + most]
        out.append((_sliding_least((x & ~place) | np.arange(len(x), dtype=np.uint64), w) & place).astype(np.int64) + s)
    return np.concatenate(out)


def _runs(p: np.ndarray, begins: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """stretches() of entries with the prefix hashes p, in texts that begin at begins."""
    n = len(p) - 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    if n < length:
        return none
    h = mixed((p[k:] - p[: n - k + 1]) * inverse_powers(n - k + 1))  # range_hash of each k entries
    least = _anchors(h, length - k + 1)
    starts = np.arange(len(least))
    of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[: len(least)]
    good = starts + length <= begins[of + 1]
    starts, of, least = starts[good], of[good], least[good]
    if not len(starts):
        return none
    first = np.flatnonzero(np.diff(least, prepend=-1) | np.diff(of, prepend=-1))
    return of[first], starts[first] - begins[of[first]], np.diff(first, append=len(starts)), h[least[first]], least[first] - starts[first]


def stretches(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of each run of starts of equal anchor: text, first start, number of starts, anchor hash, the anchor's place after the first start."""
    return _runs(prefix_hash(np.frombuffer(b"".join(texts), np.uint8)), np.cumsum([0, *map(len, texts)]), length, k)


def word_stretches(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    """stretches() in words; then a hash of each stretch's words, and its first byte and the one after its last."""
    data, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, end = word_bounds(data, begins)
    p = prefix_hash(range_hash(prefix_hash(data), start, end, inverse_powers(len(data) + 1)))
    own = np.searchsorted(start, begins)
    of, s0, n, h, a = _runs(p, own, length, k)
    first = own[of] + s0
    last = first + n + length - 1
    r = range_hash(p, first, last, inverse_powers(len(p)))
    return of, s0, n, h, a, r, start[first] - begins[of], end[last - 1] - begins[of]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK_BYTES:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


#: entries of one transform at most: rank, later rank and position share a sort key of 63 bits
MOST_ENTRIES = 1 << 21
#: entries from which one collection is parted, and of several collections in one transform
FULL = 1 << 20
HELD = 1 << 19


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first depth entries, then of position, by prefix doubling.

    data: integers from 0 to 511, the last a unique least one; what lies beyond the end is least.
    """
    n = len(data)
    assert n <= MOST_ENTRIES
    bits, place = np.uint64(21), np.uint64(MOST_ENTRIES - 1)
    at = np.arange(n, dtype=np.uint64)
    key, known = np.zeros(n, np.uint64), 4
    for i in range(known):  # 9 bits an entry
        key <<= np.uint64(9)
        if i < n:
            key[: n - i] |= data[i:].astype(np.uint64)
    while True:
        key = (key << bits) | at
        key.sort()
        order = (key & place).astype(np.int64)
        key >>= bits
        rank = np.zeros(n, np.uint64)
        rank[order[1:]] = np.cumsum(key[1:] != key[:-1], dtype=np.uint64)
        if known >= depth or rank[order[-1]] == n - 1:
            return order
        step = min(known, depth - known)
        key = rank << bits
        if step < n:
            key[: n - step] |= rank[step:]
        known += step


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and of which range each is."""
    size = ends - starts
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + starts[of], of


def common_prefix_groups(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, group): suffixes with the same first `length` entries have equal groups.

    Breadth-first backward extension: `edge` marks the ranks whose suffix has fewer than
    the present number of entries in common with the one before. A new edge parts an
    interval; a character whose neighbouring occurrences lie in different parts of it has
    its own interval, one entry longer, parted where it maps to. Only the parts beside the
    largest are read, so a rank is read as often as its interval halves at most.
    """
    n = len(data)
    order = suffix_order(data, length + 1)
    bwt = data[order - 1]
    by = np.argsort(bwt, kind="stable")  # rank at place p of the first column
    lf = np.empty(n, np.int32)
    lf[by] = np.arange(n, dtype=np.int32)
    same = bwt[by[1:]] == bwt[by[:-1]]
    # the search starts with the intervals of all strings of q entries
    q = min(7, length)
    gram = np.zeros(n, np.uint64)
    for i in range(q):
        gram <<= np.uint64(9)
        if i < n:
            gram[: n - i] |= data[i:].astype(np.uint64)
    gram = gram[order]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    edge[1:n] = gram[1:] != gram[:-1]
    new = np.flatnonzero(edge[1:n] & (gram[1:] >> np.uint64(9) == gram[:-1] >> np.uint64(9))) + 1
    edge[new] = False
    old, late = np.flatnonzero(edge), np.zeros(0, np.int64)  # all edges, the latest apart
    for _ in range(q, length):
        if not len(new):
            break
        # the old interval of each new edge, then the parts that the new edges make of it
        if len(late) > 20_000:
            old, late = np.flatnonzero(edge), late[:0]
        home = np.searchsorted(old, new)
        lo, hi = old[home - 1], old[home]
        if len(late):
            home = np.searchsorted(late, new)
            lo = np.maximum(lo, np.where(home > 0, late[home - 1], 0))
            hi = np.minimum(hi, np.where(home < len(late), late[np.minimum(home, len(late) - 1)], n))
        home = lo
        first = np.flatnonzero(np.diff(home, prepend=-1))
        part_lo = np.concatenate([lo[first], new])
        part_hi_own = np.append(new[1:], 0)
        part_hi_own[np.append(first[1:] - 1, len(new) - 1)] = hi[np.append(first[1:] - 1, len(new) - 1)]
        part_hi = np.concatenate([new[first], part_hi_own])
        whole_lo, whole_hi = np.concatenate([lo[first], lo]), np.concatenate([hi[first], hi])
        group = np.concatenate([np.arange(len(first)), np.repeat(np.arange(len(first)), np.diff(first, append=len(new)))])
        size = part_hi - part_lo
        by_size = (group.astype(np.uint64) << np.uint64(43)) | ((n - size).astype(np.uint64) << np.uint64(22)) | np.arange(len(size), dtype=np.uint64)
        by_size.sort()
        largest = (by_size & np.uint64((1 << 22) - 1)).astype(np.int64)
        largest = largest[np.flatnonzero(np.diff(by_size >> np.uint64(43), prepend=np.uint64(2**21)))]
        keep = np.ones(len(size), bool)
        keep[largest] = False
        edge[new] = True
        late = np.sort(np.concatenate([late, new]))
        p_lo, p_hi, w_lo, w_hi, many = part_lo[keep], part_hi[keep], whole_lo[keep], whole_hi[keep], size[keep]
        rank = np.arange(many.sum()) + np.repeat(p_lo - np.cumsum(many) + many, many)
        b, a = before[rank], after[rank]
        hits = [lf[rank[(b >= np.repeat(w_lo, many)) & (b < np.repeat(p_lo, many))]], lf[a[(a < np.repeat(w_hi, many)) & (a >= np.repeat(p_hi, many))]]]
        new = np.concatenate(hits)
        new = np.sort(new[~edge[new]])
        new = new[np.flatnonzero(np.diff(new, prepend=-1))]
    edge[new] = True
    return order, np.cumsum(edge[:n])


def repeated_starts(regions: list[bytes], starts: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Flags, for the first starts[i] offsets of each region, of those whose `length` bytes begin elsewhere too.

    weights: how often each region stands in the corpus.
    """
    size = np.array([len(r) + 1 for r in regions])
    begin = np.cumsum(size) - size
    data = np.ones(int(size.sum()) + 1, np.int16)
    body = np.frombuffer(b"\0".join(regions), np.uint8)
    data[: len(body)] = body.astype(np.int16) + 2
    data[begin[1:] - 1] = 1  # between regions
    data[-2:] = 1, 0
    order, group = common_prefix_groups(data, length)
    at, of = _spread(begin, begin + starts)
    weight = np.zeros(len(data), np.int64)
    weight[at] = weights[of]
    total = np.bincount(group, weight[order])
    rank_group = np.empty(len(data), np.int64)
    rank_group[order] = group
    return total[rank_group[at]] > 1.5


#: words that one symbol of a transform tells apart
SYMBOLS = 510


def shared_starts(regions: list[list[bytes]], collection: np.ndarray, starts: np.ndarray, least: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
    """Flags, for the first starts[i] words of each region, of those whose `length` words begin in another row of the collection too.

    collection: a number of each region, ascending; words have numbers of their own in each.
    least, most: of the numbers of the rows that hold each region.
    """
    codes: list[int] = []
    now, number, numbers = None, {}, 1
    for c, region in zip(collection.tolist(), regions):
        if c != now:
            now, number = c, {}
        codes.extend([number.setdefault(w, len(number)) for w in region])
        numbers = max(numbers, len(number))
    width = next(i for i in range(1, 8) if SYMBOLS**i >= numbers)  # symbols of a word
    size = np.array([width * len(r) + 1 for r in regions])
    begin = np.cumsum(size) - size
    data = np.ones(int(size.sum()) + 1, np.int16)  # 1 between regions
    data[_spread(begin, begin + size - 1)[0]] = (np.array(codes, np.int64)[:, None] // SYMBOLS ** np.arange(width) % SYMBOLS + 2).ravel()
    data[-1] = 0
    order, group = common_prefix_groups(data, length * width)
    place, of = _spread(np.zeros(len(starts), np.int64), starts)
    of_rank = np.empty(len(data), np.int64)
    of_rank[order] = group
    # the same symbols in two collections are not the same words
    group = of_rank[begin[of] + width * place]
    by = np.lexsort((group, collection[of]))
    edge = np.flatnonzero((np.diff(group[by], prepend=-1) != 0) | (np.diff(collection[of][by], prepend=-1) != 0))
    several = np.minimum.reduceat(least[of][by], edge) < np.maximum.reduceat(most[of][by], edge)
    flag = np.empty(len(by), bool)
    flag[by] = np.repeat(several, np.diff(edge, append=len(by)))
    return flag


def _anchored(docs: DataFrame, length: int, k: int, passage: int, passage_k: int) -> DataFrame:
    """(doc_id, th, row, n_bytes, whole, runs, passages) of rows (doc_id, th, row, text): stretches (h, r, s0, n, a, at, len) in bytes and in words, with a digest r and the bytes of each; h is even for bytes, odd for words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = {"h": pa.int64(), "r": pa.int64(), "s0": pa.int32(), "n": pa.int32(), "a": pa.int32(), "at": pa.int32(), "len": pa.int32()}

    def listed(words: int, texts: int, of: np.ndarray, h: np.ndarray, *more: np.ndarray) -> pa.ListArray:
        cut = np.searchsorted(of, np.arange(texts + 1)).astype(np.int32)
        columns = [h & np.uint64(2**64 - 2) | np.uint64(words), *more]
        arrays = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(t) for c, t in zip(columns, names.values())]
        return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(arrays, names=list(names)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = blobs(b.column(3))
            runs, passages = [], []
            for s, e in _pieces(texts):
                of, s0, n, h, a = stretches(texts[s:e], length, k)
                r = np.frombuffer(b"".join([hashlib.blake2b(texts[s + d][x : x + y + length - 1], digest_size=8).digest() for d, x, y in zip(of.tolist(), s0.tolist(), n.tolist())]), "<i8")
                runs.append((of + s, h, r, s0, n, a, s0, n + length - 1))
                of, s0, n, h, a, r, lo, hi = word_stretches(texts[s:e], passage, passage_k)
                passages.append((of + s, h, r, s0, n, a, lo, hi - lo))
            if texts:
                lists = [listed(w, len(texts), *map(np.concatenate, zip(*found))) for w, found in enumerate((runs, passages))]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(3)), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), *lists],
                    names=["doc_id", "th", "row", "n_bytes", "whole", "runs", "passages"],
                )

    run = "array<struct<h: long, r: long, s0: int, n: int, a: int, at: int, len: int>>"
    return docs.select("doc_id", "th", "row", "text").mapInArrow(work, f"doc_id {kind}, th long, row long, n_bytes long, whole string, runs {run}, passages {run}")


def _decided(regions: DataFrame, length: int, passage: int, full: int) -> DataFrame:
    """(words, h, r, flags of runs (lo, hi)) of regions (words, h, r, w, d0, d1, n, bytes), whole collections in a task, several to a transform."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> pa.RecordBatch:
            words, h, r, w, d0, d1, n, data = zip(*held)
            n = np.array(n, np.int64)
            if words[0]:
                collection = np.cumsum(np.diff(np.array(h, np.int64), prepend=h[0]) != 0)
                flag = shared_starts(list(data), collection, n, np.array(d0, np.int64), np.array(d1, np.int64), passage)
            else:
                flag = repeated_starts(list(data), n, np.array(w, np.int64), length)
            cut = np.concatenate([[0], np.cumsum(n)])
            mark = np.zeros(len(flag) + 1, bool)
            mark[:-1] = flag
            before = np.concatenate([[False], mark[:-1]])
            first = np.zeros(len(mark), bool)
            first[cut] = True
            begin = np.flatnonzero(mark & (~before | first))
            end = np.flatnonzero(before & (~mark | first))
            own = np.searchsorted(begin, cut).astype(np.int32)
            shift = cut[np.searchsorted(cut, begin, side="right") - 1]
            runs = pa.StructArray.from_arrays([pa.array((begin - shift).astype(np.int32)), pa.array((end - shift).astype(np.int32))], names=["lo", "hi"])
            return pa.RecordBatch.from_arrays([pa.array(words), pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.ListArray.from_arrays(pa.array(own), runs)], names=["words", "h", "r", "runs"])

        def collections() -> Iterator[tuple[list[tuple], int, int]]:
            """Regions of each collection, symbols of each entry, entries in a transform."""
            rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
            for (words, _), group in groupby(rows, key=lambda row: row[:2]):
                group, symbols = list(group), 1
                if words:
                    group = [(*row[:-1], row[-1].split()) for row in group]
                    symbols = 1 if len({w for row in group for w in row[-1]}) <= SYMBOLS else 2
                yield group, symbols, sum(len(row[-1]) * symbols + 1 for row in group)

        held: list[tuple] = []
        total, kind = 0, None
        for group, symbols, size in collections():
            if held and (total + size > full or kind != (group[0][0], symbols)):
                yield solve(held)
                held, total = [], 0
            held.extend(group)
            total, kind = total + size, (group[0][0], symbols)
        if held:
            yield solve(held)

    return regions.select("words", "h", "r", "w", "d0", "d1", "n", "bytes").mapInArrow(work, "words boolean, h long, r long, runs array<struct<lo: int, hi: int>>")


def _entries(length: int, symbols: int = 1) -> F.Column:
    """Entries of a collection (group of regions) in a transform: symbols and a separator each."""
    return F.sum((F.col("n") + length).cast("long") * symbols)


def _bytes_from(off: F.Column, n: F.Column) -> F.Column:
    return F.substring("bytes", off + 1, n)


def _words_from(off: F.Column, n: F.Column) -> F.Column:
    return F.encode(F.array_join(F.slice(F.split(F.decode("bytes", "UTF-8"), "[ \\t-\\r]+"), off + 1, n), " "), "UTF-8")


def _parted(regions: DataFrame, length: int, k: int, full: int, words: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Collections over full entries, parted until they fit.

    regions: (h, r, w, d0, d1, n, a, bytes), a the anchor's place; length, k and places in bytes or
    words. Returns regions (h, r, w, d0, d1, n, bytes) to be decided, and tables (h, r, off, h1, r1): from start off of region (h, r) on lies region (h1, r1).
    All members of a part share the bytes from lo to hi, counted from the anchor.
    """
    some = _words_from if words else _bytes_from
    small, places = [], []
    now = regions.withColumns({"lo": F.lit(0), "hi": F.lit(k), "one": F.lit(False)})
    while True:
        now = written(now, "parts")
        size = now.groupBy("h").agg(_entries(length, 2 if words else 1).alias("size"), F.first("one").alias("one"))
        large = written(size.filter((F.col("size") > full) & ~F.col("one")).select("h"), "large")
        small.append(now.join(large, "h", "left_anti").select(F.lit(words).alias("words"), "h", "r", "w", "d0", "d1", "n", "bytes"))
        if not large.limit(1).count():
            return small, places
        free = F.lit(length) - F.col("hi") + F.col("lo")
        middle = F.ceil(free / 2).cast("int") - F.col("lo")  # starts as far or farther before the anchor go left
        cut = F.greatest(F.lit(0), F.least(F.col("n"), F.col("a") - F.col("middle") + 1))
        both = now.join(large, "h").withColumn("free", free).withColumn("middle", middle).withColumn("cut", cut)
        side = F.explode(F.array(
            F.struct(F.lit(0).alias("off"), F.col("cut").alias("n1"), (-F.col("middle")).alias("lo1"), F.col("hi").alias("hi1")),
            F.struct(F.col("cut").alias("off"), (F.col("n") - F.col("cut")).alias("n1"), F.col("lo").alias("lo1"), (F.col("hi") + F.floor(F.col("free") / 2).cast("int") + 1).alias("hi1")),
        ))
        parts = both.withColumn("side", side).select("h", "r", "w", "d0", "d1", "a", "bytes", "lo", "side.*").filter("n1 > 0")
        shared = some(F.col("a") + F.col("lo1"), F.col("hi1") - F.col("lo1"))
        own = some(F.col("off"), F.col("n1") + (length - 1))
        # a part whose shared bytes are all of its strings holds one string only
        parts = parts.select("h", "r", "off", "w", "d0", "d1", F.xxhash64("h", F.col("lo1") < F.col("lo"), F.md5(shared)).alias("h1"), own.alias("bytes"), F.col("n1").alias("n"), (F.col("a") - F.col("off")).alias("a"), F.col("lo1").alias("lo"), F.col("hi1").alias("hi"))
        parts = written(parts.withColumn("r1", F.xxhash64(F.md5("bytes"), "a")), "sides")
        places.append(parts.select("h", "r", "off", "h1", "r1"))
        now = parts.groupBy(F.col("h1").alias("h"), F.col("r1").alias("r")).agg(F.sum("w").alias("w"), F.min("d0").alias("d0"), F.max("d1").alias("d1"), *(F.first(c).alias(c) for c in ("n", "a", "bytes", "lo", "hi")))
        now = now.withColumn("one", F.col("hi") - F.col("lo") >= length)


def without_repeats(
    docs: DataFrame, length: int = 400, k: int = 80, full: int = FULL, most_ids: int = 1_000_000, doc_id: str = "doc_id", text: str = "text", passage: int = 50, passage_k: int = 12
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (long), kept_sha256, spans (array of (lo, hi), in bytes), n_passage_words (long) of every row.

    A null text is empty; texts shorter than length lose nothing. Repeated rows count as
    often as they stand there, so each loses what the others hold. n_passage_words: words
    `[^\\x20\\x09-\\x0D]+` in a run of `passage` words that another row holds too; such words go only
    if their bytes repeat over length. Texts longer than a block
    of anchors (32 MiB) are read whole like any other. full: entries of a transform beyond
    which a collection is parted. most_ids: rows up to which the ids of the documents whose text is needed
    again are broadcast before texts are shuffled; beyond it texts are joined without that.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = written(_anchored(docs.withColumn("row", F.monotonically_increasing_id()), length, k, passage, passage_k), "stretches")
    found = rows.select("row", F.explode("runs").alias("x")).unionByName(rows.select("row", F.explode("passages").alias("x"))).select("row", "x.*")
    of_words = F.col("h").bitwiseAND(F.lit(1)) == 1
    # any one place of a stretch stands for all; first() of a row's columns keeps them together
    distinct = found.groupBy("h", "r").agg(F.count("*").alias("w"), F.min("row").alias("d0"), F.max("row").alias("d1"), *(F.first(c).alias(c) for c in ("n", "a", "row", "at", "len")))
    collection = Window.partitionBy("h")
    size = F.when(of_words, _entries(passage, 2).over(collection)).otherwise(_entries(length).over(collection))
    heavy = distinct.withColumns({"total": F.sum("w").over(collection), "least": F.min("d0").over(collection), "most": F.max("d1").over(collection), "m": F.count("*").over(collection), "size": size})
    heavy = heavy.filter(F.when(of_words, F.col("least") < F.col("most")).otherwise(F.col("total") >= 2))
    heavy = written(heavy.withColumn("words", of_words).drop("total", "least", "most"), "heavy")

    def needed(ids: DataFrame) -> DataFrame:
        """docs, at least those of ids."""
        ids = written(ids.select("doc_id", "th").distinct(), "ids")
        if ids.count() > most_ids:
            return docs
        ids = ids.withColumnsRenamed({"doc_id": "i", "th": "t"})
        return docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left_semi")

    # a stretch without another in its collection is decided by its number alone
    alone = heavy.filter("m = 1").select("words", "h", "r", F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi"))).alias("runs"))
    several = heavy.filter("m > 1").join(rows.select("row", "doc_id", "th"), "row")
    texts = needed(several).withColumnsRenamed({"doc_id": "i", "th": "t"})
    several = several.join(texts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")))
    several = several.select("words", "h", "r", F.col("w").cast("long").alias("w"), "d0", "d1", "n", "a", "size", F.substring("text", F.col("at") + 1, F.col("len")).alias("bytes"))
    # a text that stands in repeated rows has given its stretches as often
    several = written(several.dropDuplicates(["h", "r"]), "several")
    regions = several.filter(F.col("size") <= full).select("words", "h", "r", "w", "d0", "d1", "n", "bytes")
    places = []
    for words in [x.words for x in heavy.filter((F.col("m") > 1) & (F.col("size") > full)).select("words").distinct().collect()]:
        large = several.filter((F.col("words") == words) & (F.col("size") > full)).drop("words", "size")
        hot, parts = _parted(large, *((passage, passage_k) if words else (length, k)), full, words)
        places.append((words, parts))
        for x in hot:
            regions = regions.unionByName(x)
    decided = _decided(regions.repartition("h").sortWithinPartitions("words", "h"), length, passage, min(full, HELD))
    decided = written(decided.filter(F.size("runs") > 0), "decided")
    for words, parts in places:
        for at in reversed(parts):  # what was decided of the parts belongs to the regions that they lie in
            part = at.join(decided.filter(F.col("words") == words).select(F.col("h").alias("h1"), F.col("r").alias("r1"), "runs"), ["h1", "r1"])
            part = part.select("h", "r", F.transform("runs", lambda x: F.struct((x["lo"] + F.col("off")).alias("lo"), (x["hi"] + F.col("off")).alias("hi"))).alias("runs"))
            decided = decided.unionByName(part.groupBy(F.lit(words).alias("words"), "h", "r").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs")))
    decided = written(alone.unionByName(decided), "flags")
    cover = found.select("row", "h", "r", "s0").join(decided, ["h", "r"]).select("row", "words", "s0", F.explode("runs").alias("x"))
    more = F.when(F.col("words"), passage - 1).otherwise(length - 1)
    cover = cover.select("row", "words", F.struct((F.col("s0") + F.col("x.lo")).alias("lo"), (F.col("s0") + F.col("x.hi") + more).alias("hi")).alias("x"))
    spans = [F.sort_array(F.collect_set(F.when(F.col("words") == w, F.col("x")))).alias(c) for w, c in ((False, "cover"), (True, "passages"))]
    cover = written(cover.groupBy("row").agg(*spans).select("row", "cover", _covered("passages").alias("n_passage_words")), "cover")
    named = cover.filter(F.size("cover") > 0).join(rows.select("row", F.col("doc_id").alias("i"), F.col("th").alias("t")), "row").drop("row").dropDuplicates(["i", "t"])
    named = written(named, "named")
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))
    cut = _cut(needed(named.withColumnsRenamed({"i": "doc_id", "t": "th"})).join(named, same).select("doc_id", "text", "cover", "n_passage_words"))
    whole = rows.select("row", "doc_id", "n_bytes", "whole").join(cover, "row", "left").filter(F.coalesce(F.size("cover"), F.lit(0)) <= 0)
    none = F.lit(0).cast("long")
    whole = whole.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.col("whole").alias("kept_sha256"), F.expr("cast(array() as array<struct<lo: int, hi: int>>)").alias("spans"), F.coalesce("n_passage_words", none).alias("n_passage_words"))
    return cut.unionByName(whole)


def _covered(spans: str) -> F.Column:
    """Number of places in sorted spans, each once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def add(a: F.Column, x: F.Column) -> F.Column:
        return F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], a["end"]))).alias("n"), F.greatest(a["end"], x["hi"]).alias("end"))

    return F.aggregate(spans, start, add, lambda a: a["n"])


def merged(cover: list[dict]) -> list[list[int]]:
    """Maximal spans of sorted, overlapping ones."""
    out: list[list[int]] = []
    for x in cover:
        if out and x["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["hi"])
        else:
            out.append([x["lo"], x["hi"]])
    return out


def _cut(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, cover in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans, at, left = merged(cover), 0, hashlib.sha256()
                for lo, hi in spans:
                    left.update(t[at:lo])
                    at = hi
                left.update(t[at:])
                out.append((len(t), sum(hi - lo for lo, hi in spans), len(spans), left.hexdigest(), [{"lo": lo, "hi": hi} for lo, hi in spans]))
            if out:
                n, removed, count, digest, spans = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest), pa.array(spans, span), b.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage_words"])

    return docs.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: int, hi: int>>, n_passage_words long")
