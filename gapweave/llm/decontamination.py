"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are short and documents long, so a document's own MinHash says little about an
item inside it. Items are therefore partitioned by size, and for each size class the
documents are seen as half-overlapping windows of twice the class's size: within a
class a containment c of an item of q shingles means a Jaccard similarity of at least
c*q / (W + q - c*q) between item and window, from which the number of hash functions
follows. A window is a candidate for an item if they agree in any MinHash value;
candidates are verified by exact containment of shingle strings in the whole document.

Texts count as runs of letters, digits and non-ASCII bytes, A-Z lower-cased. A
text of fewer words than a shingle has its whole word sequence as its one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tune
from .textcore import blobs, chained, inverse_powers, mixed, prefix_hash, range_hash

BLOCK = 8
CHUNK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = _SOLID[data]
    edge = np.flatnonzero(np.diff(solid))
    return edge[0::2], edge[1::2]


def shingle_strings(text: bytes, n: int) -> set[bytes]:
    data = _LOWER[np.frombuffer(text, np.uint8)] if text else np.zeros(0, np.uint8)
    low = data.tobytes()
    w = [low[s:e] for s, e in zip(*(x.tolist() for x in _words(data)))]
    if not w:
        return set()
    return {b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


class Shingles:
    """Shingle hashes of many texts: h, and of which text they are."""

    def __init__(self, texts: list[bytes], n: int):
        joined = b"\n".join(texts)
        data = _LOWER[np.frombuffer(joined, np.uint8)] if joined else np.zeros(0, np.uint8)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        s, e = _words(data)
        if not len(s):
            self.h, self.text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        word = range_hash(prefix_hash(data), s, e, inverse_powers(len(data) + 1))
        of = np.searchsorted(begins, s, side="right") - 1
        h, t = [], []
        if len(word) >= n:
            inside = of[: len(of) - n + 1] == of[n - 1 :]
            h.append(chained(word, n)[inside])
            t.append(of[: len(of) - n + 1][inside])
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a < n:
                h.append(chained(word[a:b], n))
                t.append(of[a : a + 1])
        self.h, self.text = np.concatenate(h), np.concatenate(t)


class ItemIndex:
    """MinHash values of benchmark items by size class."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, containment: float, miss: float = 1e-6):
        self.n, self.containment = n, containment
        self.ids, self.sets, self.classes = [], [], {}
        found = Shingles([t for _, t in items], n)
        order = np.argsort(found.text, kind="stable")
        cut = np.searchsorted(found.text[order], np.arange(len(items) + 1))
        members: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, (item, text) in enumerate(items):
            h = found.h[order[cut[k] : cut[k + 1]]]
            if not len(h):
                continue
            c = max(0, math.ceil(math.log2(len(h) / BLOCK)))
            members.setdefault(c, []).append((len(self.ids), h))
            self.ids.append(item)
            self.sets.append(shingle_strings(text, n))
        self.functions = 0
        for c, rows in members.items():
            q, window = min(len(set(h.tolist())) for _, h in rows), 2 * BLOCK << c
            j = containment * q / (window + q - containment * q)
            self.classes[c] = (math.ceil(math.log(miss) / math.log1p(-j)) if j < 1 else 1, rows)
            self.functions = max(self.functions, self.classes[c][0])
        self.factors = mixed(np.arange(1, self.functions + 1, dtype=np.uint64)) | np.uint64(1)
        self.tables = {}
        for c, (functions, rows) in self.classes.items():
            for f in range(functions):
                low = np.array([(h * self.factors[f]).min() for _, h in rows], np.uint64)
                by = np.argsort(low, kind="stable")
                seen = np.zeros(1 << 16, bool)
                seen[low & np.uint64(0xFFFF)] = True
                self.tables[c, f] = (low[by], np.array([k for k, _ in rows])[by], seen)

    def candidates(self, texts: list[bytes]) -> dict[int, set[int]]:
        """Text to items that agree with one of its windows in a MinHash value."""
        out: dict[int, set[int]] = {}
        x = Shingles(texts, self.n)
        if not len(x.h) or not self.classes:
            return out
        first = np.flatnonzero(np.diff(x.text, prepend=-1))
        position = np.arange(len(x.h)) - np.repeat(first, np.diff(first, append=len(x.h)))
        blocks = np.flatnonzero(position % BLOCK == 0)
        levels = {}
        at, of, number = blocks, x.text[blocks], position[blocks] // BLOCK
        for c in range(max(self.classes) + 1):
            levels[c] = (at, of)
            nxt = np.flatnonzero(number % 2 == 0)
            at, of, number = nxt, of[nxt], number[nxt] // 2
        for f in range(self.functions):
            low = x.h * self.factors[f]
            for c in range(max(self.classes) + 1):
                at, of = levels[c]
                low = np.minimum.reduceat(low, at)
                if c not in self.classes or f >= self.classes[c][0]:
                    continue
                window = low.copy()
                same = of[:-1] == of[1:]
                window[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                values, items, seen = self.tables[c, f]
                hit = np.flatnonzero(seen[window & np.uint64(0xFFFF)])
                lo, hi = np.searchsorted(values, window[hit]), np.searchsorted(values, window[hit], side="right")
                for k in np.flatnonzero(hi > lo).tolist():
                    out.setdefault(int(of[hit[k]]), set()).update(items[lo[k] : hi[k]].tolist())
        return out

    def found(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item id, shared shingles, the item's shingles) of each verified pair."""
        for t, items in sorted(self.candidates(texts).items()):
            own = shingle_strings(texts[t], self.n)
            for k in sorted(items):
                shared = len(self.sets[k] & own)
                if shared >= self.containment * len(self.sets[k]) - 1e-9:
                    yield t, self.ids[k], shared, len(self.sets[k])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > CHUNK_BYTES:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_items: int, n: int, containment: float) -> Iterator:
    """Broadcasts of at most block_items items each: the benchmark is a stated query set, taken in blocks."""
    sc, block = benchmark.sparkSession.sparkContext, []
    for r in benchmark.select(item_id, text).toLocalIterator():
        block.append((r[0], (r[1] or "").encode()))
        if len(block) == block_items:
            yield sc.broadcast(ItemIndex(block, n, containment))
            block = []
    yield sc.broadcast(ItemIndex(block, n, containment))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, containment: float = 0.8, block_items: int = 20_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shared, n_item (long), containment: documents that hold so much of an item.

    One pass over docs for each block of items, no shuffle. Null and empty texts hold
    nothing and are held by nothing; an empty benchmark gives no row; repeated rows of
    docs or items give repeated pairs.
    """
    tune(docs.sparkSession)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = kept.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    out = None
    for index in _blocks(benchmark, item_id, item_text, block_items, words, containment):

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, ids = blobs(b.column(1)), b.column(0)
                for s, e in _chunks(texts):
                    hits = [(t + s, *rest) for t, *rest in index.value.found(texts[s:e])]
                    if hits:
                        at, items, shared, total = zip(*hits)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(at)), pa.array(items), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array([x / y for x, y in zip(shared, total)])],
                            names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
                        )

        one = kept.mapInArrow(work, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_item long, containment double")
        out = one if out is None else out.unionByName(one)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, containment: float = 0.8, block_items: int = 20_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs, all columns and rows, but those that contaminated() would name."""
    tune(docs.sparkSession)
    at = docs.columns.index(text)
    for index in _blocks(benchmark, item_id, item_text, block_items, words, containment):

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = blobs(b.column(at))
                good = np.ones(len(texts), bool)
                for s, e in _chunks(texts):
                    for t, *_ in index.value.found(texts[s:e]):
                        good[s + t] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
