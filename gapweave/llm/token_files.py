"""Token id files with a minimal perfect hash index from document keys to offsets.

Layout of a folder:

* ids-NNNNN.bin: 16 bytes of head (MAGIC, item size), then ids, little-endian, of documents
  in ascending doc_id order; shards follow one another in that order. Items have 2 bytes
  if the vocabulary fits, else 4.
* index-NNNNN.bin: a segment of the index: 32 bytes of head (MAGIC, keys, buckets), a
  displacement for each bucket, then a record for each key at its slot: fingerprint,
  shard, offset, count.

A key is (doc_id, occurrence); occurrence counts rows of equal doc_id from 0. A segment's
hash is minimal and perfect by hash and displace: keys are dealt to buckets, and each bucket
has the first displacement that sends its keys to free slots; buckets of one key name
their slot. A look-up reads one displacement and one record and compares a fingerprint.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import filesystem, tune, written
from .textcore import blobs, mixed

MAGIC = b"GWTOKEN1"
HEAD = 16
RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("count", "<u8")])
KEYS_A_SEGMENT, KEYS_A_BUCKET = 20_000, 4
#: words whose ids a worker remembers
REMEMBERED = 1_000_000

_TOKENIZERS: dict[str, tuple] = {}


def encoder(path: str, item: int):
    """A function from texts to their ids as bytes of items; words are remembered.

    The vocabulary must drop white space (word-end BPE) and lower-case, so that the words
    of a text, parted at ASCII white space and lower-cased A-Z, can be encoded one by one.
    """
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path), {}
    tokenizer, known = _TOKENIZERS[path]
    kind = f"<u{item}"

    def encode(texts: list[bytes]) -> Iterator[bytes]:
        # the tokenizer lower-cases; only the strings of special tokens are looked for before that
        parted = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new: set[bytes] = set()
        for words in parted:
            new.update(words)
        new = [w for w in new if w not in known]
        if new:
            for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                known[w] = np.array(e.ids, kind).tobytes()
        for words in parted:
            yield b"".join(map(known.__getitem__, words))

    return encode


def _key_hashes(doc_ids, occurrences) -> np.ndarray:
    """n x 2 hashes of keys; a null doc_id is a key of its own kind."""
    out = np.empty((len(doc_ids), 2), np.uint64)
    for i, (d, k) in enumerate(zip(doc_ids, occurrences)):
        null = d is None or d != d
        x = xxhash.xxh3_128_intdigest(struct.pack("<?qq", null, 0 if null else int(d), int(k)))
        out[i] = x & (1 << 64) - 1, x >> 64
    return out


def _slots(h: np.ndarray, displacement: np.ndarray | int, n: int) -> np.ndarray:
    return (mixed(h ^ (np.asarray(displacement).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)).astype(np.int64)


def build_segment(hashes: np.ndarray, records: np.ndarray) -> bytes:
    n = len(hashes)
    buckets = max(1, n // KEYS_A_BUCKET)
    bucket = (hashes[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    size = np.diff(cut)
    table, free, place = np.zeros(buckets, "<i8"), np.ones(n, bool), np.empty(n, np.int64)
    for b in np.argsort(-size, kind="stable").tolist():
        if size[b] < 2:
            break
        own = order[cut[b] : cut[b + 1]]
        h, d, many = hashes[own, 1], 0, 16
        while True:  # many displacements at once, the first that fits
            s = _slots(h[None, :], np.arange(d, d + many)[:, None], n)
            fits = free[s].all(axis=1)
            if fits.any():
                ranked = np.sort(s[fits], axis=1)
                fits[fits] = (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if fits.any():
                k = int(np.argmax(fits))
                d, s = d + k, s[k]
                break
            d, many = d + many, min(4096, many * 4)
            if d > 1 << 26:
                raise ValueError("two keys have equal hashes")
        table[b], free[s], place[own] = d, False, s
    left = iter(np.flatnonzero(free).tolist())
    for b in np.flatnonzero(size == 1).tolist():
        own, s = order[cut[b]], next(left)
        table[b], place[own] = -s - 1, s
    out = np.zeros(n, RECORD)
    out[place] = records
    return struct.pack("<8sQQQ", MAGIC, n, buckets, 0) + table.tobytes() + out.tobytes()


class Segment:
    def __init__(self, data: bytes):
        magic, self.n, buckets, _ = struct.unpack_from("<8sQQQ", data)
        assert magic == MAGIC
        self.table = np.frombuffer(data, "<i8", buckets, 32)
        self.records = np.frombuffer(data, RECORD, self.n, 32 + 8 * buckets)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records of keys, and which of the keys are in the index (by fingerprint)."""
        d = self.table[(hashes[:, 0] % np.uint64(len(self.table))).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, _slots(hashes[:, 1], np.maximum(d, 0), self.n))
        found = self.records[slot]
        return found, found["fingerprint"] == (hashes[:, 1] >> np.uint64(32)).astype(np.uint32)


def _put(uri: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write to a name of this attempt, then move: a task that runs again leaves the same file."""
    fs, at = filesystem(uri)
    own = f"{at}/.{name}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    with fs.open_output_stream(own) as f:
        for c in chunks:
            f.write(c)
    fs.move(own, f"{at}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, vocabulary: int = 49_408, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ids and index of docs to folder; (doc_id, occurrence, shard, offset, count) of what was written.

    A null or empty text has the end id alone. Rows of null doc_id come first. Rows of
    equal doc_id are ordered by text.
    """
    spark = docs.sparkSession
    tune(spark)
    item = 2 if vocabulary <= 1 << 16 else 4
    fs, at = filesystem(folder)
    fs.create_dir(at, recursive=True)
    end = b"" if end_id is None else np.array([end_id], f"<u{item}").tobytes()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, total, before, seen, found = TaskContext.get().partitionId(), encoder(tokenizer, item), 0, (), 0, []

        def payload() -> Iterator[bytes]:
            nonlocal total, before, seen
            yield struct.pack("<8sQ", MAGIC, item)
            for b in batches:
                ids, counts, ks = b.column(0).to_pylist(), [], []
                for d, data in zip(ids, encode(blobs(b.column(1)))):
                    seen = seen + 1 if (d,) == before else 0
                    before = (d,)
                    yield data + end
                    counts.append((len(data) + len(end)) // item)
                    ks.append(seen)
                n = np.array(counts, np.int64)
                found.append((b.column(0), ks, total + np.cumsum(n) - n, n))
                total += int(n.sum())

        _put(folder, f"ids-{shard:05d}.bin", payload())
        for ids, ks, offset, n in found:
            if len(n):
                yield pa.RecordBatch.from_arrays([ids, pa.array(ks, pa.int64()), pa.array(np.full(len(n), shard, np.int64)), pa.array(offset), pa.array(n)], names=["doc_id", "occurrence", "shard", "offset", "count"])

    made = written(rows.mapInArrow(work, "doc_id long, occurrence long, shard long, offset long, count long"), "token-rows")
    segments = max(1, -(-made.count() // KEYS_A_SEGMENT))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        h = _key_hashes(part["doc_id"], part["occurrence"])
        r = np.zeros(len(part), RECORD)
        r["fingerprint"] = h[:, 1] >> np.uint64(32)
        for c in ("shard", "offset", "count"):
            r[c] = part[c].to_numpy()
        _put(folder, f"index-{int(part['segment'].iloc[0]):05d}.bin", iter([build_segment(h, r)]))
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "n": [len(part)]})

    keyed = made.withColumn("segment", segment_of(segments))
    keyed.groupBy("segment").applyInPandas(build, "segment long, n long").agg(F.sum("n")).collect()
    _put(folder, "segments.txt", iter([str(segments).encode()]))
    return made


def segment_of(segments: int):
    return F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(segments)).cast("long")


def look_up(keys: DataFrame, folder: str) -> DataFrame:
    """(doc_id, occurrence) to (doc_id, occurrence, shard, offset, count) by the index; keys that it lacks give no row."""
    fs, at = filesystem(folder)
    with fs.open_input_stream(f"{at}/segments.txt") as f:
        segments = int(f.read())

    def find(part: pd.DataFrame) -> pd.DataFrame:
        own, base = filesystem(folder)
        with own.open_input_stream(f"{base}/index-{int(part['segment'].iloc[0]):05d}.bin") as f:
            index = Segment(f.read())
        got, ok = index.find(_key_hashes(part["doc_id"], part["occurrence"]))
        out = part[["doc_id", "occurrence"]].assign(**{c: got[c].astype(np.int64) for c in ("shard", "offset", "count")})
        return out[ok]

    schema = "doc_id long, occurrence long, shard long, offset long, count long"
    return keys.withColumn("segment", segment_of(segments)).groupBy("segment").applyInPandas(find, schema)


def read_back(found: DataFrame, folder: str) -> DataFrame:
    """found of look_up with ids_crc32: of the ids in the files, as unsigned 32-bit little-endian integers."""

    def read(part: pd.DataFrame) -> pd.DataFrame:
        own, base = filesystem(folder)
        part = part.sort_values("offset")
        crc = []
        with own.open_input_file(f"{base}/ids-{int(part['shard'].iloc[0]):05d}.bin") as f:
            item = struct.unpack("<8sQ", f.read_at(HEAD, 0))[1]
            for o, n in zip(part["offset"].tolist(), part["count"].tolist()):
                ids = np.frombuffer(f.read_at(n * item, HEAD + o * item), f"<u{item}")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return part.assign(ids_crc32=crc)

    return found.groupBy("shard").applyInPandas(read, "doc_id long, occurrence long, shard long, offset long, count long, ids_crc32 long")


def shard_starts(made: DataFrame) -> DataFrame:
    """(shard, base): ids in the shards before; one row for each shard."""
    total, rows = 0, []
    for s, n in sorted(tuple(r) for r in made.groupBy("shard").agg(F.sum("count")).collect()):
        rows.append((s, total))
        total += n
    return made.sparkSession.createDataFrame(rows, "shard long, base long")
