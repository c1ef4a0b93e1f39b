"""Toxicity by compression distance: two zstandard dictionaries, window by window.

An ordinary dictionary is trained on ordinary text, a toxic one on the words of toxic
text that hold character runs which toxic documents share and ordinary ones hardly have.
Texts are cut into windows of words; each is compressed with the ordinary dictionary
alone, and with the same dictionary followed by the toxic one (a filler of the toxic
one's length keeps the offsets alike). How many bytes the toxic dictionary saves, over
the windows of a document, is turned into a probability by a logistic curve fitted to
windows of documents that the dictionaries at hand have not seen.

Fitting takes a bounded sample of labelled rows (MOST_DOCS of each class, texts up to
MOST_BYTES, first in the order of a hash); everything else covers all rows and whole texts.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tune
from .textcore import blobs

MOST_DOCS, MOST_BYTES = 1500, 20_000
WINDOW, GRAM, FOLDS = 12, 5, 3
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 2_048
#: zstandard's level, and the shortest match that counts as one
LEVEL, LEAST_MATCH = 3, 5


def windows(text: bytes) -> list[bytes]:
    w = text.lower().split()
    return [b" ".join(w[i : i + WINDOW]) for i in range(0, len(w), WINDOW)]


def _marked(word: bytes) -> bytes:
    return b" " + word + b" "


def _grams(word: bytes) -> Iterator[bytes]:
    s = _marked(word)
    return (s[i : i + GRAM] for i in range(len(s) - GRAM + 1))


def telling_words(toxic: list[bytes], ordinary: list[bytes], least: int = 5, ratio: float = 10.0) -> list[bytes]:
    """Words of toxic texts, repeats included, that hold a run of GRAM bytes which is ratio times as common there.

    A run must be in at least `least` toxic texts and stand between as many different
    neighbours as half of these, so that copies of one text do not make it telling.
    """
    seen_o = Counter(g for t in ordinary for g in {g for w in set(t.lower().split()) for g in _grams(w)})
    seen_t = Counter(g for t in toxic for g in {g for w in set(t.lower().split()) for g in _grams(w)})
    often = {g for g, n in seen_t.items() if n >= least and n / len(toxic) >= ratio * (seen_o[g] + 0.5) / (len(ordinary) + 1)}
    near: dict[bytes, set] = defaultdict(set)
    for t in toxic:
        w = t.lower().split()
        for a, x, b in zip([b"", *w], w, [*w[1:], b""]):
            for g in _grams(x):
                if g in often:
                    near[g].add((a, b))
    often = {g for g in often if len(near[g]) >= max(least, seen_t[g] / 2)}
    return [_marked(x) for t in toxic for x in t.lower().split() if any(g in often for g in _grams(x))]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the samples themselves where they are too few to train one."""
    total = sum(map(len, samples))
    try:
        return zstd.train_dictionary(max(256, min(size, total // 4)), samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def open(self) -> None:
        def one(data: bytes) -> zstd.ZstdCompressor:
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), source_size=64, min_match=LEAST_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(data), compression_params=how)

        self.plain = one(self.ordinary + b"\0" * len(self.toxic)).compress
        self.primed = one(self.ordinary + self.toxic).compress

    def __getstate__(self) -> dict:
        return {"ordinary": self.ordinary, "toxic": self.toxic}

    def features(self, text: bytes) -> list[float]:
        """Of the bytes saved in each window: most, mean of the first three, mean, share of 2 and of 3 or more; log of windows."""
        if not hasattr(self, "plain"):
            self.open()
        w = windows(text)
        if not w or not self.toxic:
            return [0.0] * 6
        g = np.sort(np.array([len(self.plain(x)) - len(self.primed(x)) for x in w], float))[::-1]
        return [g[0], g[:3].mean(), g.mean(), (g >= 2).mean(), (g >= 3).mean(), float(np.log1p(len(g)))]


def trained(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    base = [w for t in ordinary for w in (b" ".join(t.lower().split()[i : i + 32]) for i in range(0, len(t.split()), 32))]
    random.Random(42).shuffle(base)
    words = telling_words(toxic, ordinary) if toxic and ordinary else []
    random.Random(42).shuffle(words)
    return Dictionaries(_trained(base[:20_000], ORDINARY_BYTES), _trained(words, TOXIC_BYTES) if words else b"")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, hold = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + hold @ w
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + hold, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.dictionaries.features(t) for t in texts]).reshape(len(texts), 6)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(rows: list[tuple[bytes, int]], totals: dict[int, int]) -> Model:
    """A model from (text, label) of a sample, and the number of all labelled rows of each label."""
    rows = sorted({t: y for t, y in rows}.items())
    random.Random(42).shuffle(rows)
    features, labels = [], []
    for k in range(FOLDS):
        seen, unseen = [r for i, r in enumerate(rows) if i % FOLDS != k], rows[k::FOLDS]
        d = trained([t for t, y in seen if y], [t for t, y in seen if not y])
        features += [d.features(t) for t, _ in unseen]
        labels += [y for _, y in unseen]
    x, y = np.array(features, float).reshape(len(labels), 6), np.array(labels, float)
    final = trained([t for t, y in rows if y], [t for t, y in rows if not y])
    if not len(y) or not 0 < y.mean() < 1:
        rate = totals.get(1, 0) / max(1, sum(totals.values()))
        odds = np.log(np.clip(rate, 1e-6, 1 - 1e-6) / (1 - np.clip(rate, 1e-6, 1 - 1e-6)))
        return Model(final, np.zeros(6), np.ones(6), np.array([0.0] * 6 + [odds]))
    weight = np.where(y == 1, totals.get(1, 1) / y.sum(), totals.get(0, 1) / (1 - y).sum())
    weight *= len(y) / weight.sum()
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Model(final, mean, scale, _logistic((x - mean) / scale, y, weight))


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, most_bytes: int = MOST_BYTES) -> Model:
    """A model learnt from labelled rows that are not held out; docs (doc_id, text), labels (doc_id, toxic)."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    rows = []
    for y in (0, 1):
        # the first of a hash's order: ids with room for texts that are too long or missing
        ids = known.filter(F.col("toxic") == y).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(2 * most_docs)
        texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").filter(F.octet_length("text").between(1, most_bytes))
        rows += [(r[0].encode(), y) for r in texts.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most_docs).select("text").collect()]
    return fitted(rows, totals)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of every row; null and empty texts have the score of no window."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = kept.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shared.value.scores(blobs(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return kept.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")
