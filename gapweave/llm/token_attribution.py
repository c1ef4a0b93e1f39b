"""Token counts of sections: whole texts are encoded once, token spans joined to section spans.

A byte-level encoding's tokens cover a text's bytes without gap, so their spans are the
running sum of token lengths. Sections cover the text as well. A token inside one section
counts there; one that crosses a boundary goes to the section that holds most of its
bytes, on a tie to the earlier.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tune
from .textcore import blobs

_OPEN: dict[tuple[str, str], tuple] = {}


def encoding(path: str, pattern: str):
    """(tiktoken encoding, bytes of each id) of a rank file; kept for the process."""
    if (path, pattern) not in _OPEN:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        _OPEN[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _OPEN[path, pattern]


def lines(text: bytes) -> np.ndarray:
    """Starts of the lines of a text in bytes, and its length; a line's \\n belongs to it."""
    cut = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], cut, [len(text)]]))


def attributed(sizes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of these cross a boundary."""
    m = len(bounds) - 1
    ends = np.cumsum(sizes)
    first = np.searchsorted(bounds, ends - sizes, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    to = first.copy()
    over = np.flatnonzero(first != last)
    for k in over.tolist():
        s, e = int(ends[k] - sizes[k]), int(ends[k])
        parts = np.arange(first[k], last[k] + 1)
        to[k] = parts[np.argmax(np.minimum(bounds[parts + 1], e) - np.maximum(bounds[parts], s))]
    return np.bincount(to, minlength=m), np.bincount(to[over], minlength=m)


def section_tokens(docs: DataFrame, path: str, pattern: str, sections: Callable[[bytes], np.ndarray] = lines, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing: a row for each section of each row.

    Sections are numbered from 0; spans are in characters, the end excluded. A null or
    empty text has one section of no token, so every row of docs is there. Repeated rows
    give repeated rows.
    """
    tune(docs.sparkSession)
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoding(path, pattern)
        for b in batches:
            at, number, start, end, tokens, crossing = [], [], [], [], [], []
            for i, t in enumerate(blobs(b.column(1))):
                bounds = sections(t) if t else np.zeros(1, np.int64)
                if len(bounds) < 2:
                    n, over, chars = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(2, np.int64)
                else:
                    ids = np.asarray(enc.encode_to_numpy(t.decode(), disallowed_special=()), np.int64)
                    n, over = attributed(size[ids], bounds)
                    whole = np.concatenate([[0], np.cumsum((np.frombuffer(t, np.uint8) & 0xC0) != 0x80)])
                    chars = whole[bounds]
                at.append(np.full(len(n), i))
                number.append(np.arange(len(n)))
                start.append(chars[:-1])
                end.append(chars[1:])
                tokens.append(n)
                crossing.append(over)
            if at:
                cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in (number, start, end, tokens, crossing)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), *cols], names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing"])

    return kept.mapInArrow(work, f"doc_id {kind}, section long, char_start long, char_end long, n_tokens long, n_crossing long")
