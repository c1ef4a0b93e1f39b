"""Segments of a stream of frames: the last frame and segment of each run are the state.

Frames come in order within a run; a frame at or before the last one is late and dropped.
On ordered input the result equals the batch operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "subject string, session string, frame long, segment_id long, pos long"


def streaming_segments(frames: DataFrame) -> DataFrame:
    """(subject, session, frame) to the same with segment_id and pos."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, segment, pos = state.get if state.exists else (None, -1, -1)
        out = []
        for f in sorted({int(x) for part in parts for x in part["frame"]}):
            if last is not None and f <= last:
                continue
            segment, pos = (segment, pos + 1) if last is not None and f == last + 1 else (segment + 1, 0)
            last = f
            out.append((*key, f, segment, pos))
        if last is not None:
            state.update((last, segment, pos))
        yield pd.DataFrame(out, columns=["subject", "session", "frame", "segment_id", "pos"])

    return frames.groupBy("subject", "session").applyInPandasWithState(advance, OUT, "last long, segment long, pos long", "append", "NoTimeout")
