"""Strict JSON on the driver: no duplicate keys, no NaN, never over an existing file, whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile


def _unique(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def load_json(path: str):
    with open(path, encoding="utf-8") as f:
        return json.load(f, object_pairs_hook=_unique, parse_constant=_no_constant)


def write_json(payload, path: str) -> None:
    text = json.dumps(payload, allow_nan=False, sort_keys=True, indent=1)
    folder = os.path.dirname(os.path.abspath(path))
    fd, own = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(text)
        os.link(own, path)  # fails if the path is there
    finally:
        os.unlink(own)


def load_groups(path: str) -> dict:
    """left, right and conditioning (or null): disjoint, unique channel names."""
    got = load_json(path)
    if set(got) != {"left", "right", "conditioning"}:
        raise ValueError("left, right and conditioning are wanted")
    names = [*got["left"], *got["right"], *(got["conditioning"] or [])]
    if len(set(names)) < len(names) or not got["left"] or not got["right"]:
        raise ValueError("groups are disjoint and not empty")
    return got
