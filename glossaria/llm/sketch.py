"""A count-min sketch that tells keys seen once from keys that may be seen more often.

Counters stop at two, and only keys that were counted are asked for, so one bit a counter suffices: whether it reached two. Its size is
fixed, 16 MiB for the default, whatever the input; with more keys than counters it proves fewer keys single and stays right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

ROWS, BITS, BLOCK_BITS = 2, 26, 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_FLUSH = 4_000_000


def slots(keys: np.ndarray) -> np.ndarray:
    """The counters of uint64 keys, one row of the result for each row of the sketch."""
    mixed = [(keys ^ (keys >> np.uint64(31))) * odd >> np.uint64(64 - BITS) for odd in _ODD]
    return np.stack([m.astype(np.int64) + (r << BITS) for r, m in enumerate(mixed)])


def may_repeat(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that were counted exactly once for certain."""
    at = slots(keys)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def _counted(frames: Iterator[pd.DataFrame], stride: int) -> Iterator[pd.DataFrame]:
    def flush(waiting: list[np.ndarray]) -> pd.DataFrame:
        found, n = np.unique(slots(np.concatenate(waiting)), return_counts=True)
        block = found >> BLOCK_BITS
        cuts = np.flatnonzero(np.diff(block)) + 1
        rows = [(int(b[0]), (s[m == 1] & (2**BLOCK_BITS - 1)).astype("<u4").tobytes(), (s[m > 1] & (2**BLOCK_BITS - 1)).astype("<u4").tobytes()) for b, s, m in zip(*(np.split(x, cuts) for x in (block, found, n))) if len(b)]
        return pd.DataFrame(rows, columns=["block", "once", "more"])

    waiting, held = [], 0
    for frame in frames:
        for packed in frame["keys"]:
            waiting.append(np.frombuffer(packed, "<u8")[::stride])
            held += len(waiting[-1])
            if held > _FLUSH:
                yield flush(waiting)
                waiting, held = [], 0
    if held:
        yield flush(waiting)


def _reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def packed(block: int, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"block": [block], "bits": [np.packbits(counts > 1, bitorder="little").tobytes()]})

    block, counts = None, np.zeros(2**BLOCK_BITS, np.uint8)
    for frame in frames:
        for b, once, more in zip(frame["block"], frame["once"], frame["more"]):
            if b != block:
                if block is not None:
                    yield packed(block, counts)
                block = b
                counts[:] = 0
            at = np.frombuffer(once, "<u4")
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(more, "<u4")] = 2
    if block is not None:
        yield packed(block, counts)


def sketch(keys: DataFrame, stride: int = 1) -> np.ndarray:
    """The bits of a sketch of all keys, from rows with a binary column ``keys`` of packed little-endian uint64, of which each ``stride``-th counts.

    Tasks count what they read and pass on the counters that they touched; each block of counters is summed in one task, row after row. What
    comes to the driver is the sketch itself. Null packs are not allowed, empty ones and an empty table are.
    """
    parts = keys.select("keys").mapInPandas(lambda frames: _counted(frames, stride), "block int, once binary, more binary")
    blocks = parts.repartition("block").sortWithinPartitions("block").mapInPandas(_reduced, "block int, bits binary")
    bits = np.zeros((ROWS << BITS) >> 3, np.uint8)
    for row in blocks.collect():
        at = row["block"] << (BLOCK_BITS - 3)
        bits[at : at + (1 << (BLOCK_BITS - 3))] = np.frombuffer(row["bits"], np.uint8)
    return bits
