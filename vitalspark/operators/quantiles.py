"""Exact quantiles of many columns at once, by narrowing ranges of bits.

A value's 64 bits, turned so that they sort like numbers, are fixed DIGIT bits at a time: a round counts, for every column
and wanted rank, the values that agree with the bits so far by their next ones, all in one job over the rows. Tasks count into
arrays, so a round shuffles and collects at most wanted ranks x 2^DIGIT numbers however many rows or distinct values there
are, where a percentile aggregate holds all distinct values of a column in one buffer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: Bits that a round fixes.
DIGIT = 11


def _keys(x: np.ndarray) -> np.ndarray:
    """Bits that sort like the numbers; both zeros are one."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


def _count(rows: DataFrame, columns: Sequence[str], slots: list[tuple[int, int]], shift: int, width: int) -> np.ndarray:
    """(slots, 2^width) counts: values of a slot's column whose bits above shift + width are the slot's, by the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(slots), 1 << width), np.int64)
        for batch in batches:
            for k in sorted({c for c, _ in slots}):
                x = batch.column(f"c{k}").drop_null().to_numpy(zero_copy_only=False)
                keys = _keys(x[~np.isnan(x)])
                high = keys >> np.uint64(shift + width) if shift + width < 64 else np.zeros(len(keys), np.uint64)
                digit = ((keys >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
                for s, (column, prefix) in enumerate(slots):
                    if column == k:
                        total[s] += np.bincount(digit[high == np.uint64(prefix)], minlength=1 << width)
        s, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(total[s, d])], names=["slot", "digit", "n"])

    out = np.zeros((len(slots), 1 << width), np.int64)
    for slot, digit, n in rows.mapInArrow(run, "slot int, digit int, n bigint").groupBy("slot", "digit").agg(F.sum("n")).collect():  # slots x 2^DIGIT at most
        out[slot, digit] = n
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column with linear interpolation between neighbours; nulls and not-a-numbers are left out, and a
    column of these alone has none."""
    if any(not 0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities are between 0 and 1")
    rows = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        slots = [(k, 0) for k in range(len(columns))]
        sizes, state, left = [0] * len(columns), {}, 64
        while left and slots:
            width = min(DIGIT, left)
            left -= width
            table = dict(zip(slots, _count(rows, columns, slots, left, width)))
            if left + width == 64:
                sizes = [int(table[k, 0].sum()) for k in range(len(columns))]
                # bits so far, and the rank among the values that have them
                state = {(k, r): (0, r) for k, n in enumerate(sizes) if n for p in probabilities for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
            for key, (prefix, rank) in state.items():
                run = np.cumsum(table[key[0], prefix])
                digit = int(np.searchsorted(run, rank, side="right"))
                state[key] = (prefix << width | digit, rank - int(run[digit - 1] if digit else 0))
            slots = sorted({(k, prefix) for (k, _), (prefix, _) in state.items()})
        found = {key: float(_values(np.array([prefix], np.uint64))[0]) for key, (prefix, _) in state.items()}
        out: dict[str, list[float | None]] = {}
        for k, (c, n) in enumerate(zip(columns, sizes)):
            out[c] = []
            for p in probabilities:
                at = (n - 1) * p
                low, high = (found.get((k, f(at))) for f in (math.floor, math.ceil))
                out[c].append(None if not n else low if low == high else low + (high - low) * (at - math.floor(at)))
        return out
    finally:
        rows.unpersist()
