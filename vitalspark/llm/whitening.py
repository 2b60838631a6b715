"""Embedding whitening by a randomised range finder.

Method: entries become integers of 1/256; equal vectors count once. A random block of COMPONENTS + OVERSAMPLE directions is
multiplied by the covariance POWER times, each a pass over all centred rows that adds up one small matrix, with a QR step
between passes. Rayleigh-Ritz within the block gives components, and its residuals tell how far they are from eigenvectors.
Unless all residuals are below TOLERANCE of the largest eigenvalue, relative to the gaps around the component, the block is
expanded to the full dimension, where one pass and Rayleigh-Ritz are the whole eigenproblem.

Scale: rows stay on the executors; a task gives one matrix of (dimension x block) in all, the rows of these are added up by
row number in a shuffle, and the driver gets the sum alone. So the driver's memory is bounded by the dimension squared and
does not grow with rows. Copies are merged by a partial aggregation; the transformed rows are a map over the input.

Defined results: rows whose vector is null, or has null or non-finite entries, are left out; shorter vectors count as
filled up with zeros to the longest one's length; entries beyond a long once scaled count as its bounds; repeated rows and
ids are rows of their own, null ids too; there are as many components as dimensions if these are fewer; a component
without variance has explained 0 and a null in whitened; deviation is null where it doesn't fit a long; no rows, or only
empty vectors, give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, map_arrow, materialise, slices, table

COMPONENTS, OVERSAMPLE, POWER, SEED, SCALE = 4, 8, 3, 7, 256
#: Largest error of a component's direction, estimated as residual over gap, that spares the expansion.
TOLERANCE = 1e-13
#: Eigenvalues up to this share of the largest one count as zero.
ZERO = 1e-13
_LONG = np.iinfo(np.int64)


class Fit(NamedTuple):
    n: int
    sums: list[int]
    components: np.ndarray  # (dimension, components), by falling eigenvalue
    values: np.ndarray
    trace: float
    identity_error: float


def scaled(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry) as longs, within a long's bounds."""
    with np.errstate(over="ignore"):
        x = np.floor(entries * SCALE)
    out = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64)
    return np.where(x >= 2.0**63, _LONG.max, np.where(x <= -(2.0**63), _LONG.min, out))


def pack(x: np.ndarray) -> bytes:
    """A vector of longs in the fewest bytes an entry that hold it, which is one form for equal vectors; trailing zeros
    are left out, so that vectors which differ by these alone are equal."""
    x = x[: int(np.flatnonzero(x)[-1]) + 1 if x.any() else 0]
    for size in (1, 2, 4):
        if not len(x) or -(1 << 8 * size - 1) <= x.min() and x.max() < 1 << 8 * size - 1:
            return bytes([size]) + x.astype(f"<i{size}").tobytes()
    return bytes([8]) + x.astype("<i8").tobytes()


def pack_rows(x: np.ndarray) -> list[bytes]:
    """`pack` of each row, those of one size of entries at a time."""
    if not x.size:
        return [pack(row) for row in x]
    low, high, out = x.min(1), x.max(1), [b""] * len(x)
    size = np.full(len(x), 8)
    for one in (4, 2, 1):
        size[(low >= -(1 << 8 * one - 1)) & (high < 1 << 8 * one - 1)] = one
    for one in (1, 2, 4, 8):
        own = np.flatnonzero((size == one) & (x[:, -1] != 0))
        raw, step = x[own].astype(f"<i{one}").tobytes(), one * x.shape[1]
        for k, i in enumerate(own.tolist()):
            out[i] = bytes([one]) + raw[k * step : (k + 1) * step]
    for i in np.flatnonzero(x[:, -1] == 0).tolist():
        out[i] = pack(x[i])
    return out


def unpack(raws: list[bytes], width: int) -> np.ndarray:
    """(rows, width) longs."""
    if raws and width and len({(len(r), r[0]) for r in raws}) == 1 and len(raws[0]) == 1 + raws[0][0] * width:
        return np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1)[:, 1:].copy().view(f"<i{raws[0][0]}").astype(np.int64)
    out = np.zeros((len(raws), width), np.int64)
    for k, raw in enumerate(raws):
        x = np.frombuffer(raw, f"<i{raw[0]}", offset=1)
        out[k, : len(x)] = x
    return out


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows(vec_id, vector) → vec_id, width, x (packed longs) of the rows whose entries are all finite."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            column = batch.column("vector")
            sizes = set(pc.list_value_length(column).to_pylist())
            if len(sizes) == 1 and None not in sizes and 0 not in sizes and not column.flatten().null_count:
                entries = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                keep = np.flatnonzero(np.isfinite(entries).all(1)).tolist()
                packed, width = pack_rows(scaled(entries[keep])), [entries.shape[1]] * len(keep)
            else:  # vectors of several lengths, or with nulls
                keep, width, packed = [], [], []
                for k in range(batch.num_rows):
                    own = column[k]
                    if own.is_valid and not own.values.null_count:
                        entries = own.values.to_numpy(zero_copy_only=False).astype(np.float64)
                        if np.isfinite(entries).all():
                            keep.append(k)
                            width.append(len(entries))
                            packed.append(pack(scaled(entries)))
            yield {"vec_id": batch.column("vec_id").take(pa.array(keep, pa.int64())), "width": width, "x": packed}

        return work

    wanted = rows.select("vec_id", F.col(vector).cast("array<double>").alias("vector"))
    return arrow_map(wanted, f"vec_id {kind}, width int, x binary", make)


def _added(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix that part() makes of a block of them: a task adds up its own, and a shuffle by
    matrix row adds up those of the tasks, in their order."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in (s for b in batches for s in slices(b)):
            raws = batch.column("x").to_pylist()
            for at in range(0, len(raws), 4096):
                total += part(unpack(raws[at : at + 4096], width))
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array([task] * shape[0], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "task", "v"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v")):
                own = v.values.to_numpy()
                sums[i] = sums[i] + own if i in sums else own.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["i", "v"])

    parts = map_arrow(rows.select("x"), local, "i int, task int, v array<double>")
    out = np.zeros(shape)
    for i, v in map_arrow(parts.repartition("i").sortWithinPartitions("i", "task"), merged, "i int, v array<double>").collect():  # a row a matrix row
        out[i] = v
    return out


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums by dimension."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in (s for b in batches for s in slices(b)):
            raws = batch.column("x").to_pylist()
            for at in range(0, len(raws), 4096):
                x = unpack(raws[at : at + 4096], width)
                high, low = x >> 32, x & 0xFFFFFFFF  # halves don't overflow in sums
                total = [t + (int(h) << 32) + int(v) for t, h, v in zip(total, high.sum(0), low.sum(0))]
                n += len(x)
        values = pa.array([str(t) for t in [n, *total]])
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), values], names=["i", "s"])

    parts = map_arrow(rows.select("x"), local, "i int, s string")
    got = {r["i"]: int(r["s"]) for r in parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]


def _ritz(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a basis q and y = V q: values by falling size, their directions, and the norms of their residuals."""
    b = q.T @ y
    values, u = np.linalg.eigh((b + b.T) / 2)
    values, u = values[::-1], u[:, ::-1]
    vectors = q @ u
    return values, vectors, np.linalg.norm(y @ u - vectors * values, axis=0)


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """rows(x), each packed vector once."""
    n, sums = _sums(rows, width)
    mean = np.array([s / n for s in sums])

    def multiplied(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.c_[c.T @ (c @ q), (c * c).sum(0)]

        return _added(rows, width, part, (width, q.shape[1] + 1)) / n

    k = min(components, width)
    block = min(width, k + OVERSAMPLE)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, block)))[0] if block < width else np.eye(width)
    y = multiplied(q)
    trace = float(y[:, -1].sum())
    for _ in range(POWER - 1 if block < width else 0):
        q = np.linalg.qr(y[:, :-1])[0]
        y = multiplied(q)
    y = y[:, :-1]
    values, vectors, residual = _ritz(q, y)
    if block < width:
        gap = np.minimum(np.r_[np.inf, values[: k - 1] - values[1:k]], values[:k] - values[1 : k + 1])
        if not (residual[:k] <= TOLERANCE * np.maximum(gap, 0)).all():
            y = multiplied(np.eye(width))[:, :-1]
            values, vectors, _ = _ritz(np.eye(width), y)
    values, vectors = values[:k], vectors[:, :k]
    some = values > ZERO * max(values.max(initial=0), 0)
    q = np.where(some, vectors / np.sqrt(np.where(some, values, 1)), 0)

    def squares(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ q
        return np.c_[z.T @ z, z.sum(0)]

    moments = _added(rows, width, squares, (k, k + 1)) / n
    apart = np.abs(moments[:, :-1] - np.outer(moments[:, -1], moments[:, -1]) - np.eye(k))[np.ix_(some, some)]
    return Fit(n, sums, vectors, np.where(some, values, 0), trace, float(apart.max(initial=0)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - sum) squared; None beyond a long."""
    most = max([abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))]) * n + max(map(abs, sums))
    if most * most * max(1, len(sums)) <= _LONG.max:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    whole = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v <= _LONG.max else None for v in whole]


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """rows(vec_id, vector, ...) → a row for each vector and component."""
    ready = materialise(quantised(rows, vector), "whiten-rows")
    width = ready.agg(F.max("width")).first()[0] or 0
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    own = fit(materialise(ready.select("x").distinct(), "whiten-fit"), width, components)
    k = len(own.values)

    def make():
        mean, root = np.array([s / own.n for s in own.sums]), np.sqrt(own.values)
        explained = (own.values / own.trace if own.trace > 0 else np.zeros(k)).tolist()

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            ids, raws = batch.column("vec_id"), batch.column("x").to_pylist()
            for at in range(0, len(raws), 4096):
                x = unpack(raws[at : at + 4096], width)
                z = (x - mean) @ own.components
                z = [[v / r if r > 0 else None for v, r in zip(row, root.tolist())] for row in z.tolist()]
                m = len(x)
                yield {
                    "vec_id": ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), k))), "component": list(range(1, k + 1)) * m, "n": [own.n] * (m * k),
                    "deviation": [d for d in deviations(x, own.n, own.sums) for _ in range(k)], "whitened": [v for row in z for v in row],
                    "explained": explained * m, "identity_error": [own.identity_error] * (m * k),
                }

        return work

    return arrow_map(ready, schema, make)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
