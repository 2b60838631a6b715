"""Document fingerprints by content-defined chunking.

Method: a gear hash over the last 16 bytes proposes boundaries; normalised chunking uses a strict mask before
the target length and a loose one after it, between a least and a largest length. A chunk is its 56-bit
digest; the fingerprint is the multiset of (digest, length), so chunks weigh their length. Containment of A in
B is the length of A's chunks that B has too over all of A's; the likeness of two fingerprints is the smaller
of the two containments. An insertion moves boundaries only near it, so the rest still matches.

The next document in ascending doc_id comes to its predecessor by a range layout: doc_ids are cut into runs at
sampled ids, every run's first row is also sent to the run before it, and each run is sorted and streamed with
one document held back. Whole texts cross the network once; no run depends on how many rows a key has but for
rows of one and the same doc_id.

Defined results: a null text counts as empty; an empty text has the empty fingerprint, and two empty ones
are alike at 1.0, an empty and another text at 0.0; doc_id is a number; rows are ordered by it (nulls first), ties by text;
a single row is its own next document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shuffle_width, slices, table

#: Bytes of the rolling window; least, target and largest chunk length in bytes.
WINDOW, LEAST, TARGET, MOST = 16, 16, 48, 192
#: A boundary before the target length has 7 zero bits at the top of its hash, one after it 4.
STRICT, LOOSE = 7, 4


def _table(seed: int, bits: int) -> np.ndarray:
    """256 pseudorandom words by rule: the first bits of SHA-256 of the seed and the byte."""
    kind = np.uint32 if bits == 32 else np.uint64
    return np.array([int.from_bytes(hashlib.sha256(bytes([seed, b])).digest()[: bits // 8], "big") for b in range(256)], kind)


_GEAR, _BYTE = _table(1, 32), _table(2, 64)
_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def chunks(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its sorted chunk codes, digest << 8 | length, repeats kept. A text's codes depend on it alone."""
    ends = np.cumsum([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    if not n:
        return [np.zeros(0, np.uint64) for _ in texts]
    with np.errstate(over="ignore"):
        h = _GEAR[data]
        for k in (1, 2, 4, 8):  # after each round the hash spans twice as many bytes
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0) + 1
        strict = loose[h[loose - 1] >> np.uint32(32 - STRICT) == 0]
        cuts = np.array(_cut(loose.tolist(), strict.tolist(), ends.tolist()), np.int64)
        room = 1 << n.bit_length()
        power, back = _powers(_STEP, room), _powers(_INVERSE, room)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=total[1:])
        starts = np.r_[0, cuts[:-1]]
        value = (total[cuts] - total[starts]) * back[starts] ^ (cuts - starts).astype(np.uint64)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
        value ^= value >> np.uint64(33)
        codes = (value & np.uint64(0xFFFFFFFFFFFFFF00)) | (cuts - starts).astype(np.uint64)
    bounds = np.searchsorted(cuts, ends, side="right")
    return [np.sort(x) for x in np.split(codes, bounds[:-1])]


def _cut(loose: list[int], strict: list[int], ends: list[int]) -> list[int]:
    """Chunk ends, each found by binary search among the candidate boundaries."""
    loose, strict = [*loose, ends[-1] + MOST], [*strict, ends[-1] + MOST]
    out, start = [], 0
    for end in ends:
        while start < end:
            if end - start <= LEAST:
                start = end
            else:
                cut = strict[bisect_left(strict, start + LEAST)]
                if cut > start + TARGET:
                    cut = min(loose[bisect_left(loose, start + TARGET)], start + MOST)
                start = min(cut, end)
            out.append(start)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The smaller of the containments by length of two chunk multisets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    weight = lambda codes: codes & np.uint64(0xFF)
    shared = int((np.minimum(n[i], m[j]) * weight(both).astype(np.int64)).sum())
    return shared / max(int(weight(a).sum()), int(weight(b).sum()))


def encode(codes: np.ndarray) -> str:
    return base64.b64encode(codes.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) → doc_id, n_chars, fingerprint; a map over the rows."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", _arrow(docs)), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in (s for b in batches for s in slices(b, 2 << 20)):
            own = [x or "" for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in own], pa.int64()), pa.array([encode(c) for c in chunks([x.encode() for x in own])])], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_chars long, fingerprint string")


def _arrow(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def with_next(docs: DataFrame, runs: int | None = None) -> tuple[DataFrame, int]:
    """docs laid out in runs of ascending (doc_id, text), each followed by the first row of the run after it.

    Columns: run, guest (false for the run's own rows), doc_id, text. The last run's guest is the first row.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    runs = runs or 6 * shuffle_width(spark)
    cuts = docs.where("doc_id is not null").select(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)], 100 * runs).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))  # at most runs - 1 ids
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-math.inf))  # monotone in doc_id, which is all that runs need
    laid = docs.withColumn("run", F.lit(0))
    if len(splits) > 2:
        laid = Bucketizer(splits=splits, inputCol="place", outputCol="at").transform(docs.withColumn("place", place)).withColumn("run", F.col("at").cast("int"))
    # the first row of each run, found by partial aggregation over (run, doc_id) and then the least text
    first_id = laid.groupBy("run").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least"))
    first = laid.join(F.broadcast(first_id), "run").where(F.col("doc_id").eqNullSafe(F.col("least.doc_id"))).groupBy("run", "doc_id").agg(F.min("text").alias("text"))
    first = materialise(first, "heads")
    order = Window.orderBy("run")  # one row a run
    before = first.select("run", F.lag("run").over(order).alias("to"), F.max("run").over(Window.partitionBy(F.lit(0))).alias("end"), "doc_id", "text")
    guests = before.select(F.coalesce("to", "end").alias("run"), F.lit(True).alias("guest"), "doc_id", "text")
    return laid.select("run", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests), len(splits) - 1


def compare_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) → the fingerprints of each text and of its edited text, and their likenesses."""
    kind, arrow = dict(docs.dtypes)["doc_id"], _arrow(docs)
    laid, runs = with_next(docs)
    fields = [("doc_id", arrow), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(fields)

    def emit(rows: list[tuple], codes: list[np.ndarray], following: tuple, code: np.ndarray) -> pa.RecordBatch:
        """rows: (doc_id, text) in order, with the row after the last and its chunk codes."""
        names = [t for _, t in rows[1:]] + [following[1]]
        edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for (_, t), nxt in zip(rows, names)]
        raw = [e.encode() for e in edited]
        changed = chunks(raw)
        after = [*codes[1:], code]
        cols = [[i for i, _ in rows], [len(t) for _, t in rows], [hashlib.sha256(r).hexdigest() for r in raw], [encode(c) for c in codes], [encode(c) for c in changed], [likeness(a, b) for a, b in zip(codes, changed)], [likeness(a, b) for a, b in zip(codes, after)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f[1]) for c, f in zip(cols, fields)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (run, doc_id, text) with its codes: the last row seen, whose next one is to come
        for batch in (s for b in batches for s in slices(b, 2 << 20)):
            rows = list(zip(batch.column("run").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            codes = chunks([r[3].encode() for r in rows])
            todo = held + list(zip(rows, codes))
            at = 0
            for k, ((_, guest, _, _), _) in enumerate(todo):
                if guest:  # ends a run
                    part = todo[at:k]
                    if part:
                        yield emit([(r[2], r[3]) for r, _ in part], [c for _, c in part], (todo[k][0][2], todo[k][0][3]), todo[k][1])
                    at = k + 1
            rest = todo[at:]
            if len(rest) > 1:
                yield emit([(r[2], r[3]) for r, _ in rest[:-1]], [c for _, c in rest[:-1]], (rest[-1][0][2], rest[-1][0][3]), rest[-1][1])
            held = rest[-1:]
        assert not held, "a run without the row after it"

    width = max(1, min(runs, shuffle_width(docs.sparkSession)))
    ordered = laid.repartition(width, "run").sortWithinPartitions("run", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return map_arrow(ordered, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_next(table(spark, sf_dir, "documents"))
