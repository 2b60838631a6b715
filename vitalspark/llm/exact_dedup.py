"""Exact deduplication of an incoming batch against an immutable snapshot.

Method: every snapshot segment (a hash range of its distinct digests) carries a static 3-wise binary-fuse
filter with 8-bit fingerprints. Distinct digests of the incoming batch are screened by the filter of their
segment; only positives join the exact buckets of the snapshot, and whatever shares a digest is compared
byte by byte. Duplicates inside the new batch are grouped on their own.

Screening streams: the batch decides how many tasks share a segment, so neither a small snapshot under a large batch nor
the reverse makes a task hold more than a filter.

Skew: a text that a third of the rows share is one digest; it is counted by partial aggregation, filters and
screening see distinct digests only, and the join back to the rows is a plain equi-join that AQE may split.
A snapshot and its filters are tables (`write_snapshot`) that every later batch reads again (`against_snapshot`).

Defined results: a null text counts as empty; texts are compared unchanged (no case, space or Unicode
folding); of equal texts the row with the largest doc_id stays (null ids sort below all others; of rows
that repeat the same largest id exactly one stays); an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, fresh, map_arrow, materialise, maybe_broadcast, shared_dir, shuffle_width, table

#: Distinct digests a snapshot segment holds on average; a filter of that size takes about 150 KB.
SEGMENT_KEYS = 120_000
#: Incoming digests that are screened by one copy of a filter on average.
PART_KEYS = 1_000_000
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants) over x xor seed."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class FuseFilter:
    """Static 3-wise binary-fuse filter over 64-bit keys: no false negative, about 1/256 false positives."""

    def __init__(self, keys: np.ndarray):
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        self.length = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        grow = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        self.segments = max(1, math.ceil(n * grow / self.length) - 2 if n > 1 else 1)
        for attempt in range(1, 200):
            self.seed = attempt * 0x9E3779B97F4A7C15 & int(_MASK)
            if self._build(keys):
                return
            if attempt % 10 == 0:
                self.segments += 1
        raise RuntimeError("binary-fuse construction did not converge")

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, self.seed)
        first = ((h >> np.uint64(32)) * np.uint64(self.segments)) >> np.uint64(32)
        base = first.astype(np.int64) * self.length
        m = np.uint64(self.length - 1)
        at = [base + k * self.length + ((h >> np.uint64(s)) & m).astype(np.int64) for k, s in ((0, 0), (1, 18), (2, 36))]
        return np.stack(at), ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    def _build(self, keys: np.ndarray) -> bool:
        size = (self.segments + 2) * self.length
        slots, prints = self._slots(keys)
        n = len(keys)
        count = np.bincount(slots.ravel(), minlength=size)
        ids = np.zeros(size, np.int64)  # xor of the key numbers that touch a slot
        for row in slots:
            np.bitwise_xor.at(ids, row, np.arange(n))
        alive, layers = np.ones(n, bool), []
        while True:
            lone = np.flatnonzero(count == 1)
            if not len(lone):
                break
            k, where = np.unique(ids[lone], return_index=True)
            layers.append((k, lone[where]))
            alive[k] = False
            for row in slots[:, k]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(ids, row, k)
        if alive.any():
            return False
        self.table = np.zeros(size, np.uint8)
        for k, own in reversed(layers):  # no key of a layer touches the own slot of another one of it
            self.table[own] = 0
            a, b, c = (self.table[row] for row in slots[:, k])
            self.table[own] = prints[k] ^ a ^ b ^ c
        return True

    def contains(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(np.asarray(keys, np.uint64))
        a, b, c = (self.table[row] for row in slots)
        return (a ^ b ^ c) == prints

    def dump(self) -> bytes:
        return np.array([self.seed, self.length, self.segments], np.uint64).tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, raw: bytes) -> FuseFilter:
        own = cls.__new__(cls)
        own.seed, own.length, own.segments = (int(x) for x in np.frombuffer(raw[:24], np.uint64))
        own.table = np.frombuffer(raw[24:], np.uint8)
        return own


def _keys(digests: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x[:8]).ljust(8, b"\0") for x in digests), np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"seg": pdf["seg"].iloc[:1], "filter": [FuseFilter(_keys(pdf["digest"])).dump()]})


def build_filters(digests: DataFrame, segments: int) -> DataFrame:
    """(seg, filter) for distinct snapshot digests; a segment is a hash range, so no key makes it large."""
    return digests.select(_segment(segments), "digest").groupBy("seg").applyInPandas(_build, "seg int, filter binary")


def screen(digests: DataFrame, filters: DataFrame, segments: int) -> DataFrame:
    """The incoming digests that the filter of their segment does not rule out.

    The batch sets how many parts a segment's digests are dealt to, and each part gets the segment's filter ahead of its
    digests; these stream past it, so a task holds one filter and one Arrow batch however large batch and snapshot are.
    """
    parts = digests.count() // (segments * PART_KEYS) + 1
    part = F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    none = F.lit(None).cast("binary")
    new = digests.select(_segment(segments), part, none.alias("filter"), "digest")
    old = filters.select("seg", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter", none.alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array(batch.column("seg").to_pylist(), np.int64) * parts + np.array(batch.column("part").to_pylist(), np.int64)
            first = batch.column("filter").is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(first | np.r_[True, at[1:] != at[:-1]])
            for s, e in zip(starts.tolist(), np.r_[starts[1:], len(at)].tolist()):
                if at[s] != group:
                    group, own = at[s], None  # a segment that the snapshot has nothing of has no filter
                if first[s]:
                    own, s = FuseFilter.load(batch.column("filter")[s].as_py()), s + 1
                if own is not None and s < e:
                    some = batch.column("digest").slice(s, e - s)
                    yield pa.RecordBatch.from_arrays([some.filter(pa.array(own.contains(_keys(some.to_pylist()))))], names=["digest"])

    ordered = new.unionByName(old).repartition("seg", "part").sortWithinPartitions("seg", "part", F.col("filter").isNull())
    return map_arrow(ordered, run, "digest binary")


def _segment(segments: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(segments)).cast("int").alias("seg")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("keep"), F.count(F.lit(1)).alias("n"))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _stronger(key: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The next key where texts of one key differ: with a SHA-512, and at last the bytes of the text themselves."""
    return (lambda text: F.concat(sha256(text), F.unhex(F.sha2(text, 512)))) if key is sha256 else (lambda text: F.encode(text, "utf-8"))


def write_snapshot(groups: DataFrame, path: str) -> None:
    """An immutable snapshot: groups(digest, keep, n), and the fuse filter of each of its segments; written once."""
    groups.write.parquet(f"{path}/digests")
    stored = groups.sparkSession.read.schema(groups.schema).parquet(f"{path}/digests")
    segments = max(shuffle_width(groups.sparkSession), stored.count() // SEGMENT_KEYS + 1)
    build_filters(stored, segments).withColumn("segments", F.lit(segments)).write.parquet(f"{path}/filters")


def against_snapshot(batch: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """batch(digest, keep, n) against a written snapshot: its (digest, keep, n), and the digests that both have, with the
    row that stays of both and the rows of both. A filter rules out most of the others before the join."""
    spark = batch.sparkSession
    snap = spark.read.parquet(f"{path}/digests")
    filters = spark.read.parquet(f"{path}/filters")
    segments = filters.select(F.coalesce(F.max("segments"), F.lit(1))).first()[0]
    positive = screen(batch, filters.select("seg", "filter"), segments)
    old = snap.select("digest", F.col("keep").alias("old_keep"), F.col("n").alias("old_n"))
    both = positive.join(batch, "digest").join(old, "digest")
    return snap, both.select("digest", F.greatest("keep", "old_keep").alias("keep"), (F.col("n") + F.col("old_n")).alias("n"))


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None, key: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs(doc_id, text, ...) → one row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    in_snapshot says which rows form the immutable snapshot; by default those whose id has an even crc32. Null is no.
    key: the digest that texts are grouped by; where texts of one key differ in bytes, all is done with a stronger one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0 if in_snapshot is None else F.coalesce(in_snapshot, F.lit(False))).alias("old"))
    digest = key(F.col("text")).alias("digest")
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "old", digest, *([] if key is sha256 else [sha256(F.col("text")).alias("sha")])), "digests")
    path = f"{shared_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(_groups(rows.where("old")), path)
    batch = materialise(_groups(rows.where("not old")), "batch")  # new-batch duplicates are grouped here, apart from the snapshot
    snap, both = against_snapshot(batch, path)
    hits = materialise(both, "hits")
    groups = hits.unionByName(snap.join(hits, "digest", "left_anti")).unionByName(batch.join(hits, "digest", "left_anti"))
    shared = materialise(groups.where("n > 1").select("digest"), "shared")
    if not _unequal(docs.select("text", digest), shared).isEmpty():  # other bytes under one key
        return exact_dedup(docs.select("doc_id", "text", "old"), F.col("old"), _stronger(key))
    return rows.join(groups.select("digest", "keep", "n"), "digest").select(
        "row_id", "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row_id") == F.col("keep.row_id")).alias("kept"), F.lower(F.hex("digest" if key is sha256 else "sha")).alias("text_sha256"),
    )


def _unequal(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """Digests in `shared` whose texts are not all the same bytes (partial aggregation keeps hot texts apart)."""
    most = BROADCAST_BYTES // 32
    own = F.broadcast(shared) if shared.limit(most + 1).count() <= most else shared
    same = docs.join(own, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
    return same.where("a <> b").select("digest")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts; which of rows that tie in text and id is open."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    found = materialise(exact_dedup(docs).select(F.unhex("text_sha256").alias("__digest"), F.col("doc_id").alias("__id"), "keep_id", "kept"), "decided")
    lost = found.where("not kept")
    tied = lost.where("__id <=> keep_id").select("__digest", "__id").distinct()
    gone = maybe_broadcast(lost.where("not (__id <=> keep_id)").select("__digest", "__id"), 48)
    own, id_ = fresh(docs, "__d"), fresh(docs, "__own_doc_id")
    match = lambda other: (F.col(own) == other["__digest"]) & F.col(id_).eqNullSafe(other["__id"])
    rows = docs.withColumn(own, digest).withColumn(id_, F.col("doc_id"))
    rows = rows.join(gone, match(gone), "left_anti")
    if not tied.isEmpty():
        same = rows.join(tied, match(tied), "left_semi").dropDuplicates([own, id_])
        rows = rows.join(tied, match(tied), "left_anti").unionByName(same)
    return rows.drop(own, id_)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
