"""Mixing sources to target weights.

Method: the documents of a source, in a pseudorandom but fixed order, form one stream of words that is cut into
blocks of BLOCK words. The mix is a sequence of shards of SHARD slots; each shard draws its multinomial counts of
sources. A source's slots are numbered through all shards; slot j takes block permutation[epoch](j mod blocks) with
epoch = j div blocks, a keyed Feistel permutation of the source's block numbers, and blocks join documents by number.
The draws decide which shard and slot a block comes to (`sharded` gives the shards); what a source draws beyond its
quota of slots goes to the sources that drew too few, so each source's words are its target to a word (its last slot
is cut). As no quota exceeds `cap` epochs, and each epoch
takes every block once, no document is taken more than `cap` times its size.

Skew: offsets in a source's stream come from sums in levels (within a hash bucket, over LEVEL buckets, over LEVEL of those
and so on), so a source with a third of all rows is many small windows at any size; blocks spread by number. Draws are per shard and in parallel.
The table of sources reaches the driver: MAX_SOURCES at most, beyond which the call fails with that reason, because
weights are given per source and are configuration.

Defined results: a null text has size 0; sources are ordered by code point, null last and a source of its own;
documents of size 0 and sources without words are taken 0 times; repeated rows are documents of their own; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fresh, map_arrow, materialise, shuffle_width, slices, table

#: Words a block, slots a shard, rows of an offset bucket on average, buckets of a level, and the largest number of sources.
BLOCK, SHARD, BUCKET_ROWS, LEVEL, MAX_SOURCES = 256, 1024, 4096, 4096, 65_536
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), Fraction(3, 2), 2, 20240607
_WORD = re.compile(WORD_PATTERN)
_GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: dict[str | None, int], weights: tuple = WEIGHTS, share: Fraction = SHARE, cap: int = CAP) -> dict[str | None, Fraction]:
    """Words wanted of each source: by weight, at most cap x size, the excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, active, out = share * sum(sizes.values()), set(order), {}
    while active:
        unit = left / sum(weight[s] for s in active)
        full = {s for s in active if unit * weight[s] > cap * sizes[s]}
        if not full:
            return out | {s: unit * weight[s] for s in active}
        for s in full:
            out[s] = Fraction(cap * sizes[s])
            left -= out[s]
        active -= full
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def permute(at: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of range(n), elementwise: a 4-round Feistel network walked until it falls inside."""
    at, n, key = (np.array(x, np.uint64) for x in (at, n, key))
    half = np.array([max(1, (int(m) - 1).bit_length() + 1 >> 1) for m in np.unique(n)], np.uint64)[np.unique(n, return_inverse=True)[1]]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = at.copy(), np.arange(len(at))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = out[todo] >> h, out[todo] & m
            for r in (3, 2, 1, 0) if inverse else (0, 1, 2, 3):
                salt = k + np.uint64(r * _GOLDEN & 0xFFFFFFFFFFFFFFFF)
                if inverse:
                    left, right = right ^ (_mix(left + salt * np.uint64(_GOLDEN)) & m), left
                else:
                    left, right = right, left ^ (_mix(right + salt * np.uint64(_GOLDEN)) & m)
            out[todo] = (left << h) | right
            todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _key(source: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.asarray(source, np.uint64) * np.uint64(_GOLDEN) + np.asarray(epoch, np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed))


def quotas(sizes: list[int], wanted: list[Fraction], block: int, seed: int) -> pd.DataFrame:
    """For each source number: blocks, slots, and the words that its last slot takes."""
    rows = []
    for s, (size, target) in enumerate(zip(sizes, wanted, strict=True)):
        words, blocks = round(target), -(-size // block)
        if not words:
            rows.append((blocks, 0, 0))
            continue
        epochs, rest = divmod(words, size)
        tail = size - (blocks - 1) * block
        if not rest:  # ends with a whole epoch: the last slot is whole, whichever block it is
            rows.append((blocks, epochs * blocks, block))
            continue
        place = int(permute([blocks - 1], [blocks], _key(np.array([s]), np.array([epochs]), seed), inverse=True)[0])
        slots = -(-rest // block)
        if slots > place:
            slots = -(-(rest + block - tail) // block)
        before = (slots - 1) * block - (block - tail) * (slots - 1 > place)
        rows.append((blocks, epochs * blocks + slots, rest - before))
    return pd.DataFrame(rows, columns=["blocks", "slots", "cut"])


def _before(value: str, keys: list[str], order: list[str]) -> Column:
    """The sum of value over the rows before in a group of keys."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _bases(sums: DataFrame, buckets: int) -> DataFrame:
    """sums(src, bucket, sum), buckets numbered from 0 → (src, bucket, base): the sum of a source's buckets before.

    Levels of LEVEL buckets: a task orders LEVEL rows of a source at most, whatever the number of buckets.
    """
    if buckets <= LEVEL:
        return sums.select("src", "bucket", _before("sum", ["src"], ["bucket"]).alias("base"))
    part = F.floor(F.col("bucket") / LEVEL)
    above = sums.groupBy("src", part.alias("bucket")).agg(F.sum("sum").alias("sum"))
    above = _bases(above, -(-buckets // LEVEL)).select("src", F.col("bucket").alias("part"), F.col("base").alias("first"))
    own = sums.withColumn("part", part).withColumn("within", _before("sum", ["src", "part"], ["bucket"]))
    return own.join(above.hint("merge"), ["src", "part"]).select("src", "bucket", (F.col("first") + F.col("within")).alias("base"))


def _offsets(rows: DataFrame, count: int) -> DataFrame:
    """rows(src, row_id, doc_id, size) with each one's offset in its source's stream, by sums in levels."""
    buckets = max(count // BUCKET_ROWS + 1, 4 * shuffle_width(rows.sparkSession))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = materialise(rows.groupBy("src", "bucket").agg(F.sum("size").alias("sum")), "mix-buckets")
    within = _before("size", ["src", "bucket"], ["doc_id", "size", "row_id"])
    return rows.join(_bases(sums, buckets).hint("merge"), ["src", "bucket"]).withColumn("offset", F.col("base") + within)


class Mix:
    """The plan of a mix of rows(row_id, doc_id, source, size): sources, slots and what each row gives."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, shard: int = SHARD, weights: tuple = WEIGHTS, share: Fraction = SHARE, cap: int = CAP, seed: int = SEED):
        self.spark, self.block, self.shard, self.seed = rows.sparkSession, block, shard, seed
        found = rows.groupBy("source").agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        sizes = {r["source"]: r["size"] for r in found}
        wanted = targets(sizes, weights, share, cap)
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        self.sources = pd.DataFrame({"src": range(len(order)), "source": pd.Series(order, dtype=object), "source_size": [sizes[s] for s in order], "target": [float(wanted[s]) for s in order]})
        self.quota = quotas([sizes[s] for s in order], [wanted[s] for s in order], block, seed)
        table_ = self.spark.createDataFrame([(k, s, sizes[s], float(wanted[s])) for k, s in enumerate(order)], "src int, source string, source_size long, target double")
        named = rows.join(F.broadcast(table_.withColumnRenamed("source", "name")), F.col("source").eqNullSafe(F.col("name"))).drop("name")
        self.rows = materialise(_offsets(named, sum(r["n"] for r in found)), "mix-offsets")

    def draws(self) -> DataFrame:
        """(shard, src, n, slot, first): multinomial counts of sources of each shard, the slots before them in the shard, and
        the source's slots in all shards before."""
        slots = self.quota["slots"].to_numpy()
        total, shard, seed = int(slots.sum()), self.shard, self.seed

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = slots / max(1, total)
            for batch in batches:
                out = []
                for k in batch.column("id").to_pylist():
                    n = np.random.default_rng([seed, k]).multinomial(min(shard, total - k * shard), p)
                    src = np.flatnonzero(n)
                    out.append((np.full(len(src), k), src, n[src], (np.cumsum(n) - n)[src]))
                cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["shard", "src", "n", "slot"])

        counts = materialise(map_arrow(self.spark.range(-(-total // shard)), draw, "shard long, src int, n long, slot long"), "mix-draws")
        first = _bases(counts.select("src", F.col("shard").alias("bucket"), F.col("n").alias("sum")), -(-total // shard))
        return counts.join(first.withColumnRenamed("bucket", "shard").hint("merge"), ["src", "shard"]).select("shard", "src", "n", "slot", F.col("base").alias("first"))

    def slots(self) -> DataFrame:
        """(shard, slot, src, epoch, block, take): one row a slot; take is the number of words from the block's start."""
        draws = materialise(self.draws(), "mix-numbered")
        drawn = np.zeros(len(self.quota), np.int64)
        for r in draws.groupBy("src").agg(F.sum("n").alias("n")).collect():  # a row a source
            drawn[r["src"]] = r["n"]
        quota, blocks, cut = (self.quota[c].to_numpy() for c in ("slots", "blocks", "cut"))
        over, under = np.maximum(drawn - quota, 0), np.maximum(quota - drawn, 0)
        over_first, under_end = np.cumsum(over) - over, np.cumsum(under)
        size, seed, total, per = self.block, self.seed, int(quota.sum()), self.shard

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, src, n, slot, first = (batch.column(c).to_numpy() for c in ("shard", "src", "n", "slot", "first"))
                at = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(at)) - (np.cumsum(n) - n)[at]
                j = first[at] + step
                s = src[at].astype(np.int64)
                late = np.flatnonzero(j >= quota[s])  # beyond the quota: the slot goes to a source that drew too few
                rank = over_first[s[late]] + j[late] - quota[s[late]]
                to = np.searchsorted(under_end, rank, side="right")
                j[late] = drawn[to] + rank - (under_end - under)[to]
                s[late] = to
                epoch = j // blocks[s]
                block = permute(j % blocks[s], blocks[s], _key(s, epoch, seed))
                take = np.where(j == quota[s] - 1, cut[s], size)
                shard = shard[at]
                place = permute(slot[at] + step, np.minimum(per, total - shard * per), _key(shard, np.full(len(shard), -1), seed))
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place), pa.array(s.astype(np.int32)), pa.array(epoch.astype(np.int32)), pa.array(block), pa.array(take)], names=["shard", "slot", "src", "epoch", "block", "take"])

        return map_arrow(draws, expand, "shard long, slot long, src int, epoch int, block long, take long")

    def pieces(self) -> DataFrame:
        """(row_id, src, block, lo, hi, skip): the words [lo, hi) of a row that lie in a block, `skip` words after its start."""
        b = self.block
        some = self.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("size") - 1) / b))))
        lo = F.greatest(F.col("block") * b, F.col("offset"))
        hi = F.least(F.col("block") * b + b, F.col("offset") + F.col("size"))
        return some.select("row_id", "src", "block", (lo - F.col("offset")).alias("lo"), (hi - F.col("offset")).alias("hi"), (lo - F.col("block") * b).alias("skip"))

    def parts(self) -> DataFrame:
        """(row_id, epoch, lo, hi): words of a row that the mix takes; an epoch takes a word once at most."""
        slots = self.slots().select("src", "epoch", "block", "take")
        return self.pieces().join(slots.hint("merge"), ["src", "block"]).select("row_id", "epoch", "lo", F.least("hi", F.col("lo") + F.col("take") - F.col("skip")).alias("hi")).where("hi > lo")

    def taken(self) -> DataFrame:
        """rows with `taken`, the words that the mix takes of each."""
        sums = self.parts().groupBy("row_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
        return self.rows.join(sums.hint("merge"), "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def sharded(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """docs(doc_id, source, text, ...) → shard, slot, source, epoch, block, n_words, text: the output shards, a row a slot.

    A slot's text is its block's words, of one or several documents, joined by one space; `block` tokens at most.
    """
    tagged = materialise(docs.select("doc_id", "source", "text").withColumn("row_id", F.monotonically_increasing_id()), "mix-documents")
    mix = Mix(materialise(sized(tagged, F.col("row_id")), "mix-sizes"), block=block, shard=shard)
    cuts = mix.pieces().groupBy("row_id").agg(F.collect_list(F.struct("src", "block", "lo", "hi", "skip")).alias("cuts"))  # of one document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                words = _WORD.findall(text)
                out += [(c["src"], c["block"], c["skip"], words[c["lo"] : c["hi"]]) for c in cuts]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["src", "block", "skip", "words"])

    pieces = map_arrow(tagged.join(cuts.hint("merge"), "row_id").select("text", "cuts"), cut, "src int, block long, skip long, words array<string>")
    filled = pieces.groupBy("src", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("skip", "words"))), lambda p: p["words"])).alias("words"))  # a block's words
    names = mix.spark.createDataFrame([(k, s) for k, s in enumerate(mix.sources["source"])], "src int, source string")
    slots = mix.slots().join(materialise(filled, "mix-blocks").hint("merge"), ["src", "block"]).join(F.broadcast(names), "src")
    words = F.slice("words", F.lit(1), F.col("take").cast("int"))
    return slots.select("shard", "slot", "source", "epoch", "block", F.size(words).alias("n_words"), F.array_join(words, " ").alias("text"))


def sized(docs: DataFrame, row_id: Column | None = None) -> DataFrame:
    """(row_id, doc_id, source, size) of docs; its rows are numbered unless they bring a number."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select((F.monotonically_increasing_id() if row_id is None else row_id).alias("row_id"), "doc_id", "source", size.alias("size"))


def mix_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs(doc_id, source, text, ...) → doc_id, size, source_size, target, taken."""
    rows = materialise(sized(docs), "mix-sizes")
    return Mix(rows, block=block).taken().select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: docs' columns, a row for each epoch that takes words of a document.

    A document that an epoch takes whole keeps its text unchanged; else its text is the taken words, in order, joined
    by one space, and n_chars, if there, their code points.
    """
    row, cuts = fresh(docs, "__row"), fresh(docs, "__parts")
    tagged = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    rows = materialise(sized(tagged, F.col(row)), "mix-sizes")
    parts = Mix(rows, block=block).parts().groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("epoch", "lo", "hi"))).alias(cuts))
    names = docs.columns
    n_chars = "n_chars" in names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b)):
            texts, found = batch.column("text").to_pylist(), batch.column(cuts).to_pylist()
            at, out = [], []
            for k, (text, parts) in enumerate(zip(texts, found)):
                words = None
                for epoch in dict.fromkeys(p["epoch"] for p in parts):
                    own = [(p["lo"], p["hi"]) for p in parts if p["epoch"] == epoch]
                    words = _WORD.findall(text) if words is None else words
                    whole = sum(b - a for a, b in own) == len(words)
                    at.append(k)
                    out.append(text if whole else " ".join(w for a, b in own for w in words[a:b]))
            rest = batch.select(names).take(pa.array(at, pa.int64()))
            cols = {name: rest.column(name) for name in names} | {"text": pa.array(out, batch.schema.field("text").type)}
            if n_chars:
                cols["n_chars"] = pa.array([len(t) for t in out]).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    joined = tagged.join(parts.withColumnRenamed("row_id", row).hint("merge"), row).drop(row)
    return map_arrow(joined, cut, docs.schema)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
