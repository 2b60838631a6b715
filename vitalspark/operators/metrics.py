"""Accuracy and concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cohort import bucket_rank
from .scan import auto_buckets, suffix_sum


def accuracy(df: DataFrame, probability: Column, label: str) -> DataFrame:
    return df.agg(F.avg(((probability > 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))


def concordance(df: DataFrame, time: str, event: str, score: str) -> DataFrame:
    """One row (concordant, tied, comparable, c_index). Two rows compare if the earlier is an event, or if at equal times
    exactly one is; they agree if the later one has the larger score.

    No pair is made: scores become dense ranks, and a pair of ranks differs first at one bit. So for each bit, within the
    rows that share the higher bits, running counts by time say how many later rows have the other bit. Rows are first
    counted in cells of (time, event, score), and all bits are one grouped pass.
    """
    cells = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), F.col(score).cast("double").alias("s")).na.drop().groupBy("t", "e", "s").agg(F.count(F.lit(1)).alias("n"))
    scores = cells.select("s").distinct()
    many = scores.count()
    ranked = bucket_rank(scores, "s", max(1, many // 100_000), "r")
    bits = max(1, (max(many, 1) - 1).bit_length())
    rows = cells.join(ranked, "s").withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))))
    shift = lambda by: F.floor(F.col("r") / F.pow(F.lit(2.0), by)).cast("long")
    rows = rows.withColumns({"prefix": shift(F.col("level") + 1), "bit": F.when(F.col("level") >= 0, shift(F.col("level")) % 2).otherwise(0)})
    n, dead, one = F.col("n"), F.col("e") == 1, F.col("bit") == 1
    count = lambda when: F.sum(F.when(when, n).otherwise(0))
    at = rows.groupBy("level", "prefix", "t").agg(
        count(one).alias("later1"), count(~one).alias("later0"), count(one).alias("own1"), count(~one).alias("own0"),
        count(one & ~dead).alias("cens1"), count(~one & ~dead).alias("cens0"), count(one & dead).alias("dead1"), count(~one & dead).alias("dead0"))
    times = df.agg(F.approx_count_distinct(time)).first()[0]
    at = suffix_sum(at, ["level", "prefix"], "t", ["later1", "later0"], auto_buckets(times))
    after = lambda k: F.col(f"later{k}") - F.col(f"own{k}") + F.col(f"cens{k}")
    split = F.col("level") >= 0
    sums = at.agg(
        F.sum(F.when(split, F.col("dead0") * after(1)).otherwise(0)).cast("double").alias("concordant"),
        F.sum(F.when(split, F.col("dead1") * after(0)).otherwise(0)).cast("double").alias("discordant"),
        F.sum(F.when(~split, F.col("dead0") * after(0)).otherwise(0)).cast("double").alias("tied"))
    comparable = F.col("concordant") + F.col("discordant") + F.col("tied")
    return sums.select("concordant", "tied", comparable.alias("comparable"), F.try_divide(F.col("concordant") + F.col("tied") / 2, comparable).alias("c_index"))
