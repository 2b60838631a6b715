"""Result tables: power, errors against oracles, long and wide shapes, timings, histograms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def param_grid(spark, values: dict[str, Sequence]) -> DataFrame:
    """The product of parameter values, one small table crossed with the next."""
    out = None
    for name, options in values.items():
        own = spark.createDataFrame([(v,) for v in options], [name])
        out = own if out is None else out.crossJoin(own)
    return out


def power(results: DataFrame, by: Sequence[str], p: str = "p", level: float = 0.05) -> DataFrame:
    """Share of p-values below a level: power, or type-I error where there is no effect."""
    return results.groupBy(*by).agg(F.avg((F.col(p) < level).cast("double")).alias("power"), F.count(F.lit(1)).alias("n"))


def paired_error(results: DataFrame, keys: Sequence[str], method: str, reference: str, other: str, value: str) -> DataFrame:
    """Relative error of one method's value against another's in the same repetition: conditional aggregation, no self-join."""
    at = lambda m: F.max(F.when(F.col(method) == m, F.col(value)))
    both = results.where(F.col(method).isin(reference, other)).groupBy(*keys).agg(at(reference).alias("reference"), at(other).alias("other"))
    return both.withColumn("relative_error", F.abs(F.col("other") - F.col("reference")) / F.abs(F.col("reference")))


def oracle_error(results: DataFrame, group: Sequence[str], method: str, oracle: str, value: str) -> DataFrame:
    """Each row's difference to the oracle's value of its group."""
    own = F.max(F.when(F.col(method) == oracle, F.col(value))).over(Window.partitionBy(*group))
    return results.withColumn("oracle", own).where(F.col(method) != oracle).withColumn("error", F.col(value) - F.col("oracle"))


def fit_time_stats(results: DataFrame, by: Sequence[str], order: str, head: int, value: str = "fit_time") -> DataFrame:
    """Mean, deviation and number of the first `head` rows of each group in an explicit order."""
    first = results.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__k") <= head)
    return first.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(F.lit(1)).alias("n"))


def wide_to_long(df: DataFrame, ids: Sequence[str], pattern: str, value: str = "value", names: Sequence[str] = ("kind", "covariate")) -> DataFrame:
    """Columns whose names match a pattern become rows; the pattern's groups become columns."""
    own = [c for c in df.columns if re.fullmatch(pattern, c)]
    long = df.unpivot(list(ids), own, "__name", value)
    return long.select(*ids, *[F.regexp_extract("__name", pattern, k + 1).alias(n) for k, n in enumerate(names)], value)


def to_prefixed_row(df: DataFrame, names: str, value: str, prefix: str, known: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A series of (name, value) rows as one row with prefixed columns; names are given, so no job looks for them."""
    return df.groupBy(*by).agg(*[F.max(F.when(F.col(names) == n, F.col(value))).alias(f"{prefix}{n}") for n in known])


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 1, count) of values in [low, high], the last bin closed."""
    cut = F.when(value == high, F.lit(bins)).otherwise(F.floor((value - F.lit(low)) / F.lit((high - low) / bins)).cast("int") + 1)
    return df.where((value >= low) & (value <= high)).groupBy(cut.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def repeat_rows(df: DataFrame, count: Column) -> DataFrame:
    """Each row as often as its count says."""
    return df.withColumn("copy", F.explode(F.when(count >= 1, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))))


def center_pairs(df: DataFrame, center: str) -> DataFrame:
    """All two-centre combinations and the full set, from the distinct centres (a list as long as there are centres)."""
    names = df.select(center).distinct()
    pairs = names.select(F.col(center).alias("a")).join(names.select(F.col(center).alias("b")), F.col("a") < F.col("b")).select(F.concat_ws("+", "a", "b").alias("centers"), F.lit(2).alias("n"))
    return pairs.unionByName(names.agg(F.concat_ws("+", F.array_sort(F.collect_set(center))).alias("centers"), F.count(F.lit(1)).cast("int").alias("n")))


def latex_table(df: DataFrame, columns: Sequence[str], digits: int = 3) -> str:
    """A small result table as LaTeX rows; numbers are formatted by Spark before they are taken."""
    kinds = dict(df.dtypes)
    cells = [F.format_string(f"%.{digits}f", F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("string").alias(c) for c in columns]
    head = " & ".join(c.replace("_", r"\_") for c in columns)
    rows = [" & ".join("" if v is None else v for v in r) + r" \\" for r in df.select(*cells).collect()]
    return "\n".join([r"\begin{tabular}{" + "l" * len(columns) + "}", head + r" \\ \hline", *rows, r"\end{tabular}"])
