"""Readers and writers of cohort tables, dataset registry and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import settle

#: The canonical cohort over orders and line items, as SQL that both engines run.
COHORT_SQL = """
SELECT o.o_orderkey AS patient_id, r.r_name AS center, l.quantity AS time, CAST(CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END AS int) AS event,
       CAST(CASE WHEN (o.o_orderkey * 7919) % 10 < least(8, 2 + l.n_lines) THEN 1 ELSE 0 END AS int) AS treated,
       CAST(l.n_lines AS double) AS x_lines, c.c_acctbal / CAST(10000 AS double) AS x_bal, CAST(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS int) AS x_urgent,
       CAST(least(8, 2 + l.n_lines) AS double) / CAST(10 AS double) AS ps
FROM orders o
JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
"""
COVARIATES = ("x_lines", "x_bal", "x_urgent")
#: Line items that Spark's own number of parts is left to, and line items of a part beyond.
LEFT_ROWS, PART_ROWS = 4_000_000, 1_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(rows: int) -> int:
    """Parts in which rows are joined by key: 0, which leaves it to Spark, or so many that each has about `PART_ROWS` rows."""
    return -(-rows // PART_ROWS) if rows > LEFT_ROWS else 0


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical cohort: line items are summed before they meet orders; nation and region are constant in size.

    Line items come in no order, so adding them up where they are read saves nothing and holds a key a row. Many of them are
    dealt by key first, in parts of constant size that orders are dealt in too, so that a task's memory does not grow.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    parts = parts_of(items.count())
    dealt = (lambda df, key: df.repartition(parts, key)) if parts else (lambda df, key: df)
    items = dealt(items, "l_orderkey").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("time"), F.count(F.lit(1)).alias("n_lines"))
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "r_name")
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    odds = F.least(F.lit(8), 2 + F.col("n_lines"))
    return rows.select(
        F.col("o_orderkey").alias("patient_id"), F.col("r_name").alias("center"), "time", F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("event"),
        F.when((F.col("o_orderkey") * 7919) % 10 < odds, 1).otherwise(0).alias("treated"), F.col("n_lines").cast("double").alias("x_lines"), (F.col("c_acctbal") / 10000.0).alias("x_bal"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("x_urgent"), (odds.cast("double") / 10.0).alias("ps"),
    )


def read_centers(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, format: str = "csv", center: str = "center", **options) -> DataFrame:
    """Centre files under an explicit schema; where they have no centre column it is the name of their folder."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(schema).format(format).options(**({"header": "true"} if format == "csv" else {}), **options)
    df = reader.load(list(paths) if not isinstance(paths, str) else paths)
    if center in df.columns:
        return df
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return df.withColumn(center, F.regexp_replace(folder, f"^{center}=", ""))


def write_centers(df: DataFrame, path: str, center: str = "center", format: str = "parquet", mode: str = "overwrite") -> None:
    """One folder a centre, so that a reader of one centre prunes the others."""
    df.write.mode(mode).partitionBy(center).format(format).option("header", "true").save(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All appended results; corrupt files are skipped and columns merged by name."""
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(path)


def registry(datasets: DataFrame, owner: str | None = None, name: str | None = None, pattern: str | None = None) -> DataFrame:
    """Rows of a dataset listing (name, owner, ...) by owner, exact name or whole-name regular expression."""
    out = datasets
    if owner is not None:
        out = out.where(F.col("owner") == owner)
    if name is not None:
        out = out.where(F.col("name") == name)
    return out if pattern is None else out.where(F.col("name").rlike(f"^(?:{pattern})$"))


def parse_dataset_name(name: str = "name") -> dict:
    """Row count and columns out of names like study_N120_cols-age-bmi."""
    return {"n": F.regexp_extract(name, r"(?<=_N)(\d+)", 1).cast("int"), "columns": F.split(F.regexp_extract(name, r"(?<=_cols-)([\w-]+)", 1), "-")}


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash and row count; one aggregation."""
    return df.agg(F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns])).alias("fingerprint"), F.count(F.lit(1)).alias("n_rows"))


def portable_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and the sum of the rows' digests, the same in any engine that has MD5: rows may come in any order, and a
    repeated row counts. Columns are integers, dates or strings, whose texts all engines agree on; nulls differ from texts."""
    kinds = dict(df.dtypes)
    if odd := [c for c in columns if kinds[c] in ("double", "float") or "<" in kinds[c] or kinds[c].startswith(("decimal", "timestamp", "binary"))]:
        raise ValueError(f"columns without one text: {odd}")
    text = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    digest = F.conv(F.substring(F.md5(F.concat(*[text(c) for c in columns]).cast("binary")), 1, 13), 16, 10).cast("decimal(38,0)")
    return df.agg(F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("n_rows"))


def clean_name(name: str | Column) -> Column:
    """A label as an identifier: lower case, runs of other characters as one underscore, none at its ends."""
    own = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.regexp_replace(F.lower(own), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def label_parts(name: str | Column, separator: str = "_") -> tuple[Column, Column]:
    """The first part of a label and the rest, which is null if there is none: kinds and covariates of result columns."""
    own = F.col(name) if isinstance(name, str) else name
    at = F.instr(own, separator)
    return F.when(at > 0, F.substring(own, F.lit(1), at - 1)).otherwise(own), F.when(at > 0, F.substring(own, at + len(separator), F.char_length(own)))


def write_grid(df: DataFrame, path: str) -> None:
    """A small result grid as CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_grid(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def left_join_all(base: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """A patient table with the columns of other tables of one row a key, each by a left join: no patient is lost."""
    for other in others:
        base = base.join(other, key, "left")
    return base


def clinical_violations(df: DataFrame, bounds: dict[str, tuple[float, float]], levels: dict[str, Sequence]) -> DataFrame:
    """One row: for each column the number of values outside its bounds or its levels; nulls are none."""
    rules = {c: (F.col(f"`{c}`") < low) | (F.col(f"`{c}`") > high) for c, (low, high) in bounds.items()} | {c: ~F.col(f"`{c}`").isin(*own) for c, own in levels.items()}
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(rule).alias(c) for c, rule in rules.items()])


def clinical(df: DataFrame, bounds: dict[str, tuple[float, float]], levels: dict[str, Sequence], death: str, followup: str, arm: str, active: str, center: str, impute: bool | str = False, **forest) -> DataFrame:
    """A raw clinical table as a cohort: event from the death time, treatment from the arm's name, scaled and one-hot
    columns. The column set must be exactly what the arguments name.

    impute: missing covariates are means and modes (true or "mean"), or what random forests on the other covariates predict
    ("forest", with the options of `miss_forest`); values outside a column's levels count as missing there.
    """
    from ..cohort import min_max, one_hot
    from ..operators.etl import fill_mean_mode

    wanted = {*bounds, *levels, death, followup, arm}
    if set(df.columns) != wanted:
        raise ValueError(f"columns differ: missing {sorted(wanted - set(df.columns))}, unknown {sorted(set(df.columns) - wanted)}")
    if impute not in (False, True, "mean", "forest"):
        raise ValueError(f"unknown imputation {impute!r}")
    if impute == "forest":
        df = _by_forest(df, list(bounds), levels, forest)
    elif impute:
        df = fill_mean_mode(df, list(bounds), list(levels))
    scaled = [min_max(f"`{c}`", *b).alias(c) for c, b in bounds.items()]
    hot = [col.alias(n) for c, own in levels.items() for n, col in one_hot(c, own).items()]
    return df.select(F.col(f"`{followup}`").cast("double").alias("time"), F.col(f"`{death}`").isNotNull().cast("int").alias("event"), (F.col(f"`{arm}`") == active).cast("int").alias("treated"), *scaled, *hot, F.lit(center).alias("center"))


def _by_forest(df: DataFrame, numeric: list[str], levels: dict[str, Sequence], options: dict) -> DataFrame:
    """df with its covariates imputed by forests; levels are numbered in their given order."""
    from ..operators.etl import miss_forest, recode

    keyed = settle(df.withColumn("__row", F.monotonically_increasing_id()), "clinical")
    coded = keyed.select("__row", *[f"`{c}`" for c in numeric], *[recode(f"`{c}`", {v: k for k, v in enumerate(own)}, F.lit(None).cast("int")).alias(c) for c, own in levels.items()])
    filled = miss_forest(coded, "__row", numeric, list(levels), **options)
    named = [recode(c, dict(enumerate(own))).alias(c) for c, own in levels.items()]
    return keyed.drop(*numeric, *levels).join(filled.select("__row", *numeric, *named), "__row").drop("__row")
