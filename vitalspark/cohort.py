"""Cohort tables: roles of columns, preparation, data-quality checks, weights and splits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

#: Floor of probabilities in clipped weights.
TINY = 1e-16


@dataclass(frozen=True)
class CohortSpec:
    """Names of the columns that play a role; covariates are listed, never guessed."""

    duration: str = "time"
    event: str = "event"
    treated: str = "treated"
    center: str = "center"
    covariates: tuple[str, ...] = ()
    id: str = "patient_id"
    weight: str | None = None

    def weighted(self, name: str) -> CohortSpec:
        return replace(self, weight=name)

    @property
    def w(self) -> Column:
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)


def covariates_of(df: DataFrame, spec: CohortSpec, extra_roles: Sequence[str] = ()) -> tuple[str, ...]:
    """Numeric columns without a role; a string column without a role is an error, not silently lost."""
    roles = {spec.duration, spec.event, spec.treated, spec.center, spec.id, spec.weight, *extra_roles}
    rest = [f for f in df.schema if f.name not in roles]
    if bad := [f.name for f in rest if isinstance(f.dataType, StringType)]:
        raise ValueError(f"string columns without a role: {bad}")
    return tuple(f.name for f in rest if isinstance(f.dataType, NumericType))


def model_columns(spec: CohortSpec, strategy: str, cox_columns: Sequence[str] = ()) -> tuple[str, ...]:
    """Covariates of the outcome model: iptw has the treatment, aiptw adds cox columns, webdisco has those alone."""
    own = tuple(cox_columns) or tuple(spec.covariates)
    if strategy == "iptw":
        return (spec.treated,)
    if strategy == "aiptw":
        return (spec.treated, *own)
    if strategy in ("webdisco", "cox"):
        return own
    raise ValueError(f"unknown strategy {strategy!r}")


def prepare(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """Durations and covariates as doubles with NaN as null, flags as integers."""
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double"))
    casts = {c: number(c) for c in (spec.duration, *spec.covariates)}
    flags = {c: F.col(c).cast("int") for c in (spec.event, spec.treated) if c in df.columns}
    return df.withColumns(casts | flags)


def violations(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row with the number of rows that break each rule; a single pass."""
    t, e = F.col(spec.duration), F.col(spec.event)
    rules = {
        "bad_event": e.isNull() | ~e.isin(0, 1),
        "bad_treated": F.col(spec.treated).isNull() | ~F.col(spec.treated).isin(0, 1),
        "nonpositive_event_time": (e == 1) & (t <= 0),
        "missing_time": t.isNull(),
        "missing_covariate": F.greatest(F.lit(False), *[F.col(c).isNull() for c in spec.covariates]) if spec.covariates else F.lit(False),
    }
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


def single_center_violations(df: DataFrame, file_column: str, center: str) -> DataFrame:
    """Files that hold other than exactly one centre."""
    return df.groupBy(file_column).agg(F.count_distinct(center).alias("n_centers")).where("n_centers <> 1")


def signed_time(spec: CohortSpec) -> Column:
    """Positive for events, negative for censored rows; a zero duration loses its flag."""
    return F.abs(F.col(spec.duration)) * (2 * F.col(spec.event) - 1)


def ate_weight(treated: str, ps: Column, clip: float | None = TINY) -> Column:
    t = F.col(treated)
    p, q = (ps, 1 - ps) if clip is None else (F.greatest(ps, F.lit(clip)), F.greatest(1 - ps, F.lit(clip)))
    return t / p + (1 - t) / q


def att_weight(treated: str, ps: Column) -> Column:
    t = F.col(treated)
    return t + ps * (1 - t) / (1 - ps)


def atc_weight(treated: str, ps: Column) -> Column:
    t = F.col(treated)
    return (1 - t) + (1 - ps) * t / ps


WEIGHTS: dict[str, Callable[[str, Column], Column]] = {"ATE": ate_weight, "ATT": att_weight, "ATC": atc_weight}


def min_max(name: str, low: float, high: float) -> Column:
    return (F.col(name) - F.lit(float(low))) / F.lit(float(high - low))


def one_hot(name: str, levels: Sequence) -> dict[str, Column]:
    """Indicators of all but the first of fixed levels."""
    return {f"{name}_{level}": F.when(F.col(name) == level, 1.0).otherwise(0.0) for level in levels[1:]}


def zscore(df: DataFrame, columns: Sequence[str], ddof: int = 1, tol: float = 0.0) -> DataFrame:
    """Standardized columns; the two moments are one aggregate row joined back, so the scan stays distributed."""
    dev = F.var_samp if ddof else F.var_pop
    moments = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("v", dev))])
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.sqrt(F.col(f"__v_{c}") + F.lit(tol)) for c in columns}
    return df.join(F.broadcast(moments)).withColumns(scaled).drop(*moments.columns)


def in_order(df: DataFrame, spec: CohortSpec, *columns: str) -> DataFrame:
    """Rows by time, then event, or by the columns given; ties by id. A range exchange, so no task holds all rows."""
    return df.orderBy(*(columns or (spec.duration, spec.event)), spec.id)


def placed_in(df: DataFrame, value: Column, cuts: Sequence[float], name: str) -> DataFrame:
    """df with the number (a double) of the range between sorted cuts that a value falls in; null is below all."""
    from pyspark.ml.feature import Bucketizer

    inner = sorted({float(c) for c in cuts or []})
    if not inner:
        return df.withColumn(name, F.lit(0.0))
    splits = [float("-inf"), *inner, float("inf")]
    at = df.withColumn("__at", F.coalesce(value.cast("double"), F.lit(float("-inf"))))
    return Bucketizer(splits=splits, inputCol="__at", outputCol=name).transform(at).drop("__at")


def bucket_rank(df: DataFrame, order: str, buckets: int, number: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Rows numbered from 0 in order of a numeric column, in each group of `by`, without sorting a group in one task.

    Values are cut at sampled quantiles; ranks are the bucket's offset plus the place within it.
    """
    cuts = df.select(F.percentile_approx(order, [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0] if buckets > 1 else []
    placed = placed_in(df, F.col(order), cuts, "__bucket")
    sizes = placed.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy(*by, "__bucket").orderBy(order))
    return placed.join(base, [*by, "__bucket"]).withColumn(number, F.col("__base") + within - 1).drop("__bucket", "__base")


def split_uniform(df: DataFrame, n: int, key: Column, name: str = "center", buckets: int = 32) -> DataFrame:
    """Rows in order of a key dealt in n runs of ceil(rows / n)."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    ranked = bucket_rank(df.withColumn("__key", key), "__key", buckets, "__rank")
    return ranked.join(F.broadcast(total)).withColumn(name, F.floor(F.col("__rank") / F.ceil(F.col("__total") / F.lit(n))).cast("int")).drop("__key", "__rank", "__total")


def split_control(df: DataFrame, n: int, key: Column, treated: str = "treated", name: str = "center") -> DataFrame:
    """Treated rows in centre 0, the others dealt over the rest by a key."""
    return df.withColumn(name, F.when(F.col(treated) == 1, F.lit(0)).otherwise(1 + F.pmod(key, F.lit(n - 1))).cast("int"))


def split_by(df: DataFrame, method: Callable[[DataFrame], Column], name: str = "center") -> DataFrame:
    """A split by any column expression; every row has exactly one centre or the call fails."""
    out = df.withColumn(name, method(df))
    if not out.where(F.col(name).isNull()).isEmpty():
        raise ValueError("the split leaves rows without a centre")
    return out


def reallocate(df: DataFrame, arm: int, treated: str, rule: Column) -> DataFrame:
    """Exchangeability: one arm only, its treatment overwritten by a rule."""
    return df.where(F.col(treated) == arm).withColumn(treated, rule.cast("int"))
