"""Running sums and products over an ordered key, in one or in two levels.

One level is a window per group and sorts a group in one task: right for tables already aggregated by time. Two levels
cut the order at sampled quantiles, scan the buckets' totals, and add each bucket's base to the scan within it; a
single group of any number of distinct times is then spread over as many tasks as there are buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..cohort import placed_in

#: Rows of a table by time beyond which `auto_buckets` asks for two levels, and rows a bucket then holds.
ONE_LEVEL_ROWS, BUCKET_ROWS = 1_000_000, 200_000


def auto_buckets(rows: int) -> int:
    return 1 if rows <= ONE_LEVEL_ROWS else -(-rows // BUCKET_ROWS)


def sized(at: DataFrame) -> tuple[DataFrame, int]:
    """A table that is aggregated by time, cached until the caller clears the cache, and the buckets to scan it in: the rows
    below it are read once, for the count and for the scan."""
    at = at.persist(StorageLevel.MEMORY_AND_DISK)
    return at, auto_buckets(at.count())


def _frame(keys: Sequence[str], order: str, descending: bool, exclusive: bool = False):
    by = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*keys).orderBy(by)
    return w.rowsBetween(Window.unboundedPreceding, -1) if exclusive else w.rangeBetween(Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column] | None = None, products: dict[str, Column] | None = None, descending: bool = False, buckets: int = 1) -> DataFrame:
    """df with the running sums and products (ties of the order included) under the given names."""
    sums, products = sums or {}, products or {}
    if buckets <= 1:
        w = _frame(keys, order, descending)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()} | {n: F.product(c).over(w) for n, c in products.items()})
    cuts = df.select(F.percentile_approx(F.col(order).cast("double"), [k / buckets for k in range(1, buckets)], 100 * buckets)).first()[0]
    placed = placed_in(df.withColumns({f"__in_{n}": c for n, c in (sums | products).items()}), F.col(order), cuts, "__b")
    total = placed.groupBy(*keys, "__b").agg(*[F.sum(f"__in_{n}").alias(f"__t_{n}") for n in sums], *[F.product(f"__in_{n}").alias(f"__t_{n}") for n in products])
    before = _frame(keys, "__b", descending, exclusive=True)
    base = total.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0.0)).alias(f"__0_{n}") for n in sums], *[F.coalesce(F.product(f"__t_{n}").over(before), F.lit(1.0)).alias(f"__0_{n}") for n in products])
    w = _frame([*keys, "__b"], order, descending)
    out = placed.join(base, [*keys, "__b"])
    out = out.withColumns({n: F.col(f"__0_{n}") + F.sum(f"__in_{n}").over(w) for n in sums} | {n: F.col(f"__0_{n}") * F.product(f"__in_{n}").over(w) for n in products})
    return out.select(*df.columns, *[n for n in (*sums, *products) if n not in df.columns])


def suffix_sum(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], buckets: int = 1) -> DataFrame:
    """Each column replaced by its sum over all rows of the group at or after its place: risk-set sums."""
    return running(df, keys, order, {c: F.col(c) for c in columns}, descending=True, buckets=buckets)
