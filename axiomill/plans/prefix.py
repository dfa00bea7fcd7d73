"""Running sums over an order too long for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def running_sum(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` up to and with the row, within ``groups`` by (``bucket``, ``order``).

    Rows are added up inside their bucket; the buckets' own sums, one row each, are added up across buckets. No task
    holds more than one bucket's rows, or the one-row-a-bucket sums of a group. ``groups`` and ``bucket`` must not be null.
    """
    keys = [*groups, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_part"))
    earlier = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = df.withColumn("_local", F.sum(value).over(within))
    return local.join(sums, keys).withColumn(out, F.col("_before") + F.col("_local")).drop("_before", "_local")


def running_last(df: DataFrame, groups: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the last non-null ``value`` strictly before the row, within ``groups`` by (``bucket``, ``order``).

    As with sums, a task holds one bucket's rows, or one row per bucket of a group. ``bucket`` must not be null.
    """
    keys = [*groups, bucket]
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    marks = df.select(*keys).distinct()
    marks = marks.join(ends.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    earlier = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    marks = marks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_local", F.last(value, ignorenulls=True).over(within))
    both = local.join(marks, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return both.withColumn(out, F.coalesce("_local", "_before")).drop("_local", "_before", *[f"_{k}" for k in keys])
