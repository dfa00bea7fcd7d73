"""Per-key results when a few keys hold most records, by multi-level tree aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.functions.text import clean
from axiomill.plans.cut import cut
from axiomill.plans.skew import tree_aggregate


def key_statistics(df: DataFrame, key: Column, measures: dict[str, tuple[Column, str]] | None = None, **tree) -> DataFrame:
    """One row per key: ``key, n_rows`` and each measure, without one task working through a hot key.

    ``measures`` maps a name to (row value, function) with a function whose states merge by themselves: ``sum``, ``min``,
    ``max``, ``bool_or``, ``bool_and``. Null keys are a row of their own; an empty table gives no rows. ``tree`` is passed to
    ``plans.skew.tree_aggregate``.
    """
    measures = measures or {}
    rows = df.select(key.alias("key"), *[v.alias(n) for n, (v, _) in measures.items()])
    first = {"n_rows": F.count("*")} | {n: F.expr(f"{f}({n})") for n, (_, f) in measures.items()}
    merge = {"n_rows": "sum"} | {n: f for n, (_, f) in measures.items()}
    return tree_aggregate(rows, ["key"], first, merge, **tree)


def hot_keys(df: DataFrame, key: Column, share: float, **tree) -> DataFrame:
    """The non-null keys that own more than ``share`` of all rows (null keys count in the total): ``key, n_rows, n_all``.

    At most 1/``share`` rows. The total is gathered while the per-key results are written, so the table is read once.
    """
    stats = cut(key_statistics(df, key, **tree), "keys", n=F.sum("n_rows"))
    n = stats.seen["n"] or 0
    return stats.df.where((F.col("n_rows") > n * share) & F.col("key").isNotNull()).withColumn("n_all", F.lit(n).cast("long"))


def head(elements: str = "elements") -> Column:
    """The trimmed value of the first element, null for null or empty elements."""
    return clean(F.try_element_at(F.col(elements), F.lit(1)).getField("val"))
