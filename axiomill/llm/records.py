"""Bags of terms per record, the common input of the term operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.functions.text import name_or_null


def symbols(elements: Column) -> Column:
    """Trimmed values of the symbol elements; an empty array for null elements. Null or blank values are left out."""
    named = F.transform(F.filter(elements, lambda e: (e["kind"] == "symbol") & e["val"].isNotNull()), lambda e: name_or_null(e["val"]))
    return F.coalesce(F.array_compact(named), F.array().cast("array<string>"))


def bags(df: DataFrame, record: str, terms: Column) -> DataFrame:
    """One row ``(record, terms)`` per distinct non-null record. Repeats are combined before the shuffle.

    Repeated rows of a record hold the same content; should they differ, one of them is taken.
    """
    rows = df.select(F.col(record).alias("record"), terms.alias("terms")).where("record is not null")
    return rows.groupBy("record").agg(F.first("terms").alias("terms"))
