"""Numbers: parsing, one spelling per number, ground arithmetic and comparison, sorts of literals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_number(c: Column) -> Column:
    """Finite double of a literal's text, else null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def number_text(v: Column) -> Column:
    """Integers below 1e15 without a point; else at most ten decimals without trailing zeros."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    tail = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", v), r"0+$", ""), r"\.$", "")
    return F.when(whole, v.try_cast("bigint").cast("string")).when(v.isNotNull(), tail)


def arithmetic(name: Column, x: Column, y: Column) -> Column:
    """Value of a binary arithmetic function over numbers; null stays symbolic (division by zero, overflow, unknown name)."""
    v = (
        F.when(name == "AdditionFn", x + y)
        .when(name == "SubtractionFn", x - y)
        .when(name == "MultiplicationFn", x * y)
        .when(name == "DivisionFn", F.try_divide(x, y))
    )
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def comparison(name: Column, x: Column, y: Column) -> Column:
    """Truth of a comparison over numbers; null for other names."""
    return (
        F.when(name == "greaterThan", x > y)
        .when(name == "lessThan", x < y)
        .when(name == "greaterThanOrEqualTo", x >= y)
        .when(name == "lessThanOrEqualTo", x <= y)
    )


def literal_sort(text: Column) -> Column:
    """Sort of a numeric literal by its spelling: '/' rational, '.' or exponent real, else integer."""
    return F.when(text.contains("/"), "Rational").when(text.contains(".") | F.lower(text).contains("e"), "Real").otherwise("Integer")


def euclidean_quotient(x: Column, y: Column) -> Column:
    """Integer division with a remainder that is never negative; null for a zero divisor."""
    q = F.try_divide(x - F.pmod(x, F.when(y != 0, F.abs(y))), y)
    return F.round(q).cast("bigint")


def rounding(name: Column, x: Column, y: Column | None = None) -> Column:
    """Value of FloorFn, CeilingFn, RoundFn (halves away from zero) or, with ``y``, RemainderFn (never negative); null for
    other names, a zero divisor and what isn't finite."""
    left = F.when(y != 0, F.pmod(x, F.abs(y))) if y is not None else F.lit(None).cast("double")
    v = F.when(name == "FloorFn", F.floor(x).cast("double")).when(name == "CeilingFn", F.ceil(x).cast("double")).when(name == "RoundFn", F.round(x).cast("double")).when(name == "RemainderFn", left)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
