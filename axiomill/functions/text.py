"""Text expressions shared by the operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Outer white space that is never part of a symbol: blanks, tabs, line ends.
BLANKS = " \t\r\n\f\x0b"


def clean(c: Column | str) -> Column:
    """``c`` without outer white space."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def name_or_null(c: Column | str) -> Column:
    """``c`` without outer white space; null where nothing is left."""
    return F.nullif(clean(c), F.lit(""))
