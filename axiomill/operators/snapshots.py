"""What changed between full snapshots: one window per key over the snapshot index.

Each row is reduced to its key, snapshot and a 128-bit digest of its canonical content before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axiomill.functions.text import clean


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once (a lambda's argument is a bound variable)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number_form(text: Column) -> Column:
    """One spelling per number, its significant digits and power of ten: null where ``text`` is no number.

    Exact for every spelling and length, so that 14e3, 14000 and 14000.0 agree and 10000000000000001 differs from 1e16.
    Powers beyond 10^17 in size count as no number.
    """
    bare = F.regexp_replace(text, r"^[+-]", "")
    digits = F.concat(F.regexp_extract(bare, r"^([0-9]*)", 1), F.regexp_extract(bare, r"^[0-9]*\.([0-9]*)", 1))
    places = F.length(F.regexp_extract(bare, r"^[0-9]*\.([0-9]*)", 1))
    power = F.coalesce(F.nullif(F.regexp_extract(bare, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")), F.lit("0")).try_cast("bigint")
    sign = F.when(text.startswith("-"), "-").otherwise("")

    def form(d: Column) -> Column:
        short = F.regexp_replace(d, r"0+$", "")
        e = power - places + F.length(d) - F.length(short)
        return F.when(short == "", "0").otherwise(F.concat(sign, F.regexp_replace(short, r"^0+", ""), F.lit("e"), e.cast("string")))

    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & power.between(-(10**17), 10**17)
    return F.when(number, _let(digits, form))


def canonical_elements(elements: Column) -> Column:
    """The elements as text in which equal sentences are equal.

    ``elements`` is an array of struct<kind, val>. Outer white space goes; an unquoted literal that is a number takes its
    one spelling; a variable becomes the number of its first place among the variables, so that renaming one to one
    makes no difference. Null elements give null, which equals only null; an empty array gives ''.
    """
    names = F.array_distinct(F.transform(F.filter(elements, lambda e: e["kind"] == "variable"), lambda e: clean(e["val"])))

    def one(e: Column, seen: Column) -> Column:
        val = clean(e["val"])
        unquoted = (e["kind"] == "literal") & ~val.startswith('"')
        shown = (
            F.when(e["kind"] == "variable", F.array_position(seen, val).cast("string"))
            .when(unquoted, F.coalesce(number_form(val), val))
            .otherwise(val)
        )
        # lengths keep neighbours apart whatever the text holds
        return F.concat(
            F.coalesce(e["kind"], F.lit("-")), F.lit(":"), F.coalesce(F.length(shown).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(shown, F.lit(""))
        )

    return _let(names, lambda seen: F.array_join(F.transform(elements, lambda e: one(e, seen)), "|"))


def digest(*cols: Column) -> Column:
    """128 bits of the columns' values and nulls."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def snapshot_changes(df: DataFrame, snap: str, key: str, loaded: str, content: Column) -> DataFrame:
    """Changes between consecutive deliveries: ``snap, key, delta_kind`` with added, removed or changed.

    ``content`` is the digest of what counts as a record's content. Within a delivery the row with the latest ``loaded``
    (null counts as earliest) stands for its key; rows tied on it count as the same, the greatest digest is taken.
    Deliveries are numbered in order of ``snap`` as they occur; rows with a null ``snap`` or ``key`` are ignored. The first
    delivery yields nothing. Rows of a repeated key are combined before the shuffle, so that a key takes at most one
    row a delivery into its window.
    """
    slim = df.select(F.col(snap).alias("s"), F.col(key).alias("k"), F.struct(F.col(loaded).alias("at"), content.alias("h")).alias("v"))
    slim = slim.where("s is not null and k is not null")
    rows = slim.groupBy("s", "k").agg(F.max("v").getField("h").alias("h"))
    # one row a delivery: the number of deliveries, never of records
    order = df.select(F.col(snap).alias("s")).where("s is not null").distinct()
    order = order.select("s", F.row_number().over(W.orderBy("s")).alias("i"), F.lead("s").over(W.orderBy("s")).alias("s_next"))
    order = order.withColumn("first", F.col("i") == 1)
    w = W.partitionBy("k").orderBy("i")
    seen = rows.join(order, "s").select(
        "s", "k", "h", "i", "s_next", F.lag("i").over(w).alias("i_was"), F.lag("h").over(w).alias("h_was"), F.lead("i").over(w).alias("i_next"), "first"
    )
    here = (
        F.when(~F.col("first") & (F.col("i_was").isNull() | (F.col("i_was") < F.col("i") - 1)), F.struct(F.col("s").alias("s"), F.lit("added").alias("d")))
        .when((F.col("i_was") == F.col("i") - 1) & (F.col("h") != F.col("h_was")), F.struct(F.col("s").alias("s"), F.lit("changed").alias("d")))
    )
    gone = F.when(
        F.col("s_next").isNotNull() & (F.col("i_next").isNull() | (F.col("i_next") > F.col("i") + 1)),
        F.struct(F.col("s_next").alias("s"), F.lit("removed").alias("d")),
    )
    out = seen.select("k", F.explode(F.array_compact(F.array(here, gone))).alias("e"))
    return out.select(F.col("e.s").alias(snap), F.col("k").alias(key), F.col("e.d").alias("delta_kind"))
