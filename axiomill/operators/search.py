"""Ranked text search, vocabulary figures and completeness findings.

``docs`` is (symbol, rel, language, text, sid): the documentation, termFormat and format statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Score of the source of a hit, and the order in which previews are preferred.
SOURCE_SCORE = {"termFormat": 12.0, "documentation": 6.0, "format": 0.0}
PREVIEW = {"documentation": 0, "termFormat": 1, "format": 2}


def strip_quotes(c: Column) -> Column:
    """Without one pair of double quotes around."""
    return F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def docs(facts: DataFrame) -> DataFrame:
    """The three documentation relations from facts (rel, args, sid): documentation names its subject first, the other
    two their language."""
    rows = facts.where(F.col("rel").isin("documentation", "termFormat", "format") & (F.size("args") == 3))
    first = F.col("rel") == "documentation"
    return rows.select(
        F.when(first, F.get("args", F.lit(0))).otherwise(F.get("args", F.lit(1))).alias("symbol"), "rel", F.when(first, F.get("args", F.lit(1))).otherwise(F.get("args", F.lit(0))).alias("language"),
        strip_quotes(F.get("args", F.lit(2))).alias("text"), "sid",
    )


def _case(c: Column, table: dict) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def rank(query: str, symbol: Column, source: Column, offset: Column) -> Column:
    """Score of a hit: how the symbol's name fits, where the text comes from, and how early the match starts (bytes)."""
    q, low = query.lower(), F.lower(symbol)
    name = F.when(low == q, 100.0).when(low.startswith(q), 60.0).when(low.contains(q), 40.0).otherwise(0.0)
    return name + F.coalesce(_case(source, SOURCE_SCORE), F.lit(0.0)) + F.when(offset == 0, 4.0).otherwise(2.0 / (1.0 + offset))


def search(d: DataFrame, query: str, language: str | None = None, symbols: DataFrame | None = None, limit: int | None = None, kinds: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Hits of a case-insensitive substring: ``symbol, source, sid, rank, preview`` in order of rank, symbol, sid.

    The best hit stands for its symbol. ``symbols`` (symbol) adds those whose name holds the query and that have no hit
    in a text; their sid is null. The preview is the symbol's documentation, else termFormat, else format. An empty query
    finds nothing. ``limit`` keeps the first rows only. ``kind`` keeps symbols of one kind by ``kinds`` (node, kinds), where
    ``relation`` takes predicates and functions too. Previews are gathered for the symbols found only.
    """
    q = query.lower()
    rows = d if language is None else d.where(F.col("language") == language)
    low = F.lower("text")
    at = F.instr(low, q)
    hits = rows.where(F.lit(bool(q)) & (at > 0)).select("symbol", F.col("rel").alias("source"), "sid", F.octet_length(F.left(low, at - 1)).alias("offset"))
    scored = hits.withColumn("rank", rank(q, F.col("symbol"), F.col("source"), F.col("offset")))
    best = scored.groupBy("symbol").agg(F.min(F.struct((-F.col("rank")).alias("r"), "sid", "source")).alias("b"))
    found = best.select("symbol", F.col("b.source").alias("source"), F.col("b.sid").alias("sid"), (-F.col("b.r")).alias("rank"))
    if symbols is not None and q:
        named = symbols.select("symbol").where(F.lower("symbol").contains(q)).distinct().join(found, "symbol", "left_anti")
        extra = named.select("symbol", F.lit("name").alias("source"), F.lit(None).cast("bigint").alias("sid"), rank(q, F.col("symbol"), F.lit("format"), F.lit(0)).alias("rank"))
        found = found.unionByName(extra)
    if kind is not None:
        want = ["relation", "predicate", "function"] if kind == "relation" else [kind]
        of_kind = kinds.where(F.arrays_overlap("kinds", F.array(*map(F.lit, want)))).select(F.col("node").alias("symbol"))
        found = found.join(of_kind, "symbol", "left_semi")
    tier = _case(F.col("rel"), PREVIEW)
    shown = rows.join(found.select("symbol").distinct(), "symbol", "left_semi").groupBy("symbol").agg(F.min(F.struct(tier.alias("t"), "sid", "text")).alias("p")).select("symbol", F.col("p.text").alias("preview"))
    out = found.join(shown, "symbol", "left").orderBy(F.desc("rank"), "symbol", "sid")
    return out if limit is None else out.limit(limit)


def coverage(d: DataFrame, rel: str = "documentation") -> DataFrame:
    """``language, subjects``: distinct subjects per language of one documentation relation."""
    return d.where((F.col("rel") == rel) & F.col("language").isNotNull()).select("language", "symbol").distinct().groupBy("language").agg(F.count("*").alias("subjects"))


def vocabulary(kinds: DataFrame, d: DataFrame) -> DataFrame:
    """One row of counts over ``kinds`` (node, is_class, ...) and documentation: classes, instances, relations, ..."""
    documented = d.where("rel = 'documentation'").select(F.col("symbol").alias("node")).distinct().withColumn("doc", F.lit(True))
    labelled = d.where("rel = 'termFormat'").select(F.col("symbol").alias("node")).distinct().withColumn("lab", F.lit(True))
    rows = kinds.join(documented, "node", "left").join(labelled, "node", "left")
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rows.agg(
        n("is_class").alias("classes"), n("is_instance").alias("instances"), n("is_relation").alias("relations"), n("is_predicate").alias("predicates"),
        n("is_function").alias("functions"), n("doc").alias("documented"), n("lab").alias("labelled"),
    )


def completeness(nodes: DataFrame, d: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Findings ``code, symbol, language``: H001 no documentation, H002 documentation repeated in one language,
    H003 no termFormat, H004 a relation without format."""
    has = lambda rel: d.where(F.col("rel") == rel).select(F.col("symbol").alias("node")).distinct()
    none = F.lit(None).cast("string")
    out = nodes.join(has("documentation"), "node", "left_anti").select(F.lit("H001").alias("code"), F.col("node").alias("symbol"), none.alias("language"))
    twice = d.where("rel = 'documentation'").groupBy("symbol", "language").count().where("count > 1")
    out = out.unionByName(twice.select(F.lit("H002").alias("code"), "symbol", "language"))
    out = out.unionByName(nodes.join(has("termFormat"), "node", "left_anti").select(F.lit("H003").alias("code"), F.col("node").alias("symbol"), none.alias("language")))
    if relations is not None:
        out = out.unionByName(relations.join(has("format"), "node", "left_anti").select(F.lit("H004").alias("code"), F.col("node").alias("symbol"), none.alias("language")))
    return out


def doc_spans(text: Column) -> Column:
    """The names linked from a text by ``&%Name``, in order."""
    return F.regexp_extract_all(text, F.lit(r"&%([A-Za-z][A-Za-z0-9_-]*)"), 1)
