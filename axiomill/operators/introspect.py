"""What can be said about a symbol or a place in a file: man pages, nested content, spans, completions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from axiomill.operators import store
from axiomill.operators.closure import closure, reach
from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all
from axiomill.sources.kif import parse, tokens


def inside(st: DataFrame) -> DataFrame:
    """``top, depth, sid``: every statement with itself (depth 0) and all nested in it; one equi-join per level.

    Levels are followed however deep they go; a statement that lies in itself is an error.
    """
    sub = cut(store.elements(st).where("kind = 'sub'").select("sid", F.col("val").try_cast("bigint").alias("inner")).dropna().distinct(), "subs").df
    level = cut(st.select(F.col("sid").alias("top"), F.lit(0).alias("depth"), "sid"), "inside", n=F.count("*"))
    out = []
    while level.seen["n"]:
        out.append(level.df)
        level = cut(level.df.join(sub, "sid").select("top", F.lit(len(out)).alias("depth"), F.col("inner").alias("sid")).distinct(), "inside", n=F.count("*"), own=store.in_itself())
        if level.seen["own"]:
            raise ValueError("a statement is nested in itself")
    return union_all(out) if out else st.select(F.col("sid").alias("top"), F.lit(0).alias("depth"), "sid")


def term_facts(st: DataFrame) -> DataFrame:
    """``sid, depth, size, is_ground, has_numeral, symbols, variables`` over each statement and all nested in it."""
    e = store.elements(st)
    num = (F.col("kind") == "literal") & F.col("val").try_cast("double").isNotNull()
    per = e.groupBy("sid").agg(
        F.count_if(F.col("kind") != "sub").alias("size"), F.count_if(F.col("kind") == "variable").alias("v"), F.count_if(num).alias("n"),
        F.collect_set(F.when(F.col("kind") == "symbol", F.col("val"))).alias("s"), F.collect_set(F.when(F.col("kind") == "variable", F.col("val"))).alias("w"),
    )
    got = inside(st).join(per, "sid", "left").groupBy("top").agg(
        F.max("depth").alias("depth"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), (F.coalesce(F.sum("v"), F.lit(0)) == 0).alias("is_ground"), (F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("has_numeral"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("symbols"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("variables"),
    )
    return got.withColumnRenamed("top", "sid")


def spans(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every token of the files with its place: ``file, kind, text, line, col, start, end, top_start``; offsets count
    characters, ``top_start`` is where the statement around it begins."""
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b["file"], b["value"]):
                tops = sorted((n.span.start, n.span.end) for n in parse(text)[0] if n.span)
                k = 0
                for kind, val, s in tokens(text):
                    while k < len(tops) and tops[k][1] <= s.start:
                        k += 1
                    rows.append((file, kind, val, s.line, s.col, s.start, s.end, tops[k][0] if k < len(tops) and tops[k][0] <= s.start else None))
            out = pd.DataFrame(rows, columns=["file", "kind", "text", "line", "col", "start", "end", "top_start"])
            yield out.astype({"top_start": "Int64"})

    return files.mapInPandas(run, "file string, kind string, text string, line int, col int, start int, end int, top_start bigint")


def at_offset(tokens_: DataFrame, file: str | Column, offset: int) -> DataFrame:
    """The token over an offset of one file: a range filter that reaches the scan."""
    return tokens_.where((F.col("file") == file) & (F.col("start") <= offset) & (F.col("end") > offset))


def rename(tokens_: DataFrame, old: str, new: str) -> DataFrame:
    """Edits ``file, start, end, text`` that rename a symbol everywhere."""
    return tokens_.where((F.col("kind") == "symbol") & (F.col("text") == old)).select("file", "start", "end", F.lit(new).alias("text"))


def man_page(symbol: str, st: DataFrame, e: DataFrame, docs: DataFrame, sorts: DataFrame) -> DataFrame:
    """``section, key, value`` of everything known about a symbol: docs, parents, children, signature, and the formulas that
    name it, once each: ``reference`` by the place of its first own element, or ``nested``. Taxonomy and documentation
    statements are no references: their sections show them."""
    d = docs.where(F.col("symbol") == symbol).select(F.col("rel").alias("section"), F.col("language").alias("key"), F.col("text").alias("value"))
    up = e.where(F.col("child") == symbol).select(F.lit("parent").alias("section"), F.col("rel").alias("key"), F.col("parent").alias("value"))
    down = e.where(F.col("parent") == symbol).select(F.lit("child").alias("section"), F.col("rel").alias("key"), F.col("child").alias("value"))
    sig = sorts.where(F.col("rel") == symbol).select(F.when(F.col("pos") == 0, "range").otherwise("domain").alias("section"), F.col("pos").cast("string").alias("key"), F.col("class").alias("value"))
    about = ("subclass", "instance", "subrelation", "subAttribute", "documentation", "termFormat", "format")
    ref = store.occurrences(st).where(F.col("symbol") == symbol).groupBy("sid").agg(F.min("pos").alias("pos"))
    around = store.roots_of(st, ref.select("sid")).join(ref, "sid").join(st.where(F.coalesce(~F.col("head").isin(*about), F.lit(True))).select(F.col("sid").alias("root")), "root", "left_semi")
    # one reference a formula: its own place there before any nested one
    own = F.min(F.when(F.col("sid") == F.col("root"), F.col("pos")))
    refs = around.groupBy("root").agg(own.alias("pos"))
    ref = refs.select(F.when(F.col("pos").isNull(), "nested").otherwise("reference").alias("section"), F.col("pos").cast("string").alias("key"), F.col("root").cast("string").alias("value"))
    return union_all([d, up, down, sig, ref]).orderBy("section", "key", "value")


def expected_class(sorts: DataFrame, rel: str, pos: int) -> DataFrame:
    """The class an argument should have, positions from 1."""
    return sorts.where((F.col("rel") == rel) & (F.col("pos") == pos)).select("class")


def completions(st: DataFrame, e: DataFrame, sorts: DataFrame, rel: str | None = None, pos: int = 0) -> DataFrame:
    """``word``: heads where a statement begins; inside, the members of the argument's class."""
    if rel is None or pos == 0:
        from axiomill.sources.kif import OPERATORS

        ops = st.sparkSession.createDataFrame([(k,) for k in OPERATORS], "word string")
        return ops.unionByName(st.where("head_kind = 'symbol' and head is not null").select(F.col("head").alias("word")).distinct())
    want = expected_class(sorts, rel, pos).select(F.col("class").alias("seed"))
    down = e.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    return reach(down, want).select(F.col("node").alias("word")).distinct()


def below_relation(e: DataFrame, mined: DataFrame | None = None) -> DataFrame:
    """``(x, y)``: relation x lies below relation y, by declaration or by mined rules (x, y) of the form x implies y."""
    rows = e.where("rel = 'subrelation'").select(F.col("child").alias("x"), F.col("parent").alias("y"))
    return closure(rows if mined is None else rows.unionByName(mined.select("x", "y")))


def relation_edges(facts: DataFrame, rel: str, below: DataFrame) -> DataFrame:
    """``x, y, sid``: the two-place facts of a relation and of all relations below it."""
    names = below.where(F.col("y") == rel).select(F.col("x").alias("rel")).unionByName(facts.sparkSession.createDataFrame([(rel,)], "rel string")).distinct()
    return facts.where(F.size("args") == 2).join(names, "rel", "left_semi").select(F.get("args", F.lit(0)).alias("x"), F.get("args", F.lit(1)).alias("y"), "sid")


def witness_path(edges: DataFrame, start: str, goal: str, max_rounds: int = 1000) -> list[tuple[str, str, int]]:
    """The facts (x, y, sid) of a shortest path from ``start`` to ``goal``, smallest sids first; empty without one.

    Parents are written per round; only the path itself, one row a link, comes to the driver.
    """
    e = cut(edges.select("x", "y", "sid").dropna(subset=["x", "y"]).groupBy("x", "y").agg(F.min("sid").alias("sid")), "edges").df
    known = e.sparkSession.createDataFrame([(start, None, None)], "node string, via string, sid bigint")
    front, rounds = known, []
    for _ in range(max_rounds):
        step = front.select(F.col("node").alias("x")).join(e, "x").groupBy(F.col("y").alias("node")).agg(F.min(F.struct("sid", F.col("x").alias("via"))).alias("b"))
        new = cut(step.select("node", "b.via", "b.sid").join(known.select("node"), "node", "left_anti"), "front", n=F.count("*"), hit=F.count_if(F.col("node") == goal))
        if not new.seen["n"]:
            return []
        rounds.append(new.df)
        known = known.unionByName(new.df)
        front = new.df
        if new.seen["hit"]:
            break
    else:
        return []
    path, at = [], goal
    for df in reversed(rounds):
        r = df.where(F.col("node") == at).first()
        path.append((r["via"], at, r["sid"]))
        at = r["via"]
    return path[::-1]


def bound_variables(st: DataFrame) -> DataFrame:
    """``sid, var``: the variables that each quantifier lists."""
    q = st.where(F.col("head").isin("forall", "exists") & (F.col("head_kind") == "op")).select("sid", F.try_element_at("elements", F.lit(2)).alias("e")).where("e.kind = 'sub'")
    lists = q.select("sid", F.col("e.val").try_cast("bigint").alias("inner"))
    names = store.elements(st).where("kind = 'variable'").select(F.col("sid").alias("inner"), F.col("val").alias("var"))
    return lists.join(names, "inner").select("sid", "var").distinct()


def natural_languages(e: DataFrame, docs: DataFrame, top: str = "NaturalLanguage") -> DataFrame:
    """``language, label``: the instances of ``top`` or a class below it, with their termFormat, the first by text."""
    from axiomill.operators.taxonomy import instances_of

    label = docs.where("rel = 'termFormat'").groupBy(F.col("symbol").alias("language")).agg(F.min("text").alias("label"))
    return instances_of(e, top).select(F.col("instance").alias("language")).join(label, "language", "left")


def document_symbols(st: DataFrame, file: str) -> DataFrame:
    """``line, head, subject``: what stands in a file, in order of its lines; the file's statements only are scanned."""
    return st.where((F.col("file") == file) & F.col("is_root")).select("line", "head", "subject").orderBy("line", "head", "subject")


def workspace_symbols(st: DataFrame, part: str) -> DataFrame:
    """``symbol, file, line``: where each symbol whose name holds ``part``, in any case, is introduced."""
    hit = store.defining_sentence(st).where(F.lower("symbol").contains(part.lower()))
    return hit.join(st.select("sid", "file", "line"), "sid").select("symbol", "file", "line").orderBy("symbol")


def taxonomy_view(e: DataFrame, docs: DataFrame, symbol: str) -> DataFrame:
    """``child, parent, rel, hops, documentation``: the links on all ways up from a symbol, nearest first, each with what is
    said of the parent."""
    up = e.select(F.col("child").alias("x"), F.col("parent").alias("y"))
    seed = e.sparkSession.createDataFrame([(symbol,)], "seed string")
    met = reach(up, seed).select(F.col("node").alias("child"), "hops").unionByName(seed.select(F.col("seed").alias("child"), F.lit(0).alias("hops")))
    said = docs.where("rel = 'documentation'").groupBy(F.col("symbol").alias("parent")).agg(F.min_by("text", "sid").alias("documentation"))
    return e.join(met, "child").select("child", "parent", "rel", F.col("hops") + 1).toDF("child", "parent", "rel", "hops").join(said, "parent", "left").orderBy("hops", "child", "parent")
