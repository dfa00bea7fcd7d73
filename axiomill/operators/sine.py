"""Relevance selection: symbols trigger axioms in which they are among the least general ones.

``use`` is (sid, symbol), which axiom uses which symbol. A symbol's generality is the number of axioms that use it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from axiomill.operators.store import Met
from axiomill.plans.cut import cut
from axiomill.plans.prefix import running_sum
from axiomill.plans.skew import union_all

# Slack of the trigger's comparison, and the largest tolerance that is tried.
EPSILON = 0.001
MAX_TOLERANCE = 64.0


def generality(use: DataFrame) -> DataFrame:
    """``symbol, occ``."""
    return use.select("sid", "symbol").dropna().distinct().groupBy("symbol").agg(F.count("*").alias("occ"))


def update_generality(occ: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``symbol, occ`` after axioms came (``added``) and went (``removed``), both (sid, symbol) of axioms not counted yet or
    counted so far. Work is in proportion to the changes and the vocabulary, not to the base."""
    parts = [occ.select("symbol", "occ")]
    for use, sign in ((added, 1), (removed, -1)):
        if use is not None:
            parts.append(generality(use).select("symbol", (F.col("occ") * sign).alias("occ")))
    return union_all(parts).groupBy("symbol").agg(F.sum("occ").alias("occ")).where("occ > 0")


def least_generality(use: DataFrame) -> DataFrame:
    """``sid, g_min``: the least generality among an axiom's symbols."""
    return _weighed(use).groupBy("sid").agg(F.min("occ").alias("g_min"))


def _weighed(use: DataFrame) -> DataFrame:
    u = use.select("sid", "symbol").dropna().distinct()
    return u.join(u.groupBy("symbol").agg(F.count("*").alias("occ")), "symbol")


def costs(use: DataFrame) -> DataFrame:
    """``sid, symbol, cost``: the tolerance from which on the symbol triggers the axiom, at least 1."""
    rows = cut(_weighed(use), "weighed").df
    g = rows.groupBy("sid").agg(F.min("occ").alias("g_min"))
    return rows.join(g, "sid").select("sid", "symbol", F.greatest(F.lit(1.0), (F.col("occ") - EPSILON) / F.col("g_min")).alias("cost"))


def select(use: DataFrame, seeds: DataFrame, tolerance: float = 1.2, depth: int | None = None, cap: int | None = None) -> DataFrame:
    """``sid, wave``: axioms reached from the ``seeds`` (symbol) by triggering, breadth first.

    The tolerance is at least 1; ``depth`` bounds the waves (0 selects nothing); with a ``cap`` no wave starts once that
    many are selected. Axioms without symbols are never reached.
    """
    if depth == 0:
        return use.sparkSession.createDataFrame([], "sid bigint, wave int")
    held = cut(use.select("sid", "symbol").dropna().distinct(), "uses")
    edges = cut(costs(held.df).where(F.col("cost") <= max(1.0, tolerance)).select("sid", "symbol"), "triggers")
    # a wave is one written step: what its axioms' symbols trigger, without what is taken already
    front, n, k, taken = seeds.select("symbol").dropna().distinct(), 0, 0, Met(["sid"])
    while (depth is None or k < depth) and (cap is None or n < cap):
        k += 1
        new = edges.df.join(front, "symbol", "left_semi").select("sid").distinct()
        wave = cut((taken.new(new) if taken.frames else new).select("sid", F.lit(k).alias("wave")), "wave", n=F.count("*"))
        if not wave.seen["n"]:
            break
        n += wave.seen["n"]
        taken.add(wave.df)
        front = held.df.join(wave.df, "sid", "left_semi").select("symbol").distinct()
    return taken.all() if taken.frames else use.sparkSession.createDataFrame([], "sid bigint, wave int")


def activation(use: DataFrame, seeds: DataFrame, top: float = MAX_TOLERANCE) -> DataFrame:
    """``sid, t``: the least tolerance at which an axiom is selected, up to ``top``.

    A minimax path: relaxation rounds that join only what got cheaper in the last one.
    """
    use = cut(use.select("sid", "symbol").dropna().distinct(), "uses").df
    c = cut(costs(use).where(F.col("cost") <= top), "costs")
    got: DataFrame | None = None
    front = seeds.select("symbol").dropna().distinct().withColumn("t", F.lit(1.0))
    best = front
    while True:
        reach = c.df.join(front, "symbol").groupBy("sid").agg(F.min(F.greatest("cost", "t")).alias("t"))
        if got is not None:
            reach = reach.join(got.withColumnRenamed("t", "was"), "sid", "left").where("was is null or t < was").select("sid", "t")
        new = cut(reach, "cheaper", n=F.count("*"))
        if not new.seen["n"]:
            return got if got is not None else new.df
        got = new.df if got is None else cut(got.unionByName(new.df).groupBy("sid").agg(F.min("t").alias("t")), "activation").df
        sym = use.join(new.df, "sid").groupBy("symbol").agg(F.min("t").alias("t"))
        sym = sym.join(best.withColumnRenamed("t", "was"), "symbol", "left").where("was is null or t < was").select("symbol", "t")
        front = cut(sym, "cheaper").df
        best = cut(best.unionByName(front).groupBy("symbol").agg(F.min("t").alias("t")), "best").df


#: Tolerances of one bucket of the running count.
_STEP = 1 / 64


def breakpoints(use: DataFrame, seeds: DataFrame, top: float = MAX_TOLERANCE) -> DataFrame:
    """``t, n``: each tolerance at which the selection grows, and its size from there on."""
    return _sizes(activation(use, seeds, top))


def _sizes(a: DataFrame) -> DataFrame:
    per = a.groupBy("t").agg(F.count("*").alias("k")).withColumn("bucket", F.floor(F.log2("t") / _STEP))
    return running_sum(per, [], "bucket", ["t"], "k", "n").select("t", "n")


def within_budget(use: DataFrame, seeds: DataFrame, budget: int = 2000) -> DataFrame:
    """``sid, t``: the largest selection of at most ``budget`` axioms over all tolerances up to 64; if even the floor
    (tolerance 1) is larger, the floor."""
    a = cut(activation(use, seeds), "activation").df
    edge = _sizes(a).where(F.col("n") <= budget).agg(F.max("t").alias("t")).first()["t"]
    return a.where(F.col("t") <= max(1.0, edge or 1.0))


def structural_scores(use: DataFrame, frontier: DataFrame, hub: int = 1500) -> DataFrame:
    """``sid, score``: sum of 1/occ over the symbols an axiom shares with the ``frontier`` (symbol), hubs left out."""
    rows = _weighed(use).where(F.col("occ") <= hub).join(frontier.select("symbol").distinct(), "symbol", "left_semi")
    return rows.groupBy("sid").agg(F.sum(1.0 / F.col("occ")).alias("score"))


def rescue(use: DataFrame, frontier: DataFrame, allowed: DataFrame, top_k: int = 32, scan: int = 16, hub: int = 1500) -> DataFrame:
    """The ``top_k`` best-scored axioms among the ``allowed`` (sid) ones of the best ``top_k * scan``; ties by sid.

    That only so many are looked at is part of the selection: what is not allowed uses up its place.
    """
    best = structural_scores(use, frontier, hub).orderBy(F.desc("score"), "sid").limit(top_k * scan)
    return best.join(allowed.select("sid").distinct(), "sid", "left_semi").orderBy(F.desc("score"), "sid").limit(top_k)


def definitions(defines: DataFrame, use: DataFrame, seeds: DataFrame, rounds: int = 3, cap: int = 2000) -> DataFrame:
    """``sid, wave``: the definitions of the ``seeds`` (symbol), then those of the symbols in these, for so many rounds.

    ``defines`` is (sid, symbol), what an axiom defines, ``use`` (sid, symbol) what it names. No round starts once ``cap`` are
    taken.
    """
    front, taken, n = seeds.select("symbol").distinct(), Met(["sid"]), 0
    for k in range(1, rounds + 1):
        new = defines.join(front, "symbol", "left_semi").select("sid").distinct()
        wave = cut((taken.new(new) if taken.frames else new).select("sid", F.lit(k).alias("wave")), "definitions", n=F.count("*"))
        n += wave.seen["n"]
        taken.add(wave.df)
        if not wave.seen["n"] or n >= cap:
            break
        front = use.join(wave.df, "sid", "left_semi").select("symbol").distinct()
    return taken.all()
