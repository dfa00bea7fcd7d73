"""Reachability: full closures by squaring, seeded ones by frontier, components by label spreading."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """All pairs ``(x, y)`` joined by one or more of ``edges`` (x, y), by squaring: log2 of the longest path in rounds.

    Only paths that grew in the last round are joined again. On a cycle the pairs (x, x) are there too. Null ends are
    ignored. Rounds that don't suffice are an error, here and below.
    """
    all_ = cut(edges.select("x", "y").dropna().distinct(), "closure", n=F.count("*"))
    delta, steps = all_.df, []
    for _ in range(max_rounds):
        left = delta.join(all_.df.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"))
        right = all_.df.join(delta.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"))
        fresh = cut(left.unionByName(right).distinct().join(all_.df, ["x", "y"], "left_anti"), "fresh", n=F.count("*"))
        if not fresh.seen["n"]:
            fresh.drop()
            return all_.df
        both = cut(all_.df.unionByName(fresh.df), "closure")
        all_.drop()
        for s in steps:
            s.drop()
        all_, delta, steps = both, fresh.df, [fresh]
    raise ValueError(f"the closure isn't complete after {max_rounds} rounds")


#: Links followed between two written steps of ``reach``.
STRIDE = 4


def reach(edges: DataFrame, seeds: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """``(seed, node, hops)`` for what each of ``seeds`` (seed) reaches over ``edges`` (x, y), by the fewest links.

    A seed isn't reached by itself, not even over a cycle: this is the built-in closure. A round follows STRIDE links and
    is written once; only nodes first met at its last link are followed further.
    """
    e = cut(edges.select("x", "y").dropna().distinct(), "edges").df
    front = cut(seeds.select("seed").dropna().distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")), "front", n=F.count("*"))
    known = [front]
    last = 0
    for _ in range(max_rounds):
        if not known[-1].seen["n"]:
            return union_all([f.df for f in known]).where("hops > 0")
        level = known[-1].df.where(F.col("hops") == last)
        levels = []
        for _ in range(STRIDE):
            level = level.join(e, F.col("node") == F.col("x")).select("seed", F.col("y").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
            levels.append(level)
        last += STRIDE
        step = union_all(levels).groupBy("seed", "node").agg(F.min("hops").alias("hops"))
        seen = union_all([f.df for f in known]).select("seed", "node")
        known.append(cut(step.join(seen, ["seed", "node"], "left_anti"), "front", n=F.count_if(F.col("hops") == last), all=F.count("*")))
        if len(known) > 8:
            one = cut(union_all([f.df for f in known]), "reached", n=F.count_if(F.col("hops") == last))
            for f in known:
                f.drop()
            known = [one]
    raise ValueError(f"more lies beyond {max_rounds} rounds")


def reflexive(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (x, y) and every node (node) with itself."""
    return pairs.select("x", "y").unionByName(nodes.select(F.col("node").alias("x"), F.col("node").alias("y"))).distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(node, component)`` of the undirected graph of ``edges`` (x, y); the least node names a component.

    Alternating large-star and small-star steps: every round replaces links by links to the least neighbour seen, which
    ends in log rounds with one star per component. A star's centre is only ever an aggregate's key.
    """
    both = edges.select("x", "y").dropna().distinct()
    alone = both.select(F.col("x").alias("node")).unionByName(both.select(F.col("y").alias("node"))).distinct()
    now = cut(both.where("x <> y").select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("u")).distinct(), "links", n=F.count("*"), s=F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
    for _ in range(max_rounds):
        before = (now.seen["n"], now.seen["s"])
        # large star: each node links its larger neighbours to the least of itself and its neighbours
        d = now.df
        near = d.select(F.col("v").alias("a"), F.col("u").alias("b")).unionByName(d.select(F.col("u").alias("a"), F.col("v").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("v"), F.col("m").alias("u"))
        large = large.where("v <> u").distinct()
        # small star: each node links its smaller neighbours and itself to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = cut(small, "links", n=F.count("*"), s=F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
        now.drop()
        now = after
        if (now.seen["n"], now.seen["s"]) == before:
            break
    else:
        raise ValueError(f"components aren't found after {max_rounds} rounds")
    return alone.join(now.df.select(F.col("v").alias("node"), F.col("u").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
