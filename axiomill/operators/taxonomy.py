"""Taxonomy and signatures: ancestors, instances, kinds of symbols, arity, domains and ranges, disjointness.

``edges`` is (child, parent, rel) throughout. The names of the top classes are parameters, since they belong to the
knowledge base and not to the engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from axiomill.functions.text import name_or_null
from axiomill.operators.closure import closure, reach
from axiomill.operators.hierarchy import SEGMENT, hierarchy
from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all


@dataclass(frozen=True)
class Names:
    """Names of the classes that the analytics ask for."""

    root: str = "Entity"
    relation: str = "Relation"
    predicate: str = "Predicate"
    function: str = "Function"
    cls: str = "Class"
    formula: str = "Formula"
    arities: tuple[tuple[str, int], ...] = (
        ("BinaryRelation", 2), ("TernaryRelation", 3), ("QuaternaryRelation", 4), ("QuintaryRelation", 5), ("VariableArityRelation", -1),
    )


def edges(tax_edges: DataFrame, *scopes: str) -> DataFrame:
    """``child, parent, rel`` of a table of links, trimmed, distinct, of any of the ``scopes`` or all; null ends are left out."""
    rows = tax_edges if not scopes else tax_edges.where(F.arrays_overlap("scopes", F.array(*map(F.lit, scopes))))
    return rows.select(name_or_null("to_sym").alias("child"), name_or_null("from_sym").alias("parent"), name_or_null("rel").alias("rel")).dropna(subset=["child", "parent"]).distinct()


def ancestors(e: DataFrame, rels: tuple[str, ...] | None = ("subclass",)) -> DataFrame:
    """Strict ``(x, y)``: y lies above x over links of ``rels`` (None: all)."""
    return closure((e if rels is None else e.where(F.col("rel").isin(*rels))).select(F.col("child").alias("x"), F.col("parent").alias("y")))


def _several_parents(e: DataFrame) -> bool:
    links = e.where("child <> parent").groupBy("child").agg(F.min("parent").alias("a"), F.max("parent").alias("b"))
    return not links.where("a <> b").isEmpty()


def reaches(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """The distinct ``pairs`` (x, y) of which y lies at or above x over any link; x = y counts, known or not.

    Where no symbol has two parents, as in a tree of kinds, a pair is settled by the intervals of one hierarchy: y stands
    on a chain that the way up from x runs through, no later than it leaves there. What lies on or below a cycle, and any
    taxonomy with several parents, is walked upwards from the asked x.
    """
    asked = cut(pairs.select("x", "y").dropna().distinct(), "asked").df
    own = asked.where("x = y")
    other = asked.where("x <> y")
    up = e.select(F.col("child").alias("x"), F.col("parent").alias("y"))
    if _several_parents(e):
        far = reach(up, other.select(F.col("x").alias("seed")).distinct()).select(F.col("seed").alias("x"), F.col("node").alias("y"))
        return own.unionByName(other.join(far, ["x", "y"], "left_semi"))
    h = hierarchy(e, "child", "parent")
    way = F.concat(F.array(F.struct("chain", F.col("pos").alias("upto"))).cast(SEGMENT), "segs")
    low = h.where("state = 'tree'").select(F.col("node").alias("x"), way.alias("way"))
    high = h.where("state = 'tree'").select(F.col("node").alias("y"), F.col("chain").alias("c"), F.col("pos").alias("p")).join(other.select("y").distinct(), "y", "left_semi")
    hit = other.join(low, "x").join(high, "y").where(F.exists("way", lambda s: (s["chain"] == F.col("c")) & (s["upto"] >= F.col("p")))).select("x", "y")
    stuck = h.where("state <> 'tree'").select(F.col("node").alias("x"))
    ringed = other.join(stuck, "x", "left_semi")
    far = reach(up.join(stuck, "x", "left_semi"), ringed.select(F.col("x").alias("seed")).distinct()).select(F.col("seed").alias("x"), F.col("node").alias("y"))
    return union_all([own, hit, ringed.join(far, ["x", "y"], "left_semi")])


def ancestor_counts(e: DataFrame, rels: tuple[str, ...] | None = ("subclass",)) -> DataFrame:
    """``node, n_ancestors``: how many nodes lie strictly above each that has any, over links of ``rels`` (None: all).

    In a tree that is the depth; only what lies on or below a cycle, or a taxonomy with several parents, needs its pairs.
    A node on a cycle is above itself.
    """
    some = e if rels is None else e.where(F.col("rel").isin(*rels))
    if _several_parents(some):
        return ancestors(some, None).groupBy(F.col("x").alias("node")).agg(F.count("*").alias("n_ancestors"))
    h = hierarchy(some, "child", "parent")
    stuck = h.where("state <> 'tree'").select(F.col("node").alias("child"))
    rest = ancestors(some.join(stuck, "child", "left_semi"), None).groupBy(F.col("x").alias("node")).agg(F.count("*").alias("n_ancestors"))
    return h.where("depth > 0").select("node", F.col("depth").alias("n_ancestors")).unionByName(rest)


def below(e: DataFrame, tops: list[str]) -> DataFrame:
    """``top, node``: all that reach one of ``tops`` over any link, itself included. One walk down from all tops at once."""
    down = e.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    seeds = e.sparkSession.createDataFrame([(t,) for t in dict.fromkeys(tops)], "seed string")
    return reach(down, seeds).select(F.col("seed").alias("top"), "node").unionByName(seeds.select(F.col("seed").alias("top"), F.col("seed").alias("node")))


def has_ancestor(e: DataFrame, top: str) -> DataFrame:
    """``node``: all that reach ``top`` over any link, itself included."""
    return below(e, [top]).select("node").distinct()


def marks(e: DataFrame, names: Names = Names()) -> DataFrame:
    """``node, tops``: which of the classes in ``names`` lie at or above each node that has any."""
    tops = [names.root, names.relation, names.predicate, names.function, *(c for c, _ in names.arities)]
    return cut(below(e, tops).groupBy("node").agg(F.collect_set("top").alias("tops")), "marks").df


def instances_of(e: DataFrame, cls: str) -> DataFrame:
    """``instance``: of the class or any subclass of it, distinct."""
    down = e.where("rel = 'subclass'").select(F.col("parent").alias("x"), F.col("child").alias("y"))
    seed = e.sparkSession.createDataFrame([(cls,)], "seed string")
    classes = reach(down, seed).select("node").unionByName(seed.select(F.col("seed").alias("node")))
    return e.where("rel = 'instance'").join(classes.select(F.col("node").alias("parent")), "parent", "left_semi").select(F.col("child").alias("instance")).distinct()


def nearest_ancestor(e: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """``node, ancestor, hops``: the closest of ``candidates`` (node) at or above each of ``nodes`` (node); ties by name."""
    up = e.select(F.col("child").alias("x"), F.col("parent").alias("y"))
    seeds = nodes.select(F.col("node").alias("seed"))
    far = reach(up, seeds).unionByName(seeds.distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops")))
    hit = far.join(candidates.select("node").distinct(), "node", "left_semi")
    best = hit.groupBy("seed").agg(F.min(F.struct("hops", "node")).alias("b"))
    return best.select(F.col("seed").alias("node"), F.col("b.node").alias("ancestor"), F.col("b.hops").alias("hops"))


def is_class(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, is_class, is_instance``: a class has only subclass links above it; no link at all counts as a class."""
    own = e.groupBy(F.col("child").alias("node")).agg(F.bool_and(F.coalesce("rel", F.lit("")) == "subclass").alias("c"))
    got = nodes.select("node").distinct().join(own, "node", "left").select("node", F.coalesce("c", F.lit(True)).alias("is_class"))
    return got.withColumn("is_instance", ~F.col("is_class"))


def kinds(e: DataFrame, nodes: DataFrame, names: Names = Names(), marked: DataFrame | None = None) -> DataFrame:
    """``node, is_class, is_relation, is_predicate, is_function, kinds``: instances below the relation classes."""
    out = is_class(e, nodes).join(marked if marked is not None else marks(e, names), "node", "left")
    for kind, top in (("relation", names.relation), ("predicate", names.predicate), ("function", names.function)):
        out = out.withColumn(f"is_{kind}", F.coalesce(F.array_contains("tops", top), F.lit(False)) & F.col("is_instance"))
    labels = [F.when(F.col(f"is_{k}"), k) for k in ("class", "function", "predicate", "relation", "instance")]
    return out.drop("tops").withColumn("kinds", F.array_compact(F.array(*labels)))


def arity(e: DataFrame, nodes: DataFrame, names: Names = Names(), marked: DataFrame | None = None) -> DataFrame:
    """``node, arity`` of relations: the first of the arity classes, in order, that lies above; a function has one less;
    -1 for variable arity; null for what is no relation."""
    marked = marked if marked is not None else marks(e, names)
    out = kinds(e, nodes, names, marked).select("node", "is_relation", "is_function").join(marked, "node", "left")
    value = F.lit(None).cast("int")
    for cls, n in reversed(names.arities):
        value = F.when(F.array_contains("tops", cls), n).otherwise(value)
    value = F.when(F.col("is_function") & (value > 0), value - 1).otherwise(value)
    return out.select("node", F.when(F.col("is_relation"), value).alias("arity"))


def argument_sorts(facts: DataFrame) -> DataFrame:
    """``rel, pos, class, is_subclass``: domains by position and ranges at 0, from facts (rel, args, sid, scope).

    The base's claim comes before a session's, then the smallest sid. A position claimed as both range and rangeSubclass
    is unknown: its class is null.
    """
    dom = facts.where(F.col("rel").isin("domain", "domainSubclass") & (F.size("args") == 3)).select(
        F.get("args", F.lit(0)).alias("r"), F.get("args", F.lit(1)).try_cast("int").alias("pos"), F.get("args", F.lit(2)).alias("class"), (F.col("rel") == "domainSubclass").alias("is_subclass"), "scope", "sid"
    )
    ran = facts.where(F.col("rel").isin("range", "rangeSubclass") & (F.size("args") == 2)).select(
        F.get("args", F.lit(0)).alias("r"), F.lit(0).alias("pos"), F.get("args", F.lit(1)).alias("class"), (F.col("rel") == "rangeSubclass").alias("is_subclass"), "scope", "sid"
    )
    first = F.min(F.struct((F.col("scope") != "base").alias("later"), "sid", "class", "is_subclass")).alias("b")
    both = dom.unionByName(ran).where("pos is not null")
    got = both.groupBy("r", "pos").agg(first, (F.bool_or("is_subclass") & F.bool_or(~F.col("is_subclass"))).alias("mixed"))
    unknown = F.col("mixed") & (F.col("pos") == 0)
    return got.select(F.col("r").alias("rel"), "pos", F.when(~unknown, F.col("b.class")).alias("class"), F.when(~unknown, F.col("b.is_subclass")).alias("is_subclass"))


def sort_annotations(sorts: DataFrame) -> DataFrame:
    """``rel, sorts``: a map from position to class for each relation; as many entries as it has places."""
    known = sorts.where("class is not null")
    return known.groupBy("rel").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pos", "class")))).alias("sorts"))


def evidence(e: DataFrame, facts: DataFrame, sorts: DataFrame) -> DataFrame:
    """``node, class``: what speaks for a symbol's classes: its instance links, instance facts, and the declared classes
    of the places it fills. Feed it to ``most_specific``."""
    links = e.where("rel = 'instance'").select(F.col("child").alias("node"), F.col("parent").alias("class"))
    told = facts.where((F.col("rel") == "instance") & (F.size("args") == 2)).select(F.get("args", F.lit(0)).alias("node"), F.get("args", F.lit(1)).alias("class"))
    places = facts.select("rel", F.posexplode("args").alias("i", "node")).select("rel", (F.col("i") + 1).alias("pos"), "node")
    filled = places.join(sorts.where("class is not null and not is_subclass"), ["rel", "pos"]).select("node", "class")
    return links.unionByName(told).unionByName(filled).distinct()


def disjoint_pairs(facts: DataFrame) -> DataFrame:
    """``a, b`` with a < b: declared disjoint, or parts of one partition or disjoint decomposition.

    The parts of one declaration are paired within its row, so the pairs are those the declaration states.
    """
    plain = facts.where("rel = 'disjoint'").where(F.size("args") == 2).select(F.get("args", F.lit(0)).alias("p"), F.get("args", F.lit(1)).alias("q"))
    parts = facts.where(F.col("rel").isin("partition", "disjointDecomposition")).select(F.slice("args", 2, 10_000_000).alias("m"))
    pairs = parts.select("m", F.posexplode("m").alias("i", "p")).select("p", F.explode(F.slice("m", F.col("i") + 2, F.greatest(F.size("m") - F.col("i") - 1, F.lit(0)))).alias("q"))
    return plain.unionByName(pairs).where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def denial_violations(e: DataFrame, pairs: DataFrame) -> DataFrame:
    """``node, a, b``: nodes at or below both classes of a disjoint pair. Only classes named in a pair are spread down."""
    down = e.select(F.col("parent").alias("x"), F.col("child").alias("y"))
    tops = pairs.select(F.col("a").alias("seed")).unionByName(pairs.select(F.col("b").alias("seed"))).distinct()
    under = reach(down, tops).select("seed", "node").unionByName(tops.select("seed", F.col("seed").alias("node")))
    left = pairs.join(under.select(F.col("seed").alias("a"), "node"), "a")
    return left.join(under.select(F.col("seed").alias("b"), "node"), ["b", "node"]).select("node", "a", "b")


def refuted(e: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``asked`` (instance, class) that can't be, with the disjoint pair that says so: ``instance, class, a, b``.

    Something at or above the instance and something at or above the class are disjoint. Only the asked are walked up.
    """
    up = e.select(F.col("child").alias("x"), F.col("parent").alias("y"))
    q = asked.select("instance", "class").dropna().distinct()
    seeds = q.select(F.col("instance").alias("seed")).union(q.select("class")).distinct()
    over = cut(reach(up, seeds).select("seed", "node").unionByName(seeds.select("seed", F.col("seed").alias("node"))), "over").df
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left = q.join(over.select(F.col("seed").alias("instance"), F.col("node").alias("a")), "instance").join(both, "a")
    hit = left.join(over.select(F.col("seed").alias("class"), F.col("node").alias("b")), ["class", "b"])
    first = hit.groupBy("instance", "class").agg(F.min(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("p"))
    return first.select("instance", "class", "p.a", "p.b")


def holds(e: DataFrame, facts: DataFrame, asked: DataFrame) -> DataFrame:
    """``rel, x, y, holds`` of the ``asked`` (rel, x, y): stored as a fact of the relation or of one below it, equal by
    reflexivity, or, for instance, subclass and subrelation, a way up in the taxonomy. False says unknown, not denied."""
    q = cut(asked.select("rel", "x", "y").distinct(), "asked").df
    f = facts.where(F.size("args") == 2).select(F.col("rel").alias("told"), F.get("args", F.lit(0)).alias("x"), F.get("args", F.lit(1)).alias("y"))
    under = reach(e.where("rel = 'subrelation'").select(F.col("parent").alias("x"), F.col("child").alias("y")), q.select(F.col("rel").alias("seed")).distinct())
    names = q.select("rel", F.col("rel").alias("told")).distinct().unionByName(under.select(F.col("seed").alias("rel"), F.col("node").alias("told")))
    stored = q.join(names, "rel").join(f, ["told", "x", "y"], "left_semi").select("rel", "x", "y")
    ways = q.where("rel in ('instance', 'subclass', 'subrelation') and x <> y")
    up = ways.join(reaches(e, ways.select("x", "y")), ["x", "y"], "left_semi").select("rel", "x", "y")
    same = q.where("rel in ('equal', 'subclass', 'subrelation') and x = y")
    yes = stored.unionByName(up).unionByName(same).distinct().withColumn("yes", F.lit(True))
    return q.join(yes, ["rel", "x", "y"], "left").select("rel", "x", "y", F.coalesce("yes", F.lit(False)).alias("holds"))


def closure_facts(e: DataFrame, facts: DataFrame, seeds: DataFrame, cap: int = 10_000) -> DataFrame:
    """``sid, hops``: the subclass and instance facts along the ways up from ``seeds`` (seed), nearest first; of more than
    ``cap`` those farthest from the seeds are left out."""
    links = e.where(F.col("rel").isin("subclass", "instance"))
    met = reach(links.select(F.col("child").alias("x"), F.col("parent").alias("y")), seeds).groupBy("node").agg(F.min("hops").alias("hops"))
    met = met.unionByName(seeds.select(F.col("seed").alias("node"), F.lit(0).alias("hops"))).groupBy("node").agg(F.min("hops").alias("hops"))
    f = facts.where(F.col("rel").isin("subclass", "instance") & (F.size("args") == 2)).select("rel", F.get("args", F.lit(0)).alias("child"), F.get("args", F.lit(1)).alias("parent"), "sid")
    rows = links.join(met.withColumnRenamed("node", "child"), "child").join(f, ["rel", "child", "parent"])
    return rows.groupBy("sid").agg(F.min("hops").alias("hops")).orderBy("hops", "sid").limit(cap)


def only_case_left(cases: DataFrame, excluded: DataFrame) -> DataFrame:
    """``node, class``: of each exhaustive decomposition of a node's class, the one case that isn't ``excluded``.

    ``cases`` is (node, decomposition, class), ``excluded`` (node, class).
    """
    left = cases.distinct().join(excluded.select("node", "class").distinct(), ["node", "class"], "left_anti")
    one = left.groupBy("node", "decomposition").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    return one.select("node", "class").distinct()


def most_specific(e: DataFrame, member: DataFrame) -> DataFrame:
    """``node, kind, classes``: the classes of ``member`` (node, class) without those above another of the same node.

    Classes on a cycle cancel one another; nothing left is ``Unknown``, one ``Single``, more ``Multiple``.
    """
    m = member.dropna().distinct()
    above = ancestors(e).select(F.col("x").alias("low"), F.col("y").alias("class"))
    beaten = m.select("node", F.col("class").alias("low")).join(above, "low").select("node", "class").distinct()
    kept = m.join(beaten, ["node", "class"], "left_anti").groupBy("node").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    got = m.select("node").distinct().join(kept, "node", "left").withColumn("classes", F.coalesce("classes", F.array().cast("array<string>")))
    kind = F.when(F.size("classes") == 0, "Unknown").when(F.size("classes") == 1, "Single").otherwise("Multiple")
    return got.select("node", kind.alias("kind"), "classes")


def ranked_parents(e: DataFrame) -> DataFrame:
    """Direct links both ways, for a man page: ``node, side, other, rel`` in order of name within a side."""
    up = e.select(F.col("child").alias("node"), F.lit("parent").alias("side"), F.col("parent").alias("other"), "rel")
    down = e.select(F.col("parent").alias("node"), F.lit("child").alias("side"), F.col("child").alias("other"), "rel")
    return up.unionByName(down)
