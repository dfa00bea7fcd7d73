"""From axioms to rule programs: Horn rules, existential rules, equality rules, schema rules, and what may be denied.

Axioms are few next to facts and are planned on the driver; facts stay in frames.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.datalog import COMPARISONS, Atom, Literal, Program, ProgramError, Rule, dependencies, evaluate, fire
from axiomill.plans.skew import union_all
from axiomill.sources.kif import Node, axioms, fold_arithmetic


@dataclass(frozen=True)
class Existential:
    """body -> exists witnesses: heads."""

    heads: tuple[Atom, ...]
    body: tuple[Literal, ...]
    witnesses: tuple[str, ...]
    sid: str = ""


@dataclass(frozen=True)
class Equality:
    """Two values of one relation under the same key are the same; ``guards`` are (place, class) asked of stored instances."""

    pred: str
    width: int
    key: tuple[int, ...]
    value: int
    guards: tuple[tuple[int, str], ...] = ()


@dataclass
class Extracted:
    program: Program = field(default_factory=Program)
    existential: list[Existential] = field(default_factory=list)
    equality: list[Equality] = field(default_factory=list)
    facts: list[Atom] = field(default_factory=list)
    skipped: list[Node] = field(default_factory=list)


def atom(n: Node) -> Atom | None:
    """A flat atom, or None."""
    if n.kind != "list" or not n.items or n.items[0].kind != "symbol" or any(x.kind in ("list", "op", "row") for x in n.items[1:]):
        return None
    return Atom(n.items[0].val, tuple(x.val for x in n.items[1:]))


def literal(n: Node) -> Literal | None:
    if n.head == "not" and len(n.items) == 2:
        a = atom(n.items[1])
        return Literal(a, True) if a else None
    a = atom(n)
    return Literal(a) if a else None


def _body(n: Node) -> tuple[Literal, ...] | None:
    parts = n.items[1:] if n.head == "and" else (n,)
    got = [literal(x) for x in parts]
    return tuple(got) if all(got) else None


def extract(nodes: Iterable[Node]) -> Extracted:
    """Sort statements into what the evaluator can run; the rest is listed as skipped."""
    out = Extracted()
    for k, n in enumerate(y for x in nodes for y in axioms(fold_arithmetic(x))):
        sid = f"r{k}"
        a = atom(n)
        if a is not None and not a.vars:
            out.facts.append(a)
            if a.pred == "instance" and a.args[1:] == ("SingleValuedRelation",):
                out.equality.append(Equality(a.args[0], 2, (0,), 1))
            continue
        if n.head == "=>" and len(n.items) == 3:
            body, right = _body(n.items[1]), n.items[2]
            head = atom(right)
            if body and head and head.pred not in COMPARISONS:
                out.program.rules.append(Rule(head, body, sid))
                continue
            e = _equality(body, right)
            if e:
                out.equality.append(e)
                continue
            if body and right.head == "exists" and not any(b.negated for b in body):
                parts = right.items[2].items[1:] if right.items[2].head == "and" else (right.items[2],)
                heads = [atom(x) for x in parts]
                if all(heads):
                    out.existential.append(Existential(tuple(heads), body, tuple(v.val for v in right.items[1].items), sid))
                    continue
        out.skipped.append(n)
    return out


def _equality(body: tuple[Literal, ...] | None, right: Node) -> Equality | None:
    """(=> (and (r ?k ?x) (r ?k ?y) guards...) (equal ?x ?y))."""
    if not body or right.head != "equal" or any(x.kind != "variable" for x in right.items[1:]):
        return None
    x, y = (v.val for v in right.items[1:])
    guards = [b.atom for b in body if b.atom.pred == "instance" and len(b.atom.args) == 2 and not b.atom.args[1].startswith("?")]
    main = [b.atom for b in body if b.atom not in guards]
    if len(main) != 2 or any(b.negated for b in body) or main[0].pred != main[1].pred or len(main[0].args) != len(main[1].args):
        return None
    a, b = main
    differ = [i for i in range(len(a.args)) if a.args[i] != b.args[i]]
    if len(differ) != 1 or {a.args[differ[0]], b.args[differ[0]]} != {x, y}:
        return None
    key = tuple(i for i in range(len(a.args)) if i != differ[0])
    at = {v: i for i, v in enumerate(a.args)} | {b.args[differ[0]]: differ[0]}
    return Equality(a.pred, len(a.args), key, differ[0], tuple(sorted({(at[g.args[0]], g.args[1]) for g in guards if g.args[0] in at})))


def schema_rules(facts: Iterable[Atom]) -> list[Rule]:
    """Rules that declarations stand for: subrelation, transitive and symmetric relations."""
    out = []
    for a in facts:
        if a.pred == "subrelation" and len(a.args) == 2:
            v = ("?A", "?B")
            out.append(Rule(Atom(a.args[1], v), (Literal(Atom(a.args[0], v)),), f"sub:{a.args[0]}"))
        if a.pred == "instance" and a.args[1:] == ("TransitiveRelation",):
            r = a.args[0]
            out.append(Rule(Atom(r, ("?A", "?C")), (Literal(Atom(r, ("?A", "?B"))), Literal(Atom(r, ("?B", "?C")))), f"trans:{r}"))
        if a.pred == "instance" and a.args[1:] == ("SymmetricRelation",):
            r = a.args[0]
            out.append(Rule(Atom(r, ("?A", "?B")), (Literal(Atom(r, ("?B", "?A"))),), f"sym:{r}"))
    return out


def shape(r: Rule) -> str | None:
    """transitive, symmetric, subrelation or None, by what the rule looks like."""
    b = [x.atom for x in r.body if not x.negated]
    if len(b) != len(r.body) or len(r.head.args) != 2 or any(not a.startswith("?") for x in (*b, r.head) for a in x.args):
        return None
    if len(b) == 2 and b[0].pred == b[1].pred == r.head.pred and len(b[0].args) == len(b[1].args) == 2:
        x, y = r.head.args
        if any(p.args[0] == x and q.args[1] == y and p.args[1] == q.args[0] for p, q in (b, b[::-1])):
            return "transitive"
    if len(b) == 1 and len(b[0].args) == 2:
        if b[0].pred == r.head.pred and b[0].args == r.head.args[::-1]:
            return "symmetric"
        if b[0].pred != r.head.pred and b[0].args == r.head.args:
            return "subrelation"
    return None


# --- equality ---------------------------------------------------------------------------------------------------------


def equal_pairs(e: Equality, rows: DataFrame, instances: DataFrame | None = None) -> DataFrame:
    """``(x, y)``: each value with the least of its key's values; so a key with many values gives a star, not all pairs."""
    for at, cls in e.guards:
        if instances is None:
            return rows.sparkSession.createDataFrame([], "x string, y string")
        rows = rows.join(instances.where(F.col("a1") == cls).select(F.col("a0").alias(f"a{at}")), f"a{at}", "left_semi")
    key = [f"a{i}" for i in e.key]
    low = rows.groupBy(*key).agg(F.min(f"a{e.value}").alias("x"), F.max(f"a{e.value}").alias("hi")).where("x <> hi").drop("hi")
    return rows.select(*key, F.col(f"a{e.value}").alias("y")).join(low, key).where("x <> y").select("x", "y").distinct()


def representatives(pairs: DataFrame) -> DataFrame:
    """``(node, rep)`` of merged values. Two different numbers in one class contradict each other: an error."""
    from axiomill.operators.closure import components

    c = cut(components(pairs).select("node", F.col("component").alias("rep")), "merged").df
    number = F.col("node").try_cast("double")
    clash = c.groupBy("rep").agg(F.min(number).alias("lo"), F.max(number).alias("hi")).where("lo <> hi").first()
    if clash is not None:
        raise ProgramError(f"two different numbers are made equal: {clash['lo']} and {clash['hi']}")
    return c


def rewrite(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Tuples with every value replaced by its representative."""
    for c in rows.columns:
        r = reps.select(F.col("node").alias(c), F.col("rep").alias("_rep"))
        rows = rows.join(r, c, "left").withColumn(c, F.coalesce("_rep", c)).drop("_rep")
    return rows.distinct()


def evaluate_with_equality(spark, p: Program, facts: dict[str, DataFrame], rules: list[Equality], max_merges: int = 1000):
    """(model, merged): fixpoints and merges in turn until nothing more is made equal. Refused with negation in play; an
    error where ``max_merges`` turns don't suffice."""
    if any(b.negated for r in p.rules for b in r.body):
        raise ProgramError("equality rules need a program without negation")
    held = dict(facts)
    all_pairs: DataFrame | None = None
    for _ in range(max_merges):
        model = held | evaluate(spark, p, held)
        found = [equal_pairs(e, model[e.pred], model.get("instance")) for e in rules if e.pred in model]
        pairs = cut(union_all(found).distinct(), "equal", n=F.count("*")) if found else None
        if pairs is None or not pairs.seen["n"]:
            break
        all_pairs = pairs.df if all_pairs is None else all_pairs.unionByName(pairs.df)
        reps = representatives(all_pairs)
        held = {q: cut(rewrite(d.select(*[c for c in d.columns if c.startswith("a")]), reps), "merged").df for q, d in held.items()}
    else:
        raise ProgramError(f"values are still made equal after {max_merges} turns")
    merged = representatives(all_pairs) if all_pairs is not None else spark.createDataFrame([], "node string, rep string")
    return model, merged


def decide_equal(reps: DataFrame, asked: DataFrame) -> DataFrame:
    """``x, y, verdict`` of the ``asked`` (x, y): entailed where one value or one class, refuted where their classes hold
    different numbers, else unknown."""
    number = F.col("node").try_cast("double")
    valued = reps.groupBy("rep").agg(F.max(number).alias("v"))
    side = lambda c: reps.select(F.col("node").alias(c), F.col("rep").alias(f"r{c}"))
    rows = asked.select("x", "y").distinct().join(side("x"), "x", "left").join(side("y"), "y", "left").withColumns({"rx": F.coalesce("rx", "x"), "ry": F.coalesce("ry", "y")})
    for c in ("rx", "ry"):
        rows = rows.join(valued.select(F.col("rep").alias(c), F.col("v").alias(f"v{c}")), c, "left").withColumn(f"v{c}", F.coalesce(f"v{c}", F.col(c).try_cast("double")))
    same = (F.col("rx") == F.col("ry")) | (F.col("vrx") == F.col("vry"))
    return rows.select("x", "y", F.when(F.coalesce(same, F.lit(False)), "entailed").when(F.col("vrx") != F.col("vry"), "refuted").otherwise("unknown").alias("verdict"))


def explain_equal(pairs: DataFrame, x: str, y: str) -> list[tuple[str, str]]:
    """The links of ``pairs`` (x, y, ...) that make two values equal, a shortest chain of them; empty where nothing does."""
    from axiomill.operators.introspect import witness_path

    links = pairs.select("x", "y", F.lit(None).cast("bigint").alias("sid"))
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"), "sid"))
    return [(a, b) for a, b, _ in witness_path(both, x, y)]


def fd_violations(e: Equality, rows: DataFrame) -> DataFrame:
    """Keys of a functional relation with several values: the key's columns and ``n``, the number of distinct values."""
    key = [f"a{i}" for i in e.key]
    return rows.select(*key, f"a{e.value}").distinct().groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def list_members(terms: DataFrame) -> DataFrame:
    """``list, member, at`` of list terms (list, items array<string>), places from 1; repeats keep their first place."""
    rows = terms.select("list", F.posexplode("items").alias("i", "member")).dropna(subset=["member"])
    return rows.groupBy("list", "member").agg((F.min("i") + 1).alias("at"))


def without_true_negatives(literals: DataFrame, model: DataFrame) -> DataFrame:
    """Literals (clause, atom, positive) without the positive ones whose ``atom`` the complete ``model`` (atom) lacks and
    the negative ones it has; a clause that loses all of them is gone from the rows."""
    held = literals.join(model.select("atom").distinct().withColumn("there", F.lit(True)), "atom", "left")
    return held.where(F.coalesce("there", F.lit(False)) == F.col("positive")).select("clause", "atom", "positive")


def shared_leaves(clauses: DataFrame, conjecture: list[str]) -> DataFrame:
    """``clause, shared``: how many distinct ground leaves a clause (clause, leaves array<string>) has in common with the
    conjecture's."""
    return clauses.select("clause", F.size(F.array_intersect("leaves", F.array(*map(F.lit, conjecture)).cast("array<string>"))).alias("shared"))


# --- chase ------------------------------------------------------------------------------------------------------------


class Chased(dict):
    """A model by predicate; ``complete`` is False where firings were left out."""

    complete = True


def _served(rows: DataFrame, cols: dict[str, str], t: Existential, model: dict[str, DataFrame]) -> DataFrame | None:
    """The firings whose heads some stored tuples fulfil already, constants and repeated variables included; None if none can."""
    left, groups = list(t.heads), []
    while left:
        group = [left.pop(0)]
        # heads that share a witness must be served together
        while more := [a for a in left if any(a.vars & b.vars & set(t.witnesses) for b in group)]:
            group += more
            left = [a for a in left if a not in more]
        groups.append(group)
    for group in groups:
        if any(a.pred not in model for a in group):
            return None
        names = sorted({v for a in group for v in a.vars} - set(t.witnesses))
        got = fire(Rule(Atom("served", tuple(names) or ("yes",)), tuple(Literal(a) for a in group)), model)
        rows = rows.join(got.toDF(*[cols[v] for v in names]), [cols[v] for v in names], "left_semi") if names else rows.join(got.limit(1), F.lit(True), "left_semi")
    return rows


def chase(spark, ex: Extracted, facts: dict[str, DataFrame], rounds: int = 2, max_firings: int | None = None) -> Chased:
    """The model with witnesses for existential rules, in a bounded number of rounds.

    A witness is named by its rule and the values it depends on, so firing again makes nothing new. A rule fires only
    where stored tuples don't serve all its heads already. ``max_firings`` bounds the firings of one rule in a round, the
    first by value; where it bites the result's ``complete`` is False.
    """
    held, complete = dict(facts), True
    for _ in range(rounds):
        model = held | evaluate(spark, ex.program, held)
        grown = False
        for t in ex.existential:
            names = {b.atom.pred: b.atom for b in t.body}
            if any(q not in model for q in names):
                continue
            shared = sorted({v for a in t.heads for v in a.vars} - set(t.witnesses))
            cols = {v: f"a{i}" for i, v in enumerate(shared)}
            rows = fire(Rule(Atom("fire", tuple(shared) or ("yes",)), t.body), model)
            served = _served(rows, cols, t, model)
            if served is not None:
                rows = rows.join(served, rows.columns, "left_anti")
            if max_firings is not None:
                rows = rows.orderBy(*rows.columns).limit(max_firings + 1)
            rows = cut(rows, "firings", n=F.count("*"))
            if not rows.seen["n"]:
                continue
            fired = rows.df
            if max_firings is not None and rows.seen["n"] > max_firings:
                complete, fired = False, fired.orderBy(*fired.columns).limit(max_firings)
            grown = True
            key = F.concat_ws("|", *[F.col(c) for c in cols.values()]) if cols else F.lit("")
            for a in t.heads:
                value = lambda x: F.col(cols[x]) if x in cols else F.concat(F.lit(f"_w{t.sid}_{x[1:]}_"), key) if x in t.witnesses else F.lit(x)  # noqa: E731, B023
                made = fired.select(*[value(x).alias(f"a{i}") for i, x in enumerate(a.args)])
                held[a.pred] = made if a.pred not in held else held[a.pred].unionByName(made).distinct()
        if not grown:
            break
    out = Chased(held | evaluate(spark, ex.program, held))
    out.complete = complete
    return out


# --- negative answers -------------------------------------------------------------------------------------------------


def certify(p: Program, skipped: Iterable[Node] = (), existential: Iterable[Existential] = ()) -> set[str]:
    """Derived predicates whose model is complete: nothing skipped, existential or uncertified can add to them."""
    open_ = {x.val for n in skipped for x in _symbols(n)} | {a.pred for t in existential for a in t.heads}
    by: dict[str, set[str]] = defaultdict(set)
    for q, deps in dependencies(p).items():
        by[q] = {d for d, _ in deps}
    good = p.derived - open_
    while True:
        bad = {q for q in good if any(d in open_ or (d in p.derived and d not in good) for d in by[q])}
        if not bad:
            return good
        good -= bad


def _symbols(n: Node) -> list[Node]:
    return [n] if n.kind == "symbol" else [y for x in n.items for y in _symbols(x)]


def absent(model: DataFrame, candidates: DataFrame, pred: str, certified: set[str]) -> DataFrame:
    """Candidates that are false: missing from a complete model. Refused for a predicate that isn't certified."""
    if pred not in certified:
        raise ProgramError(f"{pred} isn't certified: absence says nothing")
    return candidates.join(model.select(*candidates.columns), candidates.columns, "left_anti")
