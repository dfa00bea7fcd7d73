"""Rule programs (Datalog with stratified negation) planned on the driver and run as DataFrame joins.

Rules are few and live in Python; facts are frames with columns a0, a1, ... One round of a stratum is one Catalyst plan
per rule and changed literal; a round's new facts are written once and joined in the next.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from axiomill.plans.cut import cut
from axiomill.plans.skew import union_all

COMPARISONS = {"greaterThan": ">", "lessThan": "<", "greaterThanOrEqualTo": ">=", "lessThanOrEqualTo": "<="}


class ProgramError(ValueError):
    """The program cannot be evaluated as it stands."""


@dataclass(frozen=True)
class Atom:
    pred: str
    args: tuple[str, ...]

    @property
    def vars(self) -> set[str]:
        return {a for a in self.args if a.startswith("?")}

    def __str__(self) -> str:
        return f"{self.pred}({', '.join(self.args)})"


@dataclass(frozen=True)
class Literal:
    atom: Atom
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Literal, ...]
    sid: str = ""


@dataclass
class Program:
    rules: list[Rule] = field(default_factory=list)

    @property
    def derived(self) -> set[str]:
        return {r.head.pred for r in self.rules}


_ATOM = re.compile(r"\s*(not\s+)?([A-Za-z_][\w@#-]*)\s*\(([^()]*)\)\s*")


def parse(text: str) -> Program:
    """Rules such as ``anc(?X, ?Z) :- edge(?X, ?Y), anc(?Y, ?Z).``; ``not`` negates, ``?`` marks variables, % comments."""
    rules = []
    for n, line in enumerate(re.sub(r"%[^\n]*", "", text).split(".\n" if ".\n" in text else ".")):
        line = line.strip().rstrip(".")
        if not line:
            continue
        head, _, body = line.partition(":-")

        def atoms(part: str) -> list[Literal]:
            out, at = [], 0
            while at < len(part):
                m = _ATOM.match(part, at)
                if not m:
                    raise ProgramError(f"cannot read {part[at:]!r}")
                args = tuple(a.strip() for a in m[3].split(",")) if m[3].strip() else ()
                out.append(Literal(Atom(m[2], args), bool(m[1])))
                at = m.end() + (part[m.end() : m.end() + 1] == ",")
            return out

        rules.append(Rule(atoms(head)[0].atom, tuple(atoms(body)) if body.strip() else (), f"r{n}"))
    return Program(rules)


def check_safety(p: Program) -> None:
    """Every variable of a head, a negated literal or a comparison must stand in a positive literal of the body."""
    for r in p.rules:
        bound = {v for b in r.body if not b.negated and b.atom.pred not in COMPARISONS for v in b.atom.vars}
        need = set(r.head.vars) | {v for b in r.body if b.negated or b.atom.pred in COMPARISONS for v in b.atom.vars}
        if need - bound:
            raise ProgramError(f"unsafe: {sorted(need - bound)} in rule for {r.head}")


def dependencies(p: Program) -> dict[str, set[tuple[str, bool]]]:
    out: dict[str, set[tuple[str, bool]]] = defaultdict(set)
    for r in p.rules:
        out[r.head.pred] |= {(b.atom.pred, b.negated) for b in r.body}
    return out


def components_of(p: Program) -> list[set[str]]:
    """Strongly connected predicates, callees first (Tarjan, without recursion)."""
    graph = {k: sorted(q for q, _ in v) for k, v in dependencies(p).items()}
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    out: list[set[str]] = []
    for root in sorted(graph):
        work = [(root, iter(graph.get(root, ())))] if root not in index else []
        if work:
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(graph.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = set()
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        part.add(w)
                        if w == v:
                            break
                    out.append(part)
    return out


def stratify(p: Program) -> list[set[str]]:
    """Strata of derived predicates in order; a negation inside a cycle makes the program unstratifiable."""
    deps, strata = dependencies(p), []
    for part in components_of(p):
        if any(neg and q in part for v in part for q, neg in deps.get(v, ())):
            raise ProgramError(f"unstratifiable: negation within {sorted(part)}")
        if part & p.derived:
            strata.append(part & p.derived)
    return strata


def cone(p: Program, goal: str) -> Program:
    """The rules that the goal predicate depends on."""
    deps, want, todo = dependencies(p), {goal}, [goal]
    while todo:
        for q, _ in deps.get(todo.pop(), ()):
            if q not in want:
                want.add(q)
                todo.append(q)
    return Program([r for r in p.rules if r.head.pred in want])


def positive(p: Program) -> Program:
    """Without the rules that use negation."""
    return Program([r for r in p.rules if not any(b.negated for b in r.body)])


def magic(p: Program, goal: Atom) -> tuple[Program, Atom, Atom | None]:
    """Magic-set rewriting for a goal with constants: (program, goal of it, seed fact).

    Rules are adorned from the goal; in a body the literal with most bound places goes next. Negated derived predicates
    are kept whole, with their own cones.
    """
    check_safety(p)
    derived, by = p.derived, defaultdict(list)
    for r in p.rules:
        by[r.head.pred].append(r)
    adorn = "".join("f" if a.startswith("?") else "b" for a in goal.args)
    if goal.pred not in derived:
        return Program([]), goal, None
    name = lambda q, a: f"{q}@{a}"
    bound_args = lambda atom, a: tuple(x for x, k in zip(atom.args, a) if k == "b")
    out: list[Rule] = []
    plain: set[str] = set()
    todo, seen = [(goal.pred, adorn)], {(goal.pred, adorn)}
    while todo:
        pred, a = todo.pop()
        for r in by[pred]:
            guard = Literal(Atom("m#" + name(pred, a), bound_args(r.head, a)))
            known = set(guard.atom.vars)
            done: list[Literal] = [guard]
            left = list(r.body)
            while left:
                ready = [b for b in left if not (b.negated or b.atom.pred in COMPARISONS) or b.atom.vars <= known]
                nxt = max(ready, key=lambda b: (b.atom.vars <= known, sum(x in known or not x.startswith("?") for x in b.atom.args), -left.index(b)))
                left.remove(nxt)
                atom = nxt.atom
                if atom.pred in derived and not nxt.negated:
                    ad = "".join("b" if not x.startswith("?") or x in known else "f" for x in atom.args)
                    m = Rule(Atom("m#" + name(atom.pred, ad), bound_args(atom, ad)), tuple(done), "")
                    if m.body != (Literal(m.head),):
                        out.append(m)
                    if (atom.pred, ad) not in seen:
                        seen.add((atom.pred, ad))
                        todo.append((atom.pred, ad))
                    done.append(Literal(replace(atom, pred=name(atom.pred, ad))))
                else:
                    if atom.pred in derived:
                        plain.add(atom.pred)
                    done.append(nxt)
                if not nxt.negated:
                    known |= atom.vars
            out.append(Rule(replace(r.head, pred=name(pred, a)), tuple(done), r.sid))
    for q in plain:
        out += [r for r in cone(p, q).rules if r not in out]
    return Program(out), replace(goal, pred=name(goal.pred, adorn)), Atom("m#" + name(goal.pred, adorn), bound_args(goal, adorn))


def _columns(n: int) -> list[str]:
    return [f"a{i}" for i in range(n)]


def bind(df: DataFrame, atom: Atom) -> DataFrame:
    """A fact frame as a frame of the atom's variables: constants and repeated variables are filters."""
    cond, first = None, {}
    for i, a in enumerate(atom.args):
        c = F.col(f"a{i}") == a if not a.startswith("?") else F.col(f"a{i}") == F.col(first[a]) if a in first else None
        if a.startswith("?"):
            first.setdefault(a, f"a{i}")
        if c is not None:
            cond = c if cond is None else cond & c
    rows = df if cond is None else df.where(cond)
    return rows.select(*[F.col(c).alias(v) for v, c in first.items()]) if first else rows.select(F.lit(True).alias("?")).limit(1)


def _body(r: Rule, frames: dict[str, DataFrame], delta: int | None, deltas: dict[str, DataFrame], most: int | None) -> DataFrame:
    """The joined body: the changed literal first, literals sharing variables next, comparisons and negations last.

    Literals without a shared variable are a product: refused without ``most``, and beyond so many rows with it, which are
    counted before the product is made.
    """
    pos = [(i, b.atom) for i, b in enumerate(r.body) if not b.negated and b.atom.pred not in COMPARISONS]
    pos.sort(key=lambda x: x[0] != delta)
    out: DataFrame | None = None
    while pos:
        nxt = next((x for x in pos if out is None or set(out.columns) & x[1].vars), pos[0])
        pos.remove(nxt)
        i, atom = nxt
        rows = bind(deltas[atom.pred] if i == delta else frames[atom.pred], atom)
        if out is None:
            out = rows
        else:
            on = sorted(set(out.columns) & set(rows.columns))
            if not on and atom.vars and set(out.columns) != {"?"}:
                if most is None:
                    raise ProgramError(f"{r.head}: literals without a shared variable are a product; give max_tuples to allow it")
                if out.limit(most + 1).count() * rows.limit(most + 1).count() > most:
                    raise ProgramError(f"overflow: a product of more than {most} tuples")
            out = out.join(rows, on) if on else out.join(rows, how="cross")
    for b in r.body:
        if b.atom.pred in COMPARISONS:
            x, y = (F.col(a).try_cast("double") if a.startswith("?") else F.lit(a).try_cast("double") for a in b.atom.args)
            test = {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y}[COMPARISONS[b.atom.pred]]
            out = out.where(~test if b.negated else test)
    for b in r.body:
        if b.negated and b.atom.pred not in COMPARISONS:
            gone = bind(frames[b.atom.pred], b.atom).distinct()
            on = sorted(b.atom.vars)
            out = out.join(gone, on, "left_anti") if on else out.join(gone, how="left_anti")
    return out


def fire(r: Rule, frames: dict[str, DataFrame], delta: int | None = None, deltas: dict[str, DataFrame] | None = None, cite: bool = False, most: int | None = None) -> DataFrame:
    """Head tuples of one rule; with ``cite`` also the rule's sid and the facts it used. Literals that share no variable
    are refused unless ``most`` allows so many rows of them."""
    body = _body(r, frames, delta, deltas or {}, most)
    value = lambda a: F.col(a) if a.startswith("?") else F.lit(a)
    cols = [value(a).alias(f"a{i}") for i, a in enumerate(r.head.args)]
    if not cite:
        return body.select(*cols).distinct()
    used = [F.struct(F.lit(b.atom.pred).alias("pred"), F.array(*[value(a) for a in b.atom.args]).alias("args")) for b in r.body if not b.negated and b.atom.pred not in COMPARISONS]
    return body.select(*cols, F.lit(r.sid).alias("rule"), F.array(*used).alias("parents"))


def evaluate(spark: SparkSession, p: Program, facts: dict[str, DataFrame], max_tuples: int | None = None, max_rounds: int = 10_000, cite: bool = False) -> dict[str, DataFrame]:
    """The model: every derived predicate's tuples (a0, a1, ...), distinct, by semi-naive rounds per stratum.

    ``facts`` holds the stored tuples by predicate. ``max_tuples`` raises an overflow once more are derived, and
    only with it may a rule join literals that share no variable. With ``cite``
    a tuple also carries ``rule`` and ``parents`` of its first derivation (least round, rule and parents), null for stored
    facts. Null arguments never match, as null equals nothing.
    """
    check_safety(p)
    strata = stratify(p)
    width = {b.atom.pred: len(b.atom.args) for r in p.rules for b in r.body} | {r.head.pred: len(r.head.args) for r in p.rules}
    empty = lambda n: spark.createDataFrame([], ", ".join(f"{c} string" for c in _columns(n)) or "a0 string")
    frames = {q: facts[q] if q in facts else empty(n) for q, n in width.items() if q not in COMPARISONS}
    frames |= {q: d for q, d in facts.items() if q not in frames}
    extra = "rule string, parents array<struct<pred:string,args:array<string>>>"
    proofs: dict[str, DataFrame] = {}
    derived = 0

    def new_of(q: str, parts: list[DataFrame]) -> DataFrame:
        cols = _columns(width[q])
        rows = union_all(parts)
        if cite:
            rows = rows.groupBy(*cols).agg(F.min(F.struct("rule", "parents")).alias("d")).select(*cols, "d.rule", "d.parents")
        else:
            rows = rows.distinct()
        return rows.join(frames[q].select(*cols), cols, "left_anti") if cols else rows

    for stratum in strata:
        rules = [r for r in p.rules if r.head.pred in stratum]
        if cite:
            for q in stratum:
                proofs[q] = frames[q].selectExpr(*_columns(width[q]), "cast(null as string) as rule", "cast(null as array<struct<pred:string,args:array<string>>>) as parents")
        deltas: dict[str, DataFrame] = {}
        for k in range(max_rounds):
            parts: dict[str, list[DataFrame]] = defaultdict(list)
            for r in rules:
                if k == 0:
                    if r.body:
                        parts[r.head.pred].append(fire(r, frames, cite=cite, most=max_tuples))
                    else:
                        row = spark.createDataFrame([r.head.args], ", ".join(f"{c} string" for c in _columns(len(r.head.args))))
                        parts[r.head.pred].append(row.selectExpr("*", f"'{r.sid}' as rule", f"cast(array() as {extra.split('parents ')[1]}) as parents") if cite else row)
                    continue
                for i, b in enumerate(r.body):
                    if not b.negated and b.atom.pred in deltas:
                        parts[r.head.pred].append(fire(r, frames, i, deltas, cite, max_tuples))
            found = {}
            for q, ps in parts.items():
                c = cut(new_of(q, ps), "delta", n=F.count("*"))
                if c.seen["n"]:
                    derived += c.seen["n"]
                    found[q] = c.df
            if max_tuples is not None and derived > max_tuples:
                raise ProgramError(f"overflow: more than {max_tuples} tuples")
            if not found:
                break
            deltas = {q: d.select(*_columns(width[q])) for q, d in found.items()}
            for q, d in found.items():
                frames[q] = frames[q].select(*_columns(width[q])).unionByName(deltas[q])
                if k % 8 == 7:
                    frames[q] = cut(frames[q], "total").df
                if cite:
                    proofs[q] = proofs[q].unionByName(d)
        else:
            raise ProgramError(f"no fixpoint after {max_rounds} rounds")
    return {q: proofs[q] if cite else frames[q] for q in p.derived}


def answer(spark: SparkSession, p: Program, facts: dict[str, DataFrame], goal: Atom, max_tuples: int | None = None) -> DataFrame:
    """The goal's tuples: with constants by magic sets, else from the goal's cone."""
    if goal.pred not in p.derived:
        return bind(facts[goal.pred], goal)
    if not any(not a.startswith("?") for a in goal.args):
        return bind(evaluate(spark, cone(p, goal.pred), facts, max_tuples)[goal.pred], goal)
    rewritten, g, seed = magic(cone(p, goal.pred), goal)
    start = spark.createDataFrame([seed.args], ", ".join(f"{c} string" for c in _columns(len(seed.args))))
    held = dict(facts)
    # stored tuples of a derived predicate enter its adorned form
    for r in list(rewritten.rules):
        base = r.head.pred.split("@")[0]
        if "@" in r.head.pred and not r.head.pred.startswith("m#") and base in facts:
            held[r.head.pred] = facts[base]
    held[seed.pred] = start
    return bind(evaluate(spark, rewritten, held, max_tuples)[g.pred], g).distinct()


def answer_in_tiers(spark: SparkSession, p: Program, facts: dict[str, DataFrame], goal: Atom, max_tuples: int) -> tuple[DataFrame, bool]:
    """(tuples, whole): the goal's answers within ``max_tuples``; where they don't suffice, those of one application of the
    rules to stored facts, which are right but may not be all."""
    try:
        return answer(spark, p, facts, goal, max_tuples), True
    except ProgramError as e:
        if "overflow" not in str(e):
            raise
    shallow = [fire(r, facts) for r in p.rules if r.head.pred == goal.pred and not any(b.negated for b in r.body) and all(b.atom.pred in facts or b.atom.pred in COMPARISONS for b in r.body)]
    stored = [facts[goal.pred]] if goal.pred in facts else []
    parts = [bind(d, goal) for d in [*stored, *shallow]]
    if not parts:
        raise ProgramError(f"no rule for {goal.pred} rests on stored facts alone")
    return union_all(parts).distinct(), False


def discharge(spark: SparkSession, p: Program, facts: dict[str, DataFrame], rounds: int = 3) -> tuple[dict[str, DataFrame], bool]:
    """(model, whole): forward closure in at most ``rounds`` rounds of the positive rules whose head has no stored facts.

    Every round joins the rule bodies over all that is known; ``whole`` tells that nothing more would follow.
    """
    rules = [r for r in p.rules if r.head.pred not in facts and r.body and not any(b.negated for b in r.body)]
    check_safety(Program(rules))
    held, got = dict(facts), {}
    for _ in range(rounds):
        grown = False
        for q in sorted({r.head.pred for r in rules}):
            parts = [fire(r, held) for r in rules if r.head.pred == q and all(b.atom.pred in held or b.atom.pred in COMPARISONS for b in r.body)]
            if not parts:
                continue
            new = union_all(parts).distinct()
            if q in got:
                new = new.join(got[q], got[q].columns, "left_anti")
            c = cut(new, "discharged", n=F.count("*"))
            if c.seen["n"]:
                grown = True
                got[q] = c.df if q not in got else got[q].unionByName(c.df)
        held |= got
        if not grown:
            return got, True
    return got, False


def clusters(p: Program, tainted: set[str] = frozenset()) -> list[set[str]]:
    """The derived predicates in groups that share no predicate but stored ones, without the ``tainted`` and what rests on
    them; largest first, then by name."""
    bad = set(tainted)
    while more := {r.head.pred for r in p.rules if r.head.pred not in bad and any(b.atom.pred in bad for b in r.body)}:
        bad |= more
    good = p.derived - bad
    group = {q: q for q in good}

    def find(q: str) -> str:
        while group[q] != q:
            q = group[q]
        return q

    for r in p.rules:
        for b in r.body:
            if r.head.pred in good and b.atom.pred in good:
                a, c = sorted((find(r.head.pred), find(b.atom.pred)))
                group[c] = a
    out: dict[str, set[str]] = defaultdict(set)
    for q in good:
        out[find(q)].add(q)
    return sorted(out.values(), key=lambda g: (-len(g), min(g)))


def witness(spark: SparkSession, body: str, facts: dict[str, DataFrame]) -> dict[str, str] | None:
    """One binding of a conjunction such as ``p(?X, ?Y), q(?Y)`` over stored facts, or None."""
    names = sorted({v for m in _ATOM.finditer(body) for v in Atom(m[2], tuple(a.strip() for a in m[3].split(","))).vars})
    p = parse(f"goal({', '.join(names) or 'yes'}) :- {body}.")
    check_safety(p)
    row = fire(p.rules[0], facts).first()
    return None if row is None else dict(zip(names, row))


def cite(model: dict[str, DataFrame], pred: str, args: tuple[str, ...], limit: int = 10_000) -> list[tuple[str, str, tuple[str, ...]]]:
    """Derivation of one fact: (rule or '', predicate, arguments), stored facts first. Empty for an unknown fact.

    Walks back from one fact, a step per used fact; ``limit`` bounds the steps.
    """
    out, todo, seen = [], [(pred, args)], set()
    while todo and len(seen) < limit:
        q, a = todo.pop()
        if (q, a) in seen:
            continue
        seen.add((q, a))
        if q not in model:
            out.append(("", q, a))
            continue
        cond = F.lit(True)
        for i, x in enumerate(a):
            cond = cond & (F.col(f"a{i}") == x)
        row = model[q].where(cond).first()
        if row is None:
            if (q, a) == (pred, args):
                return []
            continue
        out.append((row["rule"] or "", q, a))
        todo += [(x["pred"], tuple(x["args"])) for x in row["parents"] or ()]
    return sorted(out, key=lambda x: (x[0] != "", x))
