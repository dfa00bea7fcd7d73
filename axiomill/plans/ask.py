"""Asking: select axioms for a conjecture, prove it, widen or narrow the selection, and grade tests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from axiomill.operators import sine
from axiomill.plans.prover import Result, TooManyClauses, prove
from axiomill.sources.kif import Node, axioms, fold_arithmetic, normal_form, op, parse


@dataclass
class Answer:
    status: str
    tolerance: float
    n_axioms: int
    result: Result | None = None


def symbols_of(n: Node) -> set[str]:
    return {n.val} if n.kind == "symbol" else {s for x in n.items for s in symbols_of(x)}


#: Axioms that one attempt may bring to the driver.
MAX_AXIOMS = 2000


def ask(use: DataFrame, kif: DataFrame, query: str, hypotheses: list[str] = (), tolerance: float = 1.2, attempts: int = 4, max_steps: int = 2000, exclude: DataFrame | None = None) -> Answer:
    """Proved, Disproved or Unknown for a conjecture over the axioms ``kif`` (sid, kif), ``use`` (sid, symbol) being theirs.

    The selection starts at ``tolerance`` and doubles until something is decided; one of more than MAX_AXIOMS axioms is
    narrowed to between it and the last that fitted. At most MAX_AXIOMS, the ones reached first, come to the driver. A
    Disproved over a part of the axioms only counts as Unknown.
    """
    roots, wrong = parse(query)
    if wrong or len(roots) != 1:
        return Answer("InputError", tolerance, 0)
    held = [y for h in hypotheses for n in parse(h)[0] for y in axioms(fold_arithmetic(n))]
    names = sorted(symbols_of(roots[0]) | {s for h in held for s in symbols_of(h)})
    seeds = use.sparkSession.createDataFrame([(s,) for s in names], "symbol string")
    rows = kif if exclude is None else kif.join(exclude.select("sid"), "sid", "left_anti")
    best, seen = Answer("Unknown", tolerance, 0), 0
    least, most = 1.0, None
    for _ in range(attempts):
        chosen = sine.select(use, seeds, tolerance, cap=MAX_AXIOMS)
        texts = rows.join(chosen, "sid").orderBy("wave", "sid").limit(MAX_AXIOMS + 1).select("kif").collect()
        seen = len(texts[:MAX_AXIOMS])
        given = [y for r in texts[:MAX_AXIOMS] for n in parse(r["kif"])[0] for y in axioms(fold_arithmetic(n))]
        try:
            r = prove([*given, *held], roots[0], max_steps)
        except TooManyClauses:
            r = Result("Unknown")
        best = Answer(r.status, tolerance, len(given), r)
        if r.status == "Proved":
            break
        if len(texts) > MAX_AXIOMS:
            most = tolerance
        else:
            least = tolerance
        tolerance = least * 2 if most is None else (least + most) / 2
    # statements are compared with statements: one may have become several axioms
    if best.status == "Disproved" and rows.count() > seen:
        best.status = "Unknown"
    return best


def consistent(use: DataFrame, kif: DataFrame, seeds: list[str], tolerance: float = 2.0, max_steps: int = 2000) -> Answer:
    """Proved means that the axioms selected for the seeds contradict each other; the steps cite them. Disproved, that
    all of ``kif`` was looked at and nothing contradicts; over a part of it the answer is Unknown."""
    chosen = sine.select(use, use.sparkSession.createDataFrame([(s,) for s in seeds], "symbol string"), tolerance, cap=MAX_AXIOMS)
    texts = kif.join(chosen, "sid").orderBy("wave", "sid").limit(MAX_AXIOMS).select("kif").collect()
    given = [y for r in texts for n in parse(r["kif"])[0] for y in axioms(n)]
    try:
        r = prove(given, None, max_steps)
    except TooManyClauses:
        r = Result("Unknown")
    status = "Unknown" if r.status == "Disproved" and kif.count() > len(texts) else r.status
    return Answer(status, tolerance, len(given), r)


def beliefs(kif: DataFrame, agent: str, relation: str = "believes") -> DataFrame:
    """``sid, kif``: what an agent believes by top-level statements ``(believes agent formula)``, as statements."""
    lead = rf"^\({relation} {agent} (\(.*\))\)$"
    return kif.where(F.col("kif").rlike(lead)).select("sid", F.regexp_extract("kif", lead, 1).alias("kif"))


def belief_conflicts(kif: DataFrame, relation: str = "believes") -> DataFrame:
    """``agent, kif``: formulas an agent believes together with their negation, negations pushed inwards."""
    import pandas as pd

    from axiomill.sources.kif import emit

    lead = rf"^\({relation} (\S+) (\(.*\))\)$"

    def run(batches):
        for b in batches:
            rows = [(a, emit(normal_form(n)), emit(normal_form(op("not", n)))) for a, t in zip(b["agent"], b["f"]) for n in parse(t)[0]]
            yield pd.DataFrame(rows, columns=["agent", "kif", "denied"])

    rows = kif.where(F.col("kif").rlike(lead)).select(F.regexp_extract("kif", lead, 1).alias("agent"), F.regexp_extract("kif", lead, 2).alias("f"))
    both = rows.mapInPandas(run, "agent string, kif string, denied string").distinct()
    return both.select("agent", "kif").join(both.select("agent", F.col("denied").alias("kif")), ["agent", "kif"], "left_semi").distinct()


def run_tests(cases: list[dict], attempt: Callable[[dict], Answer]) -> list[dict]:
    """Grade tests (query_kif, expected, axioms, ...): Passed, Failed, Incomplete or Informational."""
    out = []
    for c in cases:
        a = attempt(c)
        said = {"Proved": True, "Disproved": False}.get(a.status)
        grade = "Informational" if c.get("expected") is None else "Incomplete" if said is None else "Passed" if said == c["expected"] else "Failed"
        out.append({"file": c.get("file"), "status": a.status, "grade": grade})
    return out
