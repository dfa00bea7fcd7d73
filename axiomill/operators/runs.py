"""Figures over prover runs: portfolios, test grades, samples of a corpus of problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from axiomill.plans.cut import cut


def greedy_portfolio(solved: DataFrame, lanes: int) -> DataFrame:
    """``lane, config, added, covered``: up to ``lanes`` configurations, each the one that adds most problems; ties by name.

    ``solved`` is (config, problem). Each round is one anti-join and one count per configuration; only the best row of a
    round comes to the driver.
    """
    left = cut(solved.select("config", "problem").dropna().distinct(), "solved").df
    out, covered = [], 0
    for lane in range(1, lanes + 1):
        best = left.groupBy("config").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "config").first()
        if best is None:
            break
        covered += best["n"]
        out.append((lane, best["config"], best["n"], covered))
        mine = left.where(F.col("config") == best["config"]).select("problem")
        left = cut(left.join(mine, "problem", "left_anti"), "solved").df
    return solved.sparkSession.createDataFrame(out, "lane int, config string, added bigint, covered bigint")


def grade(verdict: Column, expected: Column, known: Column) -> Column:
    """Grade of a test: Passed, Failed (the other way round), Incomplete (no verdict), Informational (nothing expected)."""
    said = F.when(verdict == "Proved", True).when(verdict == "Disproved", False)
    return F.when(~known | expected.isNull(), "Informational").when(said.isNull(), "Incomplete").when(said == expected, "Passed").otherwise("Failed")


def stratified_sample(df: DataFrame, strata: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """A fixed ``share`` of each stratum, the same at every run: the rows whose key hashes below it."""
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(strata), F.col(key)), F.lit(1_000_000))
    return df.where(slot < int(share * 1_000_000))


def sweep(problems: DataFrame, configs: list[tuple[str, int]]) -> DataFrame:
    """``config, problem, solved, status, steps``: every problem (problem, axioms array<string>, query) tried under every
    configuration (name, steps allowed). A try is one row, so tries go to all workers alike; configurations are few.
    """
    import pandas as pd

    def run(batches):
        from axiomill.plans.prover import TooManyClauses, prove
        from axiomill.sources.kif import axioms, parse

        for b in batches:
            rows = []
            for c, k, p, given, q in zip(b["config"], b["steps"], b["problem"], b["axioms"], b["query"]):
                read = [parse(t)[0] for t in given]
                goal = parse(q)[0] if q else []
                try:
                    r = prove([y for ns in read for n in ns for y in axioms(n)], goal[0] if goal else None, int(k))
                    rows.append((c, p, r.status == "Proved", r.status, r.made))
                except TooManyClauses:
                    rows.append((c, p, False, "Unknown", 0))
            yield pd.DataFrame(rows, columns=["config", "problem", "solved", "status", "steps"])

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), F.lit(k).alias("steps")) for n, k in configs])).alias("c")
    tries = problems.select("problem", "axioms", "query", each).select("problem", "axioms", "query", "c.config", "c.steps").repartition("problem", "config")
    return tries.mapInPandas(run, "config string, problem string, solved boolean, status string, steps bigint")


def first_solved(tries: DataFrame, schedule: list[str]) -> DataFrame:
    """``problem, config, status``: of each problem the first lane of the ``schedule`` that solved it, else its last try."""
    rank = F.array_position(F.array(*map(F.lit, schedule)), F.col("config"))
    best = F.min(F.struct((~F.col("solved")).alias("late"), F.when(F.col("solved"), rank).otherwise(-rank).alias("at"), "config", "status"))
    return tries.where(rank > 0).groupBy("problem").agg(best.alias("b")).select("problem", "b.config", "b.status")
