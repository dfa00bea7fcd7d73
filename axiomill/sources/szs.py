"""Prover transcripts: status lines, verdicts, proof steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Status words of the public ontology of prover results, by verdict.
VERDICTS = {
    "Proved": ("THEOREM", "UNSATISFIABLE", "CONTRADICTORYAXIOMS"),
    "Disproved": ("SATISFIABLE", "COUNTERSATISFIABLE"),
    "Timeout": ("TIMEOUT", "RESOURCEOUT"),
    "Unknown": ("GAVEUP", "UNKNOWN", "INCOMPLETE"),
}
EXPECTED = {"Proved": ("THEOREM", "UNSATISFIABLE", "CONTRADICTORYAXIOMS"), "NotProved": ("SATISFIABLE", "COUNTERSATISFIABLE")}


def _word(status: Column, table: dict[str, tuple[str, ...]], other: str) -> Column:
    s = F.upper(F.trim(status))
    out = F.lit(other)
    for name, words in table.items():
        out = F.when(s.isin(*words), name).otherwise(out)
    return out


def verdict(status: Column) -> Column:
    """One of Proved, Disproved, Timeout, Unknown; else InputError."""
    return _word(status, VERDICTS, "InputError")


def expected(status: Column) -> Column:
    """What a problem's header asks for: Proved (also without a header), NotProved, or Informational for other words."""
    return F.when(status.isNull(), "Proved").otherwise(_word(status, EXPECTED, "Informational"))


def status_of(text: Column) -> Column:
    """The status word of a transcript, null without one."""
    return F.nullif(F.regexp_extract(text, r"SZS status\s+(\w+)", 1), F.lit(""))


def steps(transcripts: DataFrame, key: str, text: str) -> DataFrame:
    """Proof steps of transcripts: ``key, step, role, formula, rule, parents``, from annotated formulas."""
    line = r"(?m)^(?:fof|cnf|tff|thf)\(\s*([^,\s]+)\s*,\s*(\w+)\s*,\s*(.*)\)\.\s*$"
    rows = transcripts.select(key, F.explode(F.regexp_extract_all(text, F.lit(line), 0)).alias("s"))
    part = lambda n: F.regexp_extract("s", line, n)
    body = part(3)
    rule = F.regexp_extract(body, r",\s*inference\(\s*(\w+)", 1)
    return rows.select(
        key, part(1).alias("step"), part(2).alias("role"), F.trim(F.regexp_replace(body, r",\s*(?:inference|file|introduced)\(.*$", "")).alias("formula"),
        F.nullif(rule, F.lit("")).alias("rule"), F.regexp_extract_all(F.regexp_extract(body, r"\[([^\[\]]*)\]\)?\s*$", 1), F.lit(r"([\w.]+)"), 1).alias("parents"),
    )


def proof_graph(st: DataFrame, key: str) -> DataFrame:
    """``key, dot``: the proof of each transcript as a graph description; a proof's steps come together in one row."""
    edge = F.transform("parents", lambda p: F.concat(F.lit('  "'), p, F.lit('" -> "'), F.col("step"), F.lit('";')))
    lines = st.select(key, F.concat(F.array(F.concat(F.lit('  "'), "step", F.lit('" [label="'), "role", F.lit('"];'))), edge).alias("l"))
    body = F.array_join(F.sort_array(F.flatten(F.collect_list("l"))), "\n")
    return lines.groupBy(key).agg(F.concat(F.lit("digraph proof {\n"), body, F.lit("\n}")).alias("dot"))


def proof_prose(st: DataFrame, key: str) -> DataFrame:
    """``key, prose``: the proof of each transcript as sentences in order of its steps: what is given, and what follows from
    what by which rule. A proof's steps come together in one row."""
    given = F.concat(F.lit("We are given "), "formula", F.lit(" ("), "step", F.lit(")."))
    goal = F.concat(F.lit("We are to show "), "formula", F.lit(" ("), "step", F.lit(")."))
    made = F.concat(F.lit("From "), F.array_join("parents", " and "), F.lit(" follows "), "formula", F.lit(" by "), F.coalesce("rule", F.lit("inference")), F.lit(" ("), "step", F.lit(")."))
    said = F.when(F.size("parents") > 0, made).when(F.col("role") == "conjecture", goal).otherwise(given)
    lines = st.withColumn("at", F.monotonically_increasing_id()).select(key, F.struct("at", said.alias("s")).alias("l"))
    return lines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("l")).getField("s"), " ").alias("prose"))
