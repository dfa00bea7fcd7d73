"""The queries on fixtures that need no loops: each gives the rows its SQL states. The driver runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from axiomill import golden

LIGHT = [q for q in golden.QUERIES if q.split("_")[0] in ("kif", "tptp", "szs", "prover", "num", "config", "render", "parser", "rewrite", "doc", "test", "real", "conjecture", "model", "ground", "functional")] + ["program_checks", "program_parts", "axioms_extracted", "axioms_schema_rules", "ask_query_symbols", "ask_test_run", "persist_freshness"]


def plain(rows):
    return sorted(str([list(v) if isinstance(v, (list, tuple)) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", LIGHT)
def test_rows(spark, name):
    df = golden.QUERIES[name](spark, "")
    rel = duckdb.sql(golden.SQL[name])
    want = rel.fetchall()
    assert df.columns == rel.columns and want
    assert plain(tuple(r) for r in df.collect()) == plain(want)


def test_names_are_told_apart():
    """No module takes the name of another's query; each query says what it is for or bears its name."""
    modules = entry._modules()
    assert sum(len(m.QUERIES) for m in modules) == len(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(golden.SQL[q] for q in golden.QUERIES)
