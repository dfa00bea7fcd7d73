import pytest
from pyspark.sql import functions as F

from axiomill.operators import introspect, store, validate

from tests.test_kb import SENT, edges

DEPTH = 66


def statements(spark, links):
    """Statements ``(not <inner>)`` by links (outer, inner); the innermost is ``(p ?X)``."""
    up = {b: a for a, b in links}
    down = dict(links)
    rows = [(s, [up[s]] if s in up else [], [("op", "not"), ("sub", str(down[s]))] if s in down else [("symbol", "p"), ("variable", "?X")], "f", 1, "base", "") for s in sorted(set(up) | set(down))]
    return store.statements(spark.createDataFrame(rows, SENT)).cache()


def test_roots_of_deep_statements(spark):
    st = statements(spark, [(i, i + 1) for i in range(DEPTH)])
    got = store.roots_of(st, st.select("sid"))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(DEPTH + 1)]


def test_roots_in_a_cycle(spark):
    st = statements(spark, [(0, 1), (1, 2), (2, 1), (7, 8)])
    assert sorted(map(tuple, store.roots_of(st, st.select("sid")).collect())) == [(0, 0), (7, 7), (8, 7)]


def test_inside_of_deep_statements(spark):
    st = statements(spark, [(i, i + 1) for i in range(DEPTH)])
    assert introspect.inside(st).agg(F.max("depth")).first()[0] == DEPTH
    found = validate.Base(st, edges(spark, ("A", "B", "subclass"))).inside
    assert found.agg(F.max("depth")).first()[0] == DEPTH and found.count() == DEPTH * (DEPTH + 1) // 2


def test_inside_of_itself_is_an_error(spark):
    st = statements(spark, [(1, 2), (2, 3), (3, 1)])
    with pytest.raises(ValueError):
        introspect.inside(st)
    with pytest.raises(ValueError):
        validate.Base(st, edges(spark, ("A", "B", "subclass"))).inside
