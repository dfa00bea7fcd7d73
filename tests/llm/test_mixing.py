import math

import pytest

from axiomill.llm import mixing, tokens
from axiomill.llm.mixing import Mixture, _level

COUNTS = "doc bigint, source string, tokens bigint"
TARGETS = "source_name string, target_weight double, max_repeats int"


def mix(spark, rows, targets, **kw):
    return Mixture(spark.createDataFrame(rows, COUNTS), spark.createDataFrame(targets, TARGETS), "source_name", "target_weight", "max_repeats", **kw)


def test_shares_follow_targets(spark):
    rows = [(i, "a", 10) for i in range(600)] + [(1000 + i, "b", 7) for i in range(600)] + [(5000 + i, "c", 5) for i in range(60)] + [(9000, None, 1000), (9001, "unlisted", 500)]
    m = mix(spark, rows, [("A ", 2.0, 9), ("b", 1.0, 9), ("c", 1.0, 2), ("gone", 1.0, 3), ("no", None, 3), ("nan", float("nan"), 1), ("zero", 0.0, 1)], budget=6000)
    rep = {r["source"]: r for r in m.report().collect()}
    assert set(rep) == {"a", "b", "c", "gone"} and m.total == 6000 + 4200 + 300 + 1500
    # c is used up twice; the others share what it leaves two to one
    assert rep["c"]["used"] == 600 and rep["c"]["passes_used"] == 2 and rep["c"]["short"] and rep["gone"]["short"] and rep["gone"]["used"] == 0
    assert abs(rep["a"]["used"] - 3600) <= 20 and abs(rep["b"]["used"] - 1800) <= 20
    assert not rep["a"]["short"] and not rep["b"]["short"]
    assert sum(r["used"] for r in rep.values()) <= 6000
    assert math.isclose(sum(r["share"] for r in rep.values()), 1)


def test_rows_are_the_head_of_the_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rows = [(i, "ab"[i % 2], 1 + i % 5) for i in range(300)]
    m = mix(spark, rows, [("a", 3.0, 2), ("b", 1.0, 2)], budget=700)
    out = sorted(m.rows.collect(), key=lambda r: r["position"])
    assert [r["finish"] for r in out] == sorted(r["finish"] for r in out)
    t = 0
    for r in out:
        t += r["tokens"]
        assert r["position"] == t
    assert 690 <= t <= 700
    assert len({(r["doc"], r["copy"]) for r in out}) == len(out) and max(r["copy"] for r in out) <= 2
    # no document is used again before its whole source was used once
    first = {r["doc"] for r in out if r["source"] == "a" and r["copy"] == 1}
    if any(r["copy"] == 2 and r["source"] == "a" for r in out):
        assert len(first) == 150


def test_everything_is_used_when_the_budget_allows(spark):
    m = mix(spark, [(1, "a", 5), (2, "b", 5)], [("a", 1.0, 2), ("b", 1.0, None)], budget=1000)
    assert sorted((r["doc"], r["copy"]) for r in m.rows.collect()) == [(1, 1), (1, 2), (2, 1)]


def test_ranges_hold_alike_many_rows(spark, monkeypatch):
    """One source runs out at the very start, so most of the queue's time has few rows."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, "quick", 1) for i in range(500)] + [(1000 + i, "slow", 1) for i in range(500)]
    m = mix(spark, rows, [("quick", 99.0, 1), ("slow", 1.0, 1)])
    held = [r["count"] for r in m.queue.groupBy("range").count().collect()]
    assert sum(held) == 1000 and max(held) <= 100 and len(held) >= 15
    assert m.rows.count() == 1000 and m.rows.agg({"position": "max"}).first()[0] == 1000


def test_long_documents_let_others_go_on(spark):
    """A long document that doesn't fit leaves its room to what finishes before it."""
    rows = [(1, "a", 1000)] + [(10 + i, "b", 1) for i in range(800)]
    m = mix(spark, rows, [("a", 1.0, 1), ("b", 1.0, 5)], budget=900)
    assert m.rows.where("source = 'b'").count() == 900 and m.rows.where("source = 'a'").count() == 0


def test_level():
    plan = [{"weight": 2.0, "cap": 100}, {"weight": 1.0, "cap": 10}]
    assert _level(plan, 30) == 10 and _level(plan, 50) == 20 and _level(plan, 1000) == math.inf


def test_empty(spark):
    assert mix(spark, [], [("a", 1.0, 1)]).rows.count() == 0
    m = mix(spark, [(1, "a", 5)], [])
    assert m.rows.count() == 0 and m.report().count() == 0
    r = mix(spark, [], [("a", 1.0, 1)]).report().collect()
    assert [(x["source"], x["used"], x["share"]) for x in r] == [("a", 0, 0.0)]


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    rows = [(1, " News\t Page ", "hello world"), (2, None, "x" * 5000), (3, "a", None), (4, "a", " \n"), (5, "", "<|endoftext|> ¿qué?")]
    got = {r["doc"]: r for r in tokens.token_counts(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), "doc_id", "source", "text").collect()}
    assert set(got) == {1, 2, 5} and got[1]["source"] == "news page" and got[1]["tokens"] == 2 and got[2]["source"] is got[5]["source"] is None
    assert got[5]["tokens"] > 3


def test_short_comes_from_the_queue(spark):
    rows = [(i, "abc"[i % 3], 3 + i % 7) for i in range(300)] + [(900, "d", 12)]
    targets = [("a", 5.0, 1), ("b", 1.0, 4), ("c", 2.0, 40), ("d", 1.0, 3), ("gone", 1.0, 2), ("never", 0.5, 0)]
    m = mix(spark, rows, targets)
    found = m.report().where("short").select("source")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "finish" in plan and "range" in plan and "_local" in plan
    # what the report reads is the queue: every copy up to its end, no more
    assert m.queue.groupBy("doc", "copy").count().where("count > 1").isEmpty() and m.queue.agg({"copy": "max"}).first()[0] > 1
    size = {s: sum(t for _, x, t in rows if x == s) for s in "abcd"}
    weights = sum(w for _, w, _ in targets)
    want = {s for s, w, r in targets if size.get(s, 0) * r * weights < w * m.total}
    assert {r["source"] for r in found.collect()} == want and 2 < len(want) < 6
    for budget in (0, 50, 5000):
        rep = {r["source"]: r for r in mix(spark, rows, targets, budget=budget).report().collect()}
        assert {s for s, r in rep.items() if r["short"]} == want
        assert all(math.isclose(rep[s]["last_finish"], size.get(s, 0) * r / w) for s, w, r in targets)


def test_a_tie_is_not_short(spark):
    # each source holds exactly its target share, in weights whose quotients are rounded
    rows = [(i, "abc"[i % 3], 7) for i in range(90)]
    rep = mix(spark, rows, [("a", 0.1, 1), ("b", 0.1, 1), ("c", 0.1, 1)], budget=630).report().collect()
    product = 210 * (0.1 + 0.1 + 0.1) < 0.1 * 630
    assert [r["short"] for r in rep] == [product] * 3
