from collections import Counter

import pytest
from pyspark.sql import functions as F

from axiomill.operators.hotkeys import head, hot_keys, key_statistics
from axiomill.plans.prefix import running_last, running_sum
from axiomill.plans.skew import salted_join


@pytest.mark.parametrize("parts,chunk,fan", [(1, 3, 2), (7, 4, 2), (40, 1000, 3)])
def test_tree_aggregate(spark, parts, chunk, fan):
    rows = [("hot", i, "c") for i in range(300)] + [(f"k{i % 5}", i, "c") for i in range(60)] + [(None, 5, "c"), (None, None, "c")]
    df = spark.createDataFrame(rows, "g string, v bigint, key string").repartition(parts)
    got = {r["key"]: (r["n_rows"], r["s"], r["hi"]) for r in key_statistics(df, F.col("g"), {"s": (F.col("v"), "sum"), "hi": (F.col("v"), "max")}, chunk_rows=chunk, fan_in=fan).collect()}
    want = {k: (n, sum(v or 0 for g, v, _ in rows if g == k), max(v or 0 for g, v, _ in rows if g == k)) for k, n in Counter(g for g, _, _ in rows).items()}
    assert got == want
    assert [(r["key"], r["n_rows"], r["n_all"]) for r in hot_keys(df, F.col("g"), 0.5, chunk_rows=chunk, fan_in=fan).collect()] == [("hot", 300, 362)]


def test_hot_keys_edges(spark):
    df = spark.createDataFrame([(None,), (None,), ("a",)], "g string")
    assert [r["key"] for r in hot_keys(df, F.col("g"), 0.3).collect()] == ["a"]
    assert hot_keys(df, F.col("g"), 1 / 3).count() == 0
    assert hot_keys(df.limit(0), F.col("g"), 0.1).count() == 0
    assert key_statistics(df.limit(0), F.col("g")).count() == 0
    e = "array<struct<kind:string,val:string>>"
    h = spark.createDataFrame([([("symbol", " a\t")],), ([],), (None,), ([("op", None)],)], f"elements {e}").select(head()).collect()
    assert [r[0] for r in h] == ["a", None, None, None]


def test_salted_join(spark):
    big = spark.createDataFrame([("h", i) for i in range(50)] + [("x", 1), ("z", 2), (None, 3)], "k string, v int")
    small = spark.createDataFrame([("h", "H"), ("x", "X"), ("y", "Y")], "k string, w string")
    hot = spark.createDataFrame([("h",)], "k string")
    for how in ("inner", "left"):
        got = sorted(map(str, salted_join(big, small, "k", hot, how).select("k", "v", "w").collect()))
        assert got == sorted(map(str, big.join(small, "k", how).select("k", "v", "w").collect()))


def test_running_sum(spark):
    rows = [(g, i // 7, i, i % 3) for g in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "g string, b int, i int, v bigint")
    got = {(r["g"], r["i"]): r["s"] for r in running_sum(df, ["g"], "b", ["i"], "v", "s").collect()}
    for g in "ab":
        t = 0
        for i in range(50):
            t += i % 3
            assert got[g, i] == t
    one = {r["i"]: r["s"] for r in running_sum(df.where("g = 'a'"), [], "b", ["i"], "v", "s").collect()}
    assert one[49] == sum(i % 3 for i in range(50))


def test_running_last(spark):
    rows = [(g, i // 5, i, (i % 7 == 3) if i % 3 == 0 else None) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, b int, i int, v boolean")
    got = {(r["g"], r["i"]): r["o"] for r in running_last(df, ["g"], "b", ["i"], "v", "o").collect()}
    assert len(got) == 80
    for g in ("a", None):
        held = None
        for i in range(40):
            assert got[g, i] == held
            if i % 3 == 0:
                held = i % 7 == 3
