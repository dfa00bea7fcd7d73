import math
import random
from collections import Counter

from pyspark.sql import functions as F

from axiomill.llm import burst
from axiomill.llm.burst import BurstTrie, term_frequencies
from axiomill.llm.distinctive import distinctive_terms
from axiomill.llm.records import bags, symbols

BAGS = "record bigint, terms array<string>"


def some_bags(n=120, seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["hot", "Häuser", "日本", "a" * 300]
    return [(i, [r.choice(words) for _ in range(r.randrange(0, 15))] + ["hot"] * r.randrange(2)) for i in range(n)]


def test_bags(spark):
    e = "array<struct<kind:string,val:string>>"
    rows = [(1, [("symbol", " a "), ("literal", "b"), ("symbol", None), ("symbol", "a"), ("symbol", " ")], 0), (1, [("symbol", " a "), ("symbol", "a")], 1), (2, None, 1), (3, [], 1), (None, [("symbol", "x")], 1)]
    df = spark.createDataFrame(rows, f"sid bigint, elements {e}, terms int")
    got = {r["record"]: r["terms"] for r in bags(df, "sid", symbols(F.col("elements"))).collect()}
    assert got == {1: ["a", "a"], 2: [], 3: []}


def test_trie_counts_and_bursts():
    r = random.Random(1)
    t, want = BurstTrie(limit=4), Counter()
    for _ in range(3000):
        term = "".join(r.choice("ab") for _ in range(r.randrange(0, 9)))
        t.add(term, 2, 1)
        want[term] += 1
    leaves = list(t.leaves())
    got = {p + s: c for p, leaf in leaves for s, c in leaf.items()}
    assert got == {k: [2 * v, v] for k, v in want.items()}
    assert all(len(leaf) <= 4 for _, leaf in leaves)


def brute_terms(rows):
    occ = Counter(t for _, ts in rows for t in ts if t is not None)
    rec = Counter(t for _, ts in rows for t in {*ts} - {None})
    return {t: (occ[t], rec[t]) for t in occ}


def test_frequencies(spark, monkeypatch):
    rows = some_bags() + [(900, []), (901, [None, "once", "once"])]
    df = spark.createDataFrame(rows, BAGS).repartition(5)
    want = brute_terms(rows)
    n = len(rows)
    for limit, routes in ((4096, 4096), (3, 4)):
        # small limits make every prefix burst and the router split leaves
        monkeypatch.setattr(burst, "LEAF", limit)
        monkeypatch.setattr(burst, "ROUTES", routes)
        out = term_frequencies(df).collect()
        assert {r["term"]: (r["occurrences"], r["records"]) for r in out} == want
        for r in out:
            assert r["n_records"] == n
            assert r["mark"] == ("rare" if r["records"] <= 2 else "common" if r["records"] > n / 20 else None)


def test_routes_are_bounded():
    heavy = {"a": 50, "aa": 40, "aaaa": 30, "aaaaaaaa": 25, "a" * 16: 20, "a" * 32: 20}
    assert burst._route("b", heavy, 5) == "b"
    assert burst._route("ab", heavy, 5) == "ab"
    assert burst._route("a", heavy, 5) == "a"
    assert len({burst._route("a" * 32 + str(i), heavy, 5) for i in range(50)}) > 1


def test_empty(spark):
    none = spark.createDataFrame([], BAGS)
    assert term_frequencies(none).count() == 0
    assert distinctive_terms(none).count() == 0
    assert term_frequencies(spark.createDataFrame([(1, []), (2, [])], BAGS)).count() == 0


def test_distinctive(spark):
    rows = some_bags(80)
    df = spark.createDataFrame(rows, BAGS)
    n = sum(len(ts) for _, ts in rows)
    terms = brute_terms(rows)
    got = {(r["record"], r["term"]): r for r in distinctive_terms(df, 5, prior=50.0).collect()}
    want = {(i, t) for i, ts in rows if len(ts) >= 5 for t in ts}
    assert set(got) == want
    for (i, t), r in got.items():
        tf, size = rows[i][1].count(t), len(rows[i][1])
        cf, df_ = terms[t]
        assert (r["tf"], r["n_terms"], r["cf"], r["df"]) == (tf, size, cf, df_)
        a = 50.0 * cf / n
        z = math.log((tf + a) / (size + 50 - tf - a)) - math.log((cf - tf + a) / (n - size + 50 - cf + tf - a))
        assert abs(r["z"] - z / math.sqrt(1 / (tf + a) + 1 / (cf - tf + a))) < 1e-9


def test_rare_shared_terms_weigh_more(spark):
    rows = [(i, ["head"] * 2 + [f"filler{j}" for j in range(6)]) for i in range(50)] + [(50, ["head", "scarce", "scarce", *[f"filler{j}" for j in range(6)]]), (51, ["scarce"] + [f"filler{j}" for j in range(8)])]
    z = {r["term"]: r["z"] for r in distinctive_terms(spark.createDataFrame(rows, BAGS)).where("record = 50").collect()}
    assert z["scarce"] > 1 > z["head"]


def test_one_record(spark):
    got = distinctive_terms(spark.createDataFrame([(1, ["a", "b"])], BAGS)).collect()
    assert len(got) == 2 and all(r["z"] is None for r in got)
