from pyspark.sql import functions as F

from axiomill.functions.render import render, render_frame
from axiomill.operators import introspect, search, store, taxonomy
from axiomill.plans.ask import ask, belief_conflicts, beliefs, consistent, run_tests
from axiomill.sources import persist
from axiomill.sources.kif import parse

from tests.test_kb import BASE, edges, kb


def test_nested_content(spark):
    st = store.statements(kb(spark, "(=> (p ?X) (not (q ?X 3 A))) (r A)")).cache()
    top = st.where("head = '=>'").first()["sid"]
    t = introspect.term_facts(st).where(F.col("sid") == top).first()
    assert (t["depth"], t["size"], t["is_ground"], t["has_numeral"], t["symbols"], t["variables"]) == (2, 8, False, True, ["A", "p", "q"], ["?X"])
    e = edges(spark, *BASE)
    d = search.docs(store.facts(st))
    page = introspect.man_page("Human", st, e, d, taxonomy.argument_sorts(store.facts(st)))
    assert {(r["section"], r["value"]) for r in page.collect()} == {("parent", "Animal"), ("child", "Bob")}


def test_places(spark, tmp_path):
    (tmp_path / "a.kif").write_text("(p A)\n; note\n(q A (r B))\n")
    t = introspect.spans(spark, str(tmp_path)).cache()
    file = t.first()["file"]
    r = introspect.at_offset(t, file, 16).first()
    assert (r["text"], r["line"], r["col"], r["top_start"]) == ("A", 3, 4, 13)
    assert introspect.at_offset(t, file, 8).count() == 0
    assert sorted((r["start"], r["end"], r["text"]) for r in introspect.rename(t, "A", "Z").collect()) == [(3, 4, "Z"), (16, 17, "Z")]


def test_relations_below_and_paths(spark):
    e = edges(spark, ("mother", "parent", "subrelation"), ("parent", "kin", "subrelation"))
    below = introspect.below_relation(e, spark.createDataFrame([("father", "parent")], "x string, y string")).cache()
    f = store.facts(store.statements(kb(spark, "(mother Ann Bob) (father Bob Cid) (likes Ann Cid) (kin Cid Dan)")))
    links = introspect.relation_edges(f, "kin", below).cache()
    assert links.count() == 3
    assert [(a, b) for a, b, _ in introspect.witness_path(links, "Ann", "Dan")] == [("Ann", "Bob"), ("Bob", "Cid"), ("Cid", "Dan")]
    assert introspect.witness_path(links, "Dan", "Ann") == []


def test_completions(spark):
    st = store.statements(kb(spark, "(likes Bob Bob) (domain likes 1 Animal)")).cache()
    s = taxonomy.argument_sorts(store.facts(st))
    assert {"likes", "=>"} <= {r[0] for r in introspect.completions(st, edges(spark, *BASE), s).collect()}
    assert {r[0] for r in introspect.completions(st, edges(spark, *BASE), s, "likes", 1).collect()} == {"Human", "Bob"}
    assert introspect.expected_class(s, "likes", 1).first()[0] == "Animal"


def test_words(spark):
    formats = {"likes": "%1 %n{does not like}%p{likes} %2", "all": "all of %*{1-N}[, ]", "sees": "%1 %n sees &%Sight %3"}
    one = lambda t: parse(t)[0][0]
    assert render(one("(likes Bob Ann)"), formats, {"Ann": "Annie"}) == "Bob likes Annie"
    assert render(one("(not (likes Bob Ann))"), formats) == "Bob does not like Ann"
    assert render(one("(=> (all A B C) (not (other A)))"), formats) == "if all of A, B, C, then it is not the case that other(A)"
    assert render(one("(sees A)"), formats) == "A  sees Sight %3"
    got = render_frame(spark.createDataFrame([(1, "(likes A B)"), (2, "(none A)"), (3, ""), (4, None)], "sid bigint, kif string"), formats).collect()
    assert {r["sid"]: (r["text"], list(r["missing"])) for r in got} == {1: ("A likes B", []), 2: ("none(A)", ["none"]), 3: (None, [])}


def test_persistence(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "sid bigint, file string")
    persist.save({"statements": rows}, str(tmp_path / "kb"))
    persist.reconcile(spark, str(tmp_path / "kb"), "statements", spark.createDataFrame([(3, "b")], "sid bigint, file string"))
    assert sorted(r["sid"] for r in persist.load(spark, str(tmp_path / "kb"), ["statements"])["statements"].collect()) == [1, 3]
    (tmp_path / "x.kif").write_text("(p A)")
    assert persist.file_hashes(spark, str(tmp_path / "x.kif")).first()["size"] == 5
    a = spark.sql("select 'a' file, timestamp '2025-01-01' mtime, 1L content_hash union all select 'b', null, 2L union all select 'c', timestamp '2025-01-01', 3L union all select 'd', null, null")
    b = spark.sql("select 'a' file, timestamp '2025-01-02' mtime, 1L content_hash union all select 'b', null, 3L union all select 'e', null, 1L union all select 'd', null, null")
    assert {r["file"]: r["state"] for r in persist.freshness(a, b).collect()} == {"a": "touched", "b": "changed", "c": "gone", "d": "fresh", "e": "new"}


def test_asking(spark):
    texts = ["(=> (human ?X) (mortal ?X))", "(human Bob)", "(rock Stone)", "(=> (rock ?X) (not (mortal ?X)))", "(rock Bob)"]
    kif = spark.createDataFrame(list(enumerate(texts)), "sid bigint, kif string")
    use = spark.createDataFrame([(i, w) for i, t in enumerate(texts) for w in t.replace("(", " ").replace(")", " ").split() if w not in ("=>", "not") and w[0] != "?"], "sid bigint, symbol string")
    first = kif.where("sid < 3")
    small = use.where("sid < 3")
    a = ask(small, first, "(mortal Bob)", attempts=1)
    assert a.status == "Proved" and a.n_axioms >= 2
    assert ask(small, first, "(flies Bob)", attempts=1).status in ("Unknown", "Disproved") and ask(small, first, "(broken", attempts=1).status == "InputError"
    assert consistent(use, kif, ["Bob"], 64.0).status == "Proved"
    graded = run_tests([{"query": "(mortal Bob)", "expected": True}, {"query": "(mortal Bob)", "expected": None}], lambda c: a)
    assert [g["grade"] for g in graded] == ["Passed", "Informational"]


def test_beliefs(spark):
    rows = ["(believes Ann (p A))", "(believes Ann (not (not (not (p A)))))", "(believes Bob (p A))", "(p A)"]
    kif = spark.createDataFrame(list(enumerate(rows)), "sid bigint, kif string")
    assert sorted(r["kif"] for r in beliefs(kif, "Ann").collect()) == ["(not (not (not (p A))))", "(p A)"]
    assert {(r["agent"], r["kif"]) for r in belief_conflicts(kif).collect()} == {("Ann", "(p A)"), ("Ann", "(not (p A))")}


def test_evidence_annotations_and_updates(spark):
    from axiomill.operators import sine
    from axiomill.plans.datalog import witness

    st = store.statements(kb(spark, "(likes Bob Rex) (domain likes 1 Human) (domain likes 2 Animal) (instance Rex Human)"))
    f = store.facts(st).cache()
    s = taxonomy.argument_sorts(f)
    e = edges(spark, *BASE)
    got = {r["node"]: r["classes"] for r in taxonomy.most_specific(e, taxonomy.evidence(e, f, s).where("node in ('Bob', 'Rex')")).collect()}
    assert got == {"Bob": ["Human"], "Rex": ["Human"]}
    assert taxonomy.sort_annotations(s).first()["sorts"] == {1: "Human", 2: "Animal"}
    use = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "sid bigint, symbol string")
    new = sine.update_generality(sine.generality(use), added=spark.createDataFrame([(3, "b"), (3, "c")], "sid bigint, symbol string"), removed=use.where("sid = 2"))
    assert {r["symbol"]: r["occ"] for r in new.collect()} == {"a": 1, "b": 2, "c": 1}
    facts = {"p": spark.createDataFrame([("x", "y"), ("u", "v")], "a0 string, a1 string"), "q": spark.createDataFrame([("v",)], "a0 string")}
    assert witness(spark, "p(?X, ?Y), q(?Y)", facts) == {"?X": "u", "?Y": "v"} and witness(spark, "p(?X, ?X)", facts) is None
