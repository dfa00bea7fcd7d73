import pytest

from axiomill.plans.prover import TooManyClauses, clausify, prove, subsumes
from axiomill.sources import config, tptp, tq
from axiomill.sources.kif import axioms, canonical, diagnose, emit, expand_rows, fold_arithmetic, normal_form, parse, pretty, read, tokens


def one(text):
    roots, wrong = parse(text)
    assert not wrong and len(roots) == 1
    return roots[0]


def texts(nodes):
    return [emit(n) for n in nodes]


def test_tokens_and_spans():
    got = [(k, t, s.line, s.col) for k, t, s in tokens('(p ?x @row "a \\" (b" -3.5e2 q-1) ; note\n  (=> z)')]
    assert got[:8] == [("open", "(", 1, 1), ("symbol", "p", 1, 2), ("variable", "?x", 1, 4), ("row", "@row", 1, 7), ("string", '"a \\" (b"', 1, 12), ("number", "-3.5e2", 1, 22), ("symbol", "q-1", 1, 29), ("close", ")", 1, 32)]
    assert got[8][2:] == (2, 3)


def test_diagnostics_and_recovery():
    roots, wrong = parse("(instance Broken\n(instance A B)\n)\nstray (p \"open)")
    assert texts(roots) == ["(instance A B)", "(p open)"]
    assert [d.code for d in wrong][:3] == ["kif/unbalanced-parens", "kif/unbalanced-parens", "kif/stray-token"]
    assert parse("(instance A B)")[1] == [] and parse("(not a b)")[1][0].code == "kif/operator-arity"
    assert parse("") == ([], []) and parse("; only a note") == ([], [])


def test_round_trip():
    t = '(=> (and (instance ?X Human) (age ?X 3)) (exists (?Y) (near ?X ?Y "a b")))'
    assert emit(one(t)) == t and emit(one(pretty(one(t), 20))) == t


def test_rewriting():
    assert texts(expand_rows(one("(P @ROW)"))) == ["(P ?ROW2)", "(P ?ROW2 ?ROW3)", "(P ?ROW2 ?ROW3 ?ROW4)", "(P ?ROW2 ?ROW3 ?ROW4 ?ROW5)", "(P ?ROW2 ?ROW3 ?ROW4 ?ROW5 ?ROW6)"]
    assert len(expand_rows(one("(P @A @B)"))) == 25
    assert texts(axioms(one("(<=> a b)"))) == ["(=> a b)", "(=> b a)"]
    assert texts(axioms(one("(=> a (=> b c))"))) == ["(=> (and a b) c)"]
    assert texts(axioms(one("(=> (or a b) c)"))) == ["(=> a c)", "(=> b c)"]
    assert texts(axioms(one("(forall (?X) (and (p ?X) (and (q ?X) (r ?X))))"))) == ["(p ?X)", "(q ?X)", "(r ?X)"]
    assert emit(normal_form(one("(not (and (p a) (not (=> b c))))"))) == "(or (not (p a)) (=> b c))"
    assert emit(normal_form(one("(not (exists (?X) (p ?X)))"))) == "(forall (?X) (not (p ?X)))"
    assert emit(fold_arithmetic(one("(age X (AdditionFn 2 (MultiplicationFn 2 1.5)))"))) == "(age X 5)"
    assert emit(fold_arithmetic(one("(age X (DivisionFn 2 0))"))) == "(age X (DivisionFn 2 0))"
    assert canonical(one("(p ?A ?B ?A 8.0)")) == canonical(one("(p ?X ?Y ?X 8)")) != canonical(one("(p ?X ?Y ?Y 8)"))


def test_read_files(spark, tmp_path):
    (tmp_path / "a.kif").write_text('(instance Bobo Primate)\n(=> (p ?X) (q ?X 8.0))\n(broken')
    (tmp_path / "b.kif").write_text("")
    got = read(spark, str(tmp_path)).collect()
    by = {r["kif"]: r for r in got}
    assert set(by) == {"(instance Bobo Primate)", "(=> (p ?X) (q ?X 8.0))", "(p ?X)", "(q ?X 8.0)"}
    top = by["(=> (p ?X) (q ?X 8.0))"]
    assert by["(p ?X)"]["parent"] == [top["sid"]] and top["elements"][1]["val"] == str(by["(p ?X)"]["sid"]) and by["(q ?X 8.0)"]["elements"][2]["val"] == "8"
    assert [r["code"] for r in diagnose(spark, str(tmp_path)).collect()] == ["kif/unbalanced-parens"]


def test_tptp():
    text = "% Status : Theorem\nfof(a,axiom, ! [X] : ( (human(X) & ~ robot(X)) => ? [Y] : mother(X,Y) )).\ncnf(b,axiom, p(a) | ~q(X) | X != a).\nfof(c,conjecture,(s__p(s__A) <=> $true)).\ntff(t,type,x: $i)."
    got = tptp.parse(text)
    assert [(f.name, f.role) for f in got] == [("a", "axiom"), ("b", "axiom"), ("c", "conjecture")]
    assert emit(got[0].tree) == "(forall (?X) (=> (and (human ?X) (not (robot ?X))) (exists (?Y) (mother ?X ?Y))))"
    assert emit(got[1].tree) == "(or (p a) (not (q ?X)) (not (equal ?X a)))" and emit(got[2].tree) == "(<=> (p A) $true)"
    assert len(tptp.parse(text, keep_conjectures=False)) == 2 and tptp.header(text) == {"Status": "Theorem"}
    line = tptp.annotated("kb_1", "axiom", one("(=> (p ?X A-b) (exists (?Y) (q ?X ?Y)))"))
    assert line == "fof(kb_1,axiom,! [V__X] : (s__p(V__X, s__A_x2db) => (? [V__Y] : s__q(V__X, V__Y))))."
    assert tptp.parse(line)[0].name == "kb_1" and "A-b" in emit(tptp.parse(line)[0].tree)
    with pytest.raises(tptp.TptpError):
        tptp.parse("fof(a,axiom,(p(")


def test_tptp_includes(tmp_path):
    (tmp_path / "x.ax").write_text("fof(x,axiom,p(a)). include('x.ax').")
    assert [f.name for f in tptp.parse("include('x.ax'). fof(y,axiom,q(a)).", includes=str(tmp_path))] == ["x", "y"]


def test_export_and_dispatch(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "subclass", "(subclass A B)"), (2, "domain", "(domain p 1 A)"), (3, "p", "(p @ROW)")], "sid bigint, head string, kif string")
    got = {r["sid"]: r for r in tptp.export(df, ("domain",)).collect()}
    assert got[1]["line"] == "fof(kb_1,axiom,s__subclass(s__A, s__B))." and got[3]["dropped"] and 2 not in got
    names = [("a.kif.tq", ""), ("a.kif", ""), ("a.p", ""), ("x", "cnf(a,axiom,p)."), ("x", "(note hi)\n"), ("x", "(p a)"), ("x", "SZS status Theorem"), ("x", "zzz")]
    rows = spark.createDataFrame(names, "n string, t string").select(tptp.dispatch(F.col("n"), F.col("t"))).collect()
    assert [r[0] for r in rows] == ["tq", "kif", "tptp", "tptp", "tq", "kif", "szs", None]


def test_test_files(spark, tmp_path):
    (tmp_path / "t.kif.tq").write_text('(note "A test")\n(time 60)\n(file "m.kif")\n(query (p ?X))\n(answer yes A)\n(p A)\n(time soon)\n')
    (tmp_path / "u.kif.tq").write_text("(query (q B))")
    got = {r["query_kif"]: r for r in tq.read(spark, str(tmp_path)).collect()}
    t = got["(p ?X)"]
    assert (t["note"], t["timeout_s"], t["expected"], t["answer"], t["axioms"], t["extra_files"], t["unread"]) == ("A test", 60, True, ["A"], ["(p A)"], ["m.kif"], 1)
    assert got["(q B)"]["timeout_s"] == 30


def test_config_round_trip():
    text = '<configuration><preference name="a" value="1"/><kb name="K"><constituent filename="x.kif"/></kb><odd z="1"/></configuration>'
    c = config.read(text)
    assert c.preferences == {"a": "1"} and c.kbs == {"K": ["x.kif"]} and config.read(config.write(c)) == c


def test_clauses():
    c = clausify(one("(=> (human ?X) (exists (?Y) (mother ?X ?Y)))"))
    assert len(c) == 1 and len(c[0].literals) == 2 and c[0].literals[1][1][2][0].startswith("sk")
    assert len(clausify(one("(<=> (p a) (q a))"))) == 2
    big = "(or " + " ".join(f"(and (p{i}) (q{i}))" for i in range(9)) + ")"
    # 512 clauses, so the conjunctions are named: one disjunction of names, and two clauses a name
    named = clausify(one(big))
    assert len(named) == 1 + 18 and len(named[0].literals) == 9
    with pytest.raises(TooManyClauses):
        clausify(one("(and " + " ".join(f"(p{i})" for i in range(200)) + ")"))
    # a variable that stays free under a quantifier is an argument of the Skolem term
    free = clausify(one("(forall (?Y) (exists (?Z) (r ?X ?Y ?Z)))"))[0].literals[0][1]
    assert len(free[3]) == 3 and ("?X",) in free[3]


def test_equality_factoring_and_backward_demodulation():
    either = [one("(or (equal a b) (equal a c))"), one("(equal b c)"), one("(not (equal a c))")]
    assert prove(either, None).status == "Proved"
    back = [one("(q (f a))"), one("(not (q a))"), one("(equal (f ?X) ?X)")]
    assert prove(back, None).status == "Proved"


def test_prover():
    chain = [one("(=> (driving ?P) (=> (phone ?P) (breaks ?P)))"), one("(=> (breaks ?P) (jail ?P))"), one("(driving Bob)"), one("(phone Bob)"), one("(driving Ann)")]
    r = prove(chain, one("(jail Bob)"))
    assert r.status == "Proved" and r.steps[-1].literals == ()
    assert prove(chain, one("(jail ?WHO)")).status == "Proved" and prove(chain, one("(jail Ann)")).status == "Disproved"
    assert prove([one("(p a)"), one("(not (p a))")], None).status == "Proved"
    assert prove([one("(=> (n ?X) (n (s ?X)))"), one("(n zero)")], one("(q zero)"), max_steps=30).status == "Unknown"
    assert subsumes(((True, ("p", ("?0",))),), ((True, ("p", ("a",))), (False, ("q",)))) and not subsumes(((True, ("p", ("a",))),), ((True, ("p", ("?0",))),))


def test_equality_in_the_prover():
    from axiomill.plans.prover import demodulate, greater

    x, a, f = ("?x",), ("a",), lambda t: ("f", t)
    assert greater(f(x), x) and not greater(x, f(x)) and not greater(f(x), ("?y",)) and greater(f(f(a)), f(a))
    assert demodulate(f(f(f(a))), [(f(f(x)), x)]) == f(a)
    given = [one("(equal (f ?X) ?X)"), one("(p (f (f b)))")]
    assert prove(given, one("(p b)")).status == "Proved"
    assert prove([one("(equal Tully Cicero)"), one("(orator Tully)")], one("(orator Cicero)")).status == "Proved"
    assert prove([one("(not (equal a b))")], one("(equal a b)")).status in ("Disproved", "Unknown")
    assert prove([one("(=> (q ?X) (equal ?X c))"), one("(q d)"), one("(r c)")], one("(r d)")).status == "Proved"
    assert prove([], one("(equal a a)")).status == "Proved"


def test_rewrites_for_provers():
    from axiomill.plans.rewrite import domain_guards, instantiate, predicate_variables

    sorts, above = {("likes", 1): "Human", ("likes", 2): "Entity", ("old", 1): "Animal"}, {"Human": {"Animal", "Entity"}}
    assert emit(domain_guards(one("(=> (likes ?X ?Y) (old ?X))"), sorts, above)) == "(=> (and (instance ?X Human) (likes ?X ?Y)) (old ?X))"
    assert emit(domain_guards(one("(old ?X)"), sorts, above)) == "(=> (instance ?X Animal) (old ?X))"
    assert emit(domain_guards(one("(exists (?X) (old ?X))"), sorts, above)) == "(exists (?X) (old ?X))"
    f = one("(=> (?R ?A ?B) (?R ?B ?A))")
    assert predicate_variables(f) == ["?R"]
    assert texts(instantiate(f, {2: ["q", "p"], 1: ["z"]})) == ["(=> (p ?A ?B) (p ?B ?A))", "(=> (q ?A ?B) (q ?B ?A))"]
    assert len(instantiate(f, {2: [f"r{i}" for i in range(50)]})) == 32 and instantiate(one("(p ?A)"), {}) == [one("(p ?A)")]
