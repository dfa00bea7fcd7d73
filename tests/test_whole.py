"""Queries over whole tables, small ones written for the test."""

import datetime as dt

import __spark_entry__ as entry

from axiomill.plans.cut import on_progress
from tests.test_kb import edges, kb


def run(spark, path, name):
    return sorted(map(tuple, entry.queries()[name](spark, str(path)).collect()))


def test_usage_evidence_of_all_relations(spark, tmp_path):
    kb(spark, "(heldBy A B) (likes A B) (likes A C) (single A) (likes ?X B)").write.parquet(f"{tmp_path}/sentences.parquet")
    assert run(spark, tmp_path, "kb_usage_evidence") == [("A", "heldBy", 1), ("A", "likes", 2)]


def test_vocabulary_figures(spark, tmp_path):
    kb(spark, '(documentation likes EnglishLanguage "x") (termFormat EnglishLanguage likes "likes")').write.parquet(f"{tmp_path}/sentences.parquet")
    rows = [("Relation", "Entity", "subclass"), ("Predicate", "Relation", "subclass"), ("Function", "Relation", "subclass"), ("likes", "Predicate", "instance"), ("AgeFn", "Function", "instance")]
    e = edges(spark, *rows).selectExpr("child as to_sym", "parent as from_sym", "rel", "1L as sid", "array('base') as scopes")
    e.write.parquet(f"{tmp_path}/tax_edges.parquet")
    got = entry.queries()["vocab_figures"](spark, str(tmp_path)).first().asDict()
    assert got == {"classes": 4, "instances": 2, "relations": 2, "predicates": 1, "functions": 1, "documented": 1, "labelled": 1}


def test_diff_of_every_pair_of_deliveries(spark, tmp_path):
    rows = [(1, "f", "a"), (1, "f", "b"), (2, "f", "b"), (4, "f", "b"), (4, "g", "c"), (4, "g", "c"), (5, None, "d"), (5, "g", "c"), (None, "f", "z")]
    schema = "snap_no int, file string, elements array<struct<kind:string,val:string>>"
    spark.createDataFrame([(n, f, [("symbol", x)]) for n, f, x in rows], schema).write.parquet(f"{tmp_path}/axiom_snapshots.parquet")
    assert run(spark, tmp_path, "source_diff") == [(2, "f", 0, 1, 1), (4, "f", 0, 0, 1), (4, "g", 1, 0, 0), (5, "f", 0, 1, 0), (5, "g", 0, 0, 1)]


def test_validation_over_whole_tables(spark, tmp_path):
    text = "(domain likes 1 Animal) (likes Bob Bob) (likes Bob) (likes Rock Bob)"
    kb(spark, text).write.parquet(f"{tmp_path}/sentences.parquet")
    rows = [("Animal", "Entity", "subclass"), ("Bob", "Animal", "instance"), ("Rock", "Entity", "instance"), ("Relation", "Entity", "subclass"), ("BinaryRelation", "Relation", "subclass"), ("likes", "BinaryRelation", "instance")]
    e = edges(spark, *rows).selectExpr("child as to_sym", "parent as from_sym", "rel", "1L as sid", "array('base') as scopes")
    e.write.parquet(f"{tmp_path}/tax_edges.parquet")
    q = entry.queries()
    assert sorted(r["symbol"] for r in q["valid_arity"](spark, str(tmp_path)).collect()) == ["likes"]
    assert [r["symbol"] for r in q["valid_domain"](spark, str(tmp_path)).collect()] == ["Rock"]
    codes = {r["code"] for r in q["valid_all"](spark, str(tmp_path)).collect()}
    assert {"E001", "E002", "E005", "E006"} <= codes


def test_order_of_orders_is_walked_without_written_steps(spark, tmp_path):
    day = lambda n: dt.datetime(2020, 1, n)
    rows = [(3, 1, day(1)), (1, 1, day(2)), (2, 1, day(2)), (9, 1, None), (4, 2, day(1)), (5, 2, day(3)), (6, 3, day(1)), (7, None, day(1)), (8, None, day(2))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    written = []
    end = on_progress(lambda tag, seen: written.append(tag))
    got = run(spark, tmp_path, "temporal_before_closure")
    end()
    assert got == sorted((f"E:{a}", f"B:{b}") for a, b in ((3, 1), (3, 2), (3, 9), (1, 2), (1, 9), (2, 9), (4, 5))) and not written
