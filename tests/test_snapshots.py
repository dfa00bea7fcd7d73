import datetime as dt
import random

from pyspark.sql import functions as F

from axiomill.operators.snapshots import canonical_elements, digest, number_form, snapshot_changes

SCHEMA = "snap_no int, axiom_id bigint, file string, elements array<struct<kind:string,val:string>>, loaded_at timestamp, i int, s string"


def changes(spark, rows):
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)
    out = snapshot_changes(df, "snap_no", "axiom_id", "loaded_at", digest(F.col("file"), canonical_elements(F.col("elements"))))
    return sorted(tuple(r) for r in out.collect())


def at(h):
    return dt.datetime(2025, 1, 1, h)


def lit(v):
    return [("symbol", "p"), ("literal", v)]


def test_added_removed_changed_and_gaps(spark):
    a = [("symbol", "p")]
    rows = [(s, 1, "f", a, at(1)) for s in (1, 2, 5)] + [(2, 2, "f", a, at(1)), (5, 2, "g", a, at(1)), (1, 3, None, None, at(1)), (2, 3, None, None, at(2)), (5, 3, None, [], at(2))]
    # deliveries 1, 2, 5 follow one another
    assert changes(spark, rows) == [(2, 2, "added"), (5, 2, "changed"), (5, 3, "changed")]
    rows += [(7, 1, "f", a, at(1)), (9, 2, "f", a, at(1))]
    assert changes(spark, rows)[3:] == [(7, 2, "removed"), (7, 3, "removed"), (9, 1, "removed"), (9, 2, "added")]


def test_latest_row_stands_and_repeats_fold(spark):
    rows = [(1, 1, "f", lit("1"), at(1)), (2, 1, "f", lit("2"), at(1)), (2, 1, "f", lit("1"), at(3)), (2, 1, "f", lit("1"), at(3)), (2, 1, "f", lit("9"), None)]
    assert changes(spark, rows) == []


def test_same_content_in_other_writing(spark):
    same = [
        (lit("8"), lit("8.00")), (lit("14e3"), lit("14000")), (lit(" 8\t"), lit("+8.")), (lit("-0"), lit("0.0")), (lit("12345678901234567890"), lit("12345678901234567890.0")),
        ([("variable", "?X"), ("variable", "?Y"), ("variable", "?X")], [("variable", "?B "), ("variable", "?A"), ("variable", "?B")]),
        (None, None), ([("symbol", None)], [("symbol", None)]),
    ]
    other = [
        (lit('"8"'), lit('"8.0"')), (lit("8"), lit('"8"')), (lit("12345678901234567890"), lit("12345678901234567891")), (lit("p"), [("symbol", "p"), ("symbol", "p")]),
        ([("variable", "?X"), ("variable", "?X")], [("variable", "?X"), ("variable", "?Y")]), (None, []), ([("symbol", "a|b")], [("symbol", "a"), ("symbol", "b")]),
        ([("symbol", None)], [("symbol", "")]), ([("symbol", "8")], [("symbol", "8.0")]),
    ]
    rows = [(s, k, "f", pair[s - 1], at(1)) for k, pair in enumerate(same + other) for s in (1, 2)]
    assert changes(spark, rows) == [(2, k, "changed") for k in range(len(same), len(same + other))]


def test_number_form(spark):
    vals = ["1", "01.50", "1.5", "1e2", "100", "abc", "", ".5", "0.5", "1.", "--1", "NaN", "Infinity", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v string").select(number_form(F.col("v"))).collect()]
    assert got[1] == got[2] and got[3] == got[4] and got[7] == got[8] and got[0] == got[9]
    assert got[5] is got[6] is got[10] is got[11] is got[12] is got[13] is None


def test_nulls_and_empty(spark):
    assert changes(spark, []) == []
    assert changes(spark, [(None, 1, "f", None, at(1)), (1, None, "f", None, at(1)), (1, 1, "f", None, at(1))]) == []


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(s, k, r.choice("fg"), lit(str(r.randrange(2))), at(r.randrange(5))) for s in (1, 2, 3, 4) for k in range(40) for _ in range(r.randrange(3))]
    best = {}
    for s, k, f, e, t in rows:
        key = (s, k)
        if key not in best or t > best[key][0]:
            best[key] = (t, f, e)
    if any(t == best[s, k][0] and (f, e) != best[s, k][1:] for s, k, f, e, t in rows):
        rows = [x for x in rows if x[4] != best[x[0], x[1]][0] or (x[2], x[3]) == best[x[0], x[1]][1:]]
    want = []
    for s in (2, 3, 4):
        for k in range(40):
            a, b = best.get((s - 1, k)), best.get((s, k))
            if a and b and a[1:] != b[1:]:
                want.append((s, k, "changed"))
            elif a and not b:
                want.append((s, k, "removed"))
            elif b and not a:
                want.append((s, k, "added"))
    assert changes(spark, rows) == sorted(want)
