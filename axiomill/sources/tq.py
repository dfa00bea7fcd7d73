"""Test files: statements with directives for note, time, answer, query and further files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from axiomill.sources.kif import emit, parse

#: Seconds where a test names none.
DEFAULT_TIME = 30
SCHEMA = "file string, note string, timeout_s int, query_kif string, answer array<string>, expected boolean, axioms array<string>, extra_files array<string>, unread int"


def testcase(text: str, file: str = "") -> dict:
    """One test from its text; ``unread`` counts directives that say nothing usable."""
    t: dict = {"file": file, "note": None, "timeout_s": DEFAULT_TIME, "query_kif": None, "answer": None, "expected": None, "axioms": [], "extra_files": [], "unread": 0}
    roots, wrong = parse(text)
    t["unread"] = len(wrong)
    for n in roots:
        h, a = n.head, n.items[1:]
        if h == "note":
            t["note"] = " ".join(x.val.strip('"') for x in a)
        elif h == "time" and a and a[0].kind == "number":
            t["timeout_s"] = int(float(a[0].val))
        elif h in ("query", "ask") and a:
            t["query_kif"] = emit(a[0])
        elif h == "answer" and a:
            words = [x.val for x in a]
            if words[0].lower() in ("yes", "no"):
                t["expected"] = words[0].lower() == "yes"
                words = words[1:]
            t["answer"] = words or None
        elif h == "file" and a:
            t["extra_files"] += [x.val.strip('"') for x in a]
        elif h in ("note", "time", "query", "ask", "answer", "file"):
            t["unread"] += 1
        else:
            t["axioms"].append(emit(n))
    return t


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All tests under ``path``, one row a file."""
    files = spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as file", "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([testcase(t, f) for f, t in zip(b["file"], b["value"])], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)
