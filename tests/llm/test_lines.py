"""Line deduplication against brute force, and on awkward rows."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from basinflow.llm.lines import drop_frequent_lines, frequent_lines

BARE = " \t\n\x0b\x0c\r"


def key(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BARE))


def brute(rows: list[tuple], least_docs: int, least_chars: int = 1) -> list[tuple]:
    having = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                having[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(having[key(x)]) < least_docs]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


ROWS = [
    (1, None), (2, ""), (3, "\n"), (4, "Same line\nown 4"), (5, "  SAME LINE\t\r\nown 5"), (6, "same line"), (6, "same line"), (6, "other\nsame line\n"),
    (7, "\x85same line\nÄrger "), (8, "ärger\n É \né"), (9, "Ärger \nÉ"), (None, "same line\nof nobody"), (None, "of nobody\nof nobody"), (10, "a\n" * 70 + "same line\n" * 90 + "z"),
    (11, "x" * 30000 + "\nA\n\n\n \n"), (12, "a\nof nobody"),
]


@pytest.mark.parametrize(("least_docs", "least_chars"), [(1, 1), (2, 1), (3, 1), (5, 2), (99, 1), (2, 0)])
def test_equals_brute_force(spark, least_docs, least_chars):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    found = drop_frequent_lines(docs, least_docs, least_chars).collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found), key=repr) == brute(ROWS, least_docs, least_chars)


def test_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, n_lines string, POS int, h1 string, bits int, word int, kept int, marks int, row1 int, m1 int, `a.b` int"
    docs = spark.createDataFrame([(i, "same\nown %d" % i, "n", *[i] * 0, i, "h", i, i, i, i, i, i, i) for i in range(3)], schema)
    found = drop_frequent_lines(docs, 2)
    assert found.columns == [*docs.columns, "n_lines_", "n_dropped"]
    assert sorted((r.doc_id, r.text, r.n_lines, r.POS, r["a.b"], r.n_dropped) for r in found.collect()) == [(i, f"own {i}", "n", i, i, 1) for i in range(3)]
    assert drop_frequent_lines(docs.limit(0)).count() == 0


def test_rows_of_one_document_count_once(spark):
    docs = spark.createDataFrame([(1, "a\na\na"), (1, "a"), (None, "a"), (None, "a")], "doc_id long, text string")
    assert [r.n_docs for r in frequent_lines(docs, 2).collect()] == [2]
    assert frequent_lines(docs, 3).count() == 0


def test_native(spark):
    plan = drop_frequent_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[-1])
