"""The Merkle manifest against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from basinflow.llm import manifest
from tests.compare import connect, differ

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple, text: str | None) -> str:
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def levels(nodes: list[str]) -> list[list[str]]:
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def way(tree: list[list[str]], i: int) -> list[tuple]:
    out = []
    for nodes in tree[:-1]:
        first = i // 3 * 3
        out.append((nodes[first:i], nodes[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows: list[tuple]) -> list[tuple]:
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row, leaf(row, row[4])))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, bytes.fromhex(x[1])))
        trees[s] = levels([x for _, x in sources[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (row, own) in enumerate(sources[s]):
            steps = way(trees[s], i) + way(top, k)
            chosen = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = leaf(row, row[4].replace("\n", "")) if chosen else own
            for before, after in steps:
                folded = h(*before, folded, *after)
            root = top[-1][0]
            out.append((row[0], own, trees[s][-1][0], root, h(*[x for a, b in steps for x in a + b]), folded, folded == root))
    return sorted(out, key=repr)


def made(docs, most: int = manifest.UPPER_NODES) -> list[tuple]:
    found = manifest.verify(manifest.build_manifest(docs, manifest.tampered_leaf()), most)
    return sorted(map(tuple, found.select(*OUT).collect()), key=repr)


ODD = [
    *((i, "big", "en", i, f"text {i}\nline") for i in range(100)), (None, "big", "en", 1, "a\nb"), (None, "big", "en", 2, "a\nb"), (5, "big", "en", 5, "text 5\nline"),
    (5, "big", "en", 5, "text 5\nline"), (5, "big", "de", 5, "other"), (1, None, None, None, None), (2, None, None, None, ""), (3, "one", "en", 0, ""), (4, "é", "日本", 7, "\n\n😀"), (6, "Z", "en", 1, "-"),
]


@pytest.mark.parametrize("most", [20, 0])
def test_equals_brute_force(spark, most):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(5)
    assert made(docs, most) == brute(ODD)


def test_small_trees(spark):
    for n in (1, 3, 10):
        rows = [(i, "s", "en", i, "a\nb") for i in range(n)]
        assert made(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == brute(rows)
    apart = [(i, f"s{s}", "en", i, "a\nb") for s in range(10) for i in range(s)]
    assert made(spark.createDataFrame(apart, SCHEMA)) == brute(apart)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "x", b"y") for r in ODD], SCHEMA + ", at long, LEAF string, hash binary")
    assert made(docs) == brute(ODD)
    assert made(docs.limit(0)) == []


def test_many_equal_rows_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(manifest, "CHUNK", 7)
    rows = [(1, "s", "en", 1, "a\nb")] * 40 + [(2, "s", "en", 1, "c")] * 3
    assert made(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_tampering_is_found_and_nothing_else(spark):
    docs = spark.createDataFrame([(i, "s", "en", i, "two\nlines" if i % 2 else "one") for i in range(30)], SCHEMA)
    before = {k: spark.conf.get(k) for k in manifest.LIMITS}
    plain = manifest.verify(manifest.build_manifest(docs))
    assert {k: spark.conf.get(k) for k in manifest.LIMITS} == before
    assert plain.where(~F.col("verified")).count() == 0
    changed = {i for i in range(1, 30, 2) if zlib.crc32(str(i).encode()) % 2 == 0}
    assert {x[0] for x in made(docs) if not x[-1]} == changed


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differ(manifest.op12_merkle_manifest(spark, sf), connect(sf), manifest.OP12_SQL) == ""
