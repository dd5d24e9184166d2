"""The Merkle manifest against a plain recursion, for blocks and fanouts that make every round ragged."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quartzline.llm import merkle, oracles, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx int, node string, n int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    said = [doc_id, source, lang, n_chars + more if n_chars is not None else None, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def tree(nodes, fanout):
    """The root, and for each node its runs on the way up: (siblings, place among them)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run = nodes[i // fanout * fanout :][:fanout]
            paths[j].append((run[: i % fanout] + run[i % fanout + 1 :], i % fanout))
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree([leaf_of(r) for r in groups[g]], fanout)
    root, upper = tree([trees[g][0] for g in order], fanout) if order else (None, [])
    out = []
    for g, above in zip(order, upper, strict=True):
        for row, path in zip(groups[g], trees[g][1], strict=True):
            node = leaf_of(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for siblings, place in path + above:
                node = sha(*siblings[:place], node, *siblings[place:])
            out.append((row[0], leaf_of(row), trees[g][0], root, sha(*(s for run, _ in path + above for s in run)), node, node == root))
    return out


def awkward(n):
    rows = [(i * 3 % 101 if i % 11 else None, "s" if i % 5 else None, ("en", "en", None, "é", "z", "Z")[min(i % 9, 5)], i if i % 4 else None, ("", None, "text\n", "世" * i)[i % 4], "g", i, "x", 2) for i in range(n)]
    return rows + rows[:5]  # repeated rows


KEY = lambda r: (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize(("fanout", "levels", "n"), [(2, 1, 90), (3, 1, 90), (2, 3, 61), (5, 2, 40), (2, 10, 30)])
def test_against_recursion(spark, fanout, levels, n):
    rows = awkward(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    got = merkle.manifest(docs, tamper=tamper, t=merkle.Tree(fanout, levels)).collect()
    assert sorted((tuple(r) for r in got), key=KEY) == sorted(brute(rows, fanout), key=KEY)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(i, None, None, None, None, None, None, None, None) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = merkle.manifest_report(docs).collect()
    assert sorted((tuple(r) for r in got), key=KEY) == sorted(brute(rows, 2), key=KEY)


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame(awkward(50), SCHEMA)
    for r in merkle.manifest(docs, t=merkle.Tree(2, 2), output="proofs").collect():
        assert r.verified and len(r.proof) <= 9 and all(len(s) == 64 for s in r.proof)


def test_rounds_do_not_depend_on_hot_group(spark):
    """Blocks of one group of nearly all rows, dealt over tasks: no task gets more than a block of leaves."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    rows = [(i, "s", "en", 1, "t") for i in range(3000)]
    got = merkle.manifest(docs, t=merkle.Tree(2, 4)).select("doc_id", "leaf", "subroot", "root", "proof_sha256").collect()
    want = {r[:5] for r in brute(rows, 2)}
    assert {tuple(r) for r in got} == want


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = con.sql(oracles.SQL["op13_merkle_manifest"]).fetchall()
    assert sorted(tuple(r) for r in queries.op13_merkle_manifest(spark, sf).collect()) == sorted(want)
