"""Exact dedup against a dictionary of normalised texts."""

import hashlib
import re

from pyspark.sql import functions as F

from scrub.llm.exact_dedup import drop_copies, exact_groups, heavy_digests
from scrub.llm.common import Scratch

SCHEMA = "doc_id long, text string, keep_id string, digest int, kept boolean"
ROWS = [
    (5, "a  b", "x", 1, None), (2, "a\tb", "y", 2, True), (9, "a b", None, 3, True), (1, " a b", "z", 4, True), (3, None, "n", None, None),
    (4, "", "e", 0, True), (None, "a b", "q", 1, True), (None, "only null ids", "q", 1, True), (None, "only null ids", "r", 1, True),
    (7, "same row", "s", 1, True), (7, "same row", "s", 1, True), (8, "x" * 100_000, "l", 1, True), (11, "nb\u00a0sp", None, None, None), (12, "nb sp", None, None, None),
]


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(order):
            out.append((i, order[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, exact_groups(df).collect()), key=repr) == brute(ROWS)


def test_heavy_digest_is_found_and_settled(spark):
    rows = [(i, "hot" if i % 3 else f"cold {i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = exact_groups(df)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)
    ids = df.select(F.col("doc_id").alias("id"), F.col("text").alias("digest"))
    assert [tuple(r) for r in heavy_digests(ids, Scratch(spark, "t")).collect()] == [("hot", 1, 4000)]


def test_drop_copies_keeps_every_column(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = drop_copies(df)
    assert out.columns == df.columns
    want = sorted((i, t) for i, _, _, kept, t in brute(ROWS) if kept and i is not None)
    got = sorted((r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in out.collect() if r.doc_id is not None)
    assert got == want and out.count() == len({norm(r[1]) for r in ROWS})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_groups(df).count() == 0 and drop_copies(df).count() == 0


def test_many_partitions_without_coalescing(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(ROWS, SCHEMA)
        assert sorted(map(tuple, exact_groups(df).collect()), key=repr) == brute(ROWS)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_python_in_the_plan(spark):
    plan = exact_groups(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
