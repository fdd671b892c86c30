"""Embedding links against all pairs."""

import random

import numpy as np
import pytest

from scrub.llm import embeddings
from scrub.llm.embeddings import embedding_links

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, dim int, size string"


def brute(rows, threshold=0.93):
    vecs = []
    for i, v, label, *_ in rows:
        x = None if v is None or not len(v) or any(e is None for e in v) else np.array(v, np.float32).astype(float)
        ok = x is not None and np.isfinite(x).all() and x.any() and i is not None and label is not None
        vecs.append((i, x if ok else None, label))
    root = {i: i for i, _, _ in vecs if i is not None}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links = [0] * len(vecs)
    for p, (a, x, s) in enumerate(vecs):
        for q, (b, y, t) in enumerate(vecs[:p]):
            if x is not None and y is not None and s == t and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[p] += 1
                links[q] += 1
                r, u = find(a), find(b)
                root[max(r, u)] = min(r, u)
    return sorted(((i, n, None if i is None else find(i), i is None or find(i) == i) for (i, _, _), n in zip(vecs, links)), key=repr)


def rows_of(n, dim, seed, labels=(0, 1, None)):
    r, g = random.Random(seed), np.random.default_rng(seed)
    centres = g.normal(size=(12, dim))
    out = []
    for i in range(n):
        v = centres[r.randrange(12)] * r.uniform(0.1, 9) + g.normal(size=dim) * r.choice([0.05, 0.2, 0.4])
        out.append((i * 3 % (n * 7) + 1, [float(x) for x in v.astype(np.float32)], r.choice(labels), "x", 3, "y"))
    return out


ODD = [
    (90001, None, 0, "", 0, ""), (90002, [], 0, "", 0, ""), (90003, [0.0] * 6, 0, "", 0, ""), (90004, [float("nan")] + [1.0] * 5, 0, "", 0, ""), (90005, [float("inf")] + [1.0] * 5, 0, "", 0, ""),
    (90006, [None] + [1.0] * 5, 0, "", 0, ""), (90007, [1.0] * 6, None, "", 0, ""), (None, [1.0] * 6, 0, "", 0, ""), (90008, [1.0] * 4, 0, "", 0, ""), (90009, [3e38] * 6, 0, "", 0, ""),
    (90010, [1e-38] * 6, 0, "", 0, ""), (90011, [0.0, -0.0, 1.0, 0.0, 0.0, 0.0], 1, "", 0, ""), (90012, [-0.0, 0.0, 2.0, 0.0, 0.0, 0.0], 1, "", 0, ""), (90013, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0], 1, "", 0, ""),
]


@pytest.mark.parametrize("block", [512, 8])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = rows_of(400, 6, 1) + ODD
    rows += [(i + 50_000, rows[7][1], rows[7][2], "", 0, "") for i in range(90)]  # one very common vector
    got = embedding_links(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_doubles_long_vectors_and_one_label(spark):
    rows = rows_of(150, 40, 2, labels=("a",))
    got = embedding_links(spark.createDataFrame(rows, SCHEMA.replace("float", "double").replace("label int", "label string"))).collect()
    want = brute([(i, v, s) for i, v, s, *_ in rows])
    assert sorted(map(tuple, got), key=repr) == want


def test_empty_table(spark):
    assert embedding_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distant_blocks_are_skipped(spark, monkeypatch):
    from pyspark.sql import functions as F

    from scrub.llm.common import Scratch

    boxes = [(0, 2, i, [float(i)] * (embeddings.LEAD + 1), [i + 0.5] * (embeddings.LEAD + 1)) for i in range(300)]
    df = spark.createDataFrame(boxes, "label int, dim int, block long, lo array<double>, hi array<double>")
    got = sorted((r.i, r.j) for r in embeddings._near_blocks(df, 0.374, Scratch(spark, "t")).select("i", "j").collect())
    assert got == sorted((i, i) for i in range(300))
    assert F is not None
