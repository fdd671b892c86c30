"""Near-duplicate components against brute force on full shingle sets."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrub.llm import minhash
from scrub.llm.common import Scratch, components
from scrub.llm.minhash import T, drop_near_copies, near_components, sketch
from scrub.llm.words import U, mix64

SCHEMA = "doc_id long, text string, component_id string, key int, n string, kept boolean"


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(ws)} if 0 < len(ws) < k else {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t, *_ in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for p, (a, x) in enumerate(sets):
        for b, y in sets[p + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = f"new{r.random()}"
    return " ".join(out)


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("the of and to in is on by it or".split()) if r.random() < 0.3 else f"w{r.randrange(3000)}"
    rows, ids = [], iter(r.sample(range(10_000), 2000))
    for _ in range(40):
        base = [word() for _ in range(r.randint(30, 150))]
        rows += [(next(ids), edited(r, base, r.randrange(0, 7))) for _ in range(r.randint(1, 6))]
    base = [word() for _ in range(120)]
    rows += [(next(ids), edited(r, base, 1)) for _ in range(60)]  # a large group of near copies
    part = [word() for _ in range(60)]
    rows += [(next(ids), " ".join(part + [word() for _ in range(r.randint(8, 20))])) for _ in range(40)]  # one passage, between 0.6 and 0.9
    chain = [word() for _ in range(100)]
    for _ in range(12):  # each version is close to the one before only
        chain = edited(r, chain, 2).split()
        rows.append((next(ids), " ".join(chain)))
    rows += [(next(ids), t) for t in ("", None, " \n ", "one", "ONE", "two words", "a b c", "a b c", "A  b\tC")]
    r.shuffle(rows)
    return [(i, t, "x", 1, "y", True) for i, t in rows]


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, k):
    rows = corpus() + [(None, "a b c", "", 0, "", None), (None, None, "", 0, "", None)]
    got = near_components(spark.createDataFrame(rows, SCHEMA), k=k)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, k)


def test_blocks_alone_find_what_a_star_misses(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 1)
    monkeypatch.setattr(minhash, "BLOCK", 3000)
    rows = corpus(8)
    got = near_components(spark.createDataFrame(rows, SCHEMA), k=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 4)


def test_repeated_ids_and_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "", 0, "", None)] * 5 + [(3, "quite other words in here", "", 0, "", None), (2, text + " end", "", 0, "", None), (9, "quite other words in here", "", 0, "", None)]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_components(spark.createDataFrame(rows, SCHEMA), k=4).collect()}
    assert got == {(3, 2, False), (2, 2, True), (9, 2, False)}


def test_drop_near_copies_keeps_columns(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    out = drop_near_copies(df, k=5)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, _, kept in brute(rows, 5) if kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_components(df).count() == 0 and drop_near_copies(df).count() == 0


def test_sketch_fills_every_coordinate_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 1000, 20_000):
        a = np.unique(rng.integers(0, 2**63, n).astype(U))
        s = sketch(a)
        assert not (s == U(0xFFFFFFFFFFFFFFFF)).any() and (sketch(a[::-1].copy()) == s).all()
    errors = []
    for _ in range(200):
        both = rng.integers(0, 2**63, 400).astype(U)
        errors.append((sketch(mix64(both[:360])) == sketch(mix64(both[40:]))).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 1.2 * np.sqrt(0.16 / T)


def test_components_of_paths_stars_and_cliques(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, x) for x in range(1001, 1300)] + [(a, b) for a in range(500, 510) for b in range(a, 510)] + [(7_000_000_000, 3_000)]
    edges = [e if r.random() < 0.5 else e[::-1] for e in edges]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    want = {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)} | {i: 500 for i in range(500, 510)} | {7_000_000_000: 3000, 3000: 3000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_hot_bucket_is_not_expanded(spark):
    base = " ".join(f"w{i}" for i in range(60))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " end"), F.col("id").cast("string")).alias("text"))
    out = near_components(df, k=4)
    assert out.filter("component_id = 0").count() == 3000 and out.filter("kept").count() == 1
