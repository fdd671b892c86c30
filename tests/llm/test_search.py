"""Ranked search against scoring every document, and what the dual tree leaves out."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrub.llm import search as module
from scrub.llm.search import Items, _Search, search, stretches

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    """(item number, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, (_, text) in enumerate(items):
        scores = []
        for doc, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def found(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    return sorted((r.item, r.rank, r.doc_id, r.score) for r in search(d, i, **how).collect())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_terms(text):
    assert [t.decode() for part in stretches(text.encode()) for t in part] == terms_of(text)


def test_terms_of_a_long_text(monkeypatch):
    monkeypatch.setattr(module, "STRETCH", 50)
    text = "Über-straße ÀB9_c " * 200 + "x" * 300 + " end"
    assert [t.decode() for part in stretches(text.encode()) for t in part] == terms_of(text)


def words(rng, n, zipf=1.3):
    return " ".join(f"w{x % 400}" for x in rng.zipf(zipf, n))


def test_random_documents(spark):
    rng = np.random.default_rng(7)
    items = [(i, words(rng, 30)) for i in range(70)]
    docs = [(i, words(rng, int(rng.integers(0, 200))) + (" " + items[i % 70][1] if i % 9 == 0 else "")) for i in range(3000)]
    assert found(spark, docs, items) == plain(docs, items)


def test_ties_repeats_nulls_and_odd_items(spark):
    docs = [(5, "same words"), (5, "same words"), (None, "same words"), (3, "same words"), (9, None), (10, ""), (11, "..."), (12, "É other É é")] + [(100 + i, "same words") for i in range(40)]
    items = [(1, "Same"), (1, "Same"), (2, None), (None, "é É"), (3, ""), (4, "absent"), (5, "same words same other")]
    ordered = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert found(spark, docs, items) == plain(docs, ordered)
    assert found(spark, docs, items, k=3, first=1) == plain(docs, ordered, 3)


def test_blocks_of_items_and_chunks_of_columns(spark, monkeypatch):
    rng = np.random.default_rng(8)
    items = [(i, words(rng, 20)) for i in range(50)]
    docs = [(i, words(rng, 60)) for i in range(300)]
    want = plain(docs, items)
    monkeypatch.setattr(module, "CELL", 8)
    monkeypatch.setattr(module, "ITEMS", 16)
    assert found(spark, docs, items) == want
    monkeypatch.setattr(module, "TERMS", 10)
    assert found(spark, docs[:40], items) == plain(docs[:40], items)


def test_empty_tables(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert found(spark, docs, []) == found(spark, [], items) == found(spark, docs, [(1, None)]) == []


@pytest.mark.parametrize("columns", [4096, 7])
def test_the_tree_prunes_and_stays_exact(columns, monkeypatch):
    monkeypatch.setattr(module, "COLUMNS", columns)
    rng = np.random.default_rng(9)
    n_items, n_terms, n_docs = 60, 300, 4000

    class Row:
        def __init__(self, item, terms):
            self.item, self.terms = item, terms

    rows = [Row(i, [b"t%03d" % t for t in rng.choice(n_terms, 12, replace=False)]) for i in range(n_items)]
    items = Items.of(rows)
    weight = rng.integers(1, 9000, len(items.vocabulary))
    search_ = _Search(items, weight, n_docs, 50 * n_docs, 5, np.zeros(n_items, np.int64))
    counts = np.zeros((n_docs, len(items.vocabulary)), np.int64)
    for d in range(n_docs):
        # Half of the documents are copies of twenty kinds: those lie together in a tree.
        hold = items.terms[d % 20] if d % 2 else rng.choice(len(items.vocabulary), 6, replace=False)
        counts[d, hold] = 1 + (d % 3)
    n = np.full(n_docs, 50)
    for a in range(0, n_docs, 1000):
        row, term = np.nonzero(counts[a : a + 1000])
        search_.batch(np.arange(a, a + 1000), np.zeros(1000, np.int8), n[a : a + 1000], row, term, counts[a : a + 1000][row, term])
    impact = weight * np.where(counts > 0, 10**9 * counts // (1000 * counts + 8 * (10 + 90 * n * n_docs // (50 * n_docs))[:, None]), 0)
    for i, terms in enumerate(items.terms):
        score = impact[:, terms].sum(1)
        best = sorted(range(n_docs), key=lambda d: (-score[d], d))[:5]
        assert search_.score[i].tolist() == [score[d] for d in best if score[d] > 0] + [0] * sum(score[d] == 0 for d in best)
        assert search_.doc[i].tolist()[: (score[best] > 0).sum()] == [d for d in best if score[d] > 0]
    assert search_.scored < 0.5 * search_.seen
