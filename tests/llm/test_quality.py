"""The additive model: held-out accuracy, tables, edges."""

import numpy as np
import pytest

from scrub.llm.quality import FEATURES, THRESHOLD, _tree, feature_matrix, fit, keep_good, quality_scores, train

SCHEMA = "doc_id long, text string, score string, predicted int, y int"
SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 300 and out.held_out.mean() == pytest.approx(0.2, abs=0.03)
    assert (held.predicted == held.quality).mean() > 0.97
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert (held[held.quality == 1].predicted == 1).mean() > 0.99  # clean documents stay


def test_labels_of_held_out_rows_are_not_learnt(spark):
    import zlib

    ids = [i for i in range(400)]
    text = lambda i: "good prose of words." if i % 2 else "### $$$ %%%"
    flipped = lambda i: i % 2 if zlib.crc32(str(i).encode()) % 5 else 1 - i % 2
    docs = spark.createDataFrame([(i, text(i), "", 0, 0) for i in ids], SCHEMA)
    labels = spark.createDataFrame([(i, flipped(i)) for i in ids], "doc_id long, quality int")
    for r in quality_scores(docs, labels).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.score > 0.9) == bool(r.doc_id % 2) and r.predicted == (r.score >= THRESHOLD)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "", 0, 0), (2, "", "", 0, 0), (2, "", "", 0, 0), (None, "x" * 200_000, "", 0, 0), (3, "\x00퟿ é", "", 0, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_scores(docs, none).collect()
    assert [r.score for r in out] == [0.5] * 5 and {r.predicted for r in out} == {1}
    odd = spark.createDataFrame([(1, None), (1, 1), (1, 0), (2, 7), (None, 1), (3, 1)], "doc_id long, quality int")
    out = quality_scores(docs, odd).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    kept = keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality_scores(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word ', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    model = train(docs, labels, rows=100)
    assert all(len(t) == len(e) + 1 for t, e in zip(model.tables, model.edges)) and len(model.tables) == len(FEATURES)


def test_features_of_any_text_are_finite():
    x = feature_matrix(["", " ", "\n" * 50, "a", "日本" * 5000, "To " * 999, "A|B|C", "😀"])
    assert np.isfinite(x).all() and x.shape == (8, len(FEATURES))


def test_pairs_learn_what_single_tables_cannot():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_tree_splits_where_the_gradient_turns():
    g = np.array([-1.0] * 10 + [2.0] * 10)
    out = _tree(g, np.ones(20), 2)
    assert (out[:10] < 0).all() and (out[10:] > 0).all() and len(set(out)) == 2
