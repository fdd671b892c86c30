"""The pipeline's stages: columns, effects, and whole against brute force where stages allow it."""

import hashlib
import re

import corpus_pipeline
from scrub.session import read_table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = read_table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "exact dedup":
            texts = [hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", r.text or "").encode()).digest() for r in docs.collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] > counts[1] > counts[2] >= counts[3] < counts[4]


def test_run_gives_token_ids(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-2:] == ["ids", "n_tokens"] and out.count() > 0
    assert out.filter("size(ids) <> n_tokens").count() == 0 and out.count() > out.select("doc_id").distinct().count()


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mix", "bpe"]


def test_stages_on_odd_rows_and_empty_tables(spark):
    extra = ["ids", "n_tokens", "_digest", "_keep", "_size", "_nth", "_score", "_lost", "_id", "_md5", "_copies", "id", "text_", "digest", "key", "size"]
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in extra)
    tail = tuple([None] * len(extra))
    texts = [None, "", " \n", "one", "plain words of a short text.", "plain words of a short text.", "long " * 40_000, "é日本😀 " * 50, "plain words of a short text"]
    rows = [(i, t, None, None if i % 2 else "s", None, *tail) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "no id here", None, None, None, *tail), (None, None, None, None, None, *tail), (3, "another text of id three", "en", "t", 1, *tail)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n, some = docs.count(), docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            if name == "bpe":
                assert out.columns == [*docs.columns, "ids_", "n_tokens_"]
            else:
                assert out.columns == docs.columns, name
            kept = out.collect()
            assert bool(kept) == bool(n), name
            some = spark.createDataFrame(kept, out.schema)
        if n:
            ids = {r.doc_id for r in kept}
            assert ids <= {r[0] for r in rows} and len(ids) > 2
