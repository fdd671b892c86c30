"""The encoder against the tokenizers library, and round trips."""

import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrub.llm.bpe import Bpe, decode, encode, encoded_documents, load_vocabulary, shared_tables, tokenised

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
BPE = Bpe(load_vocabulary(PATH))
TRICKY = [
    "", " ", "\n\n  x", "don't we'll I'm", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext", "\x1c\x1d a\x85b\u2028c\u3000d\u00a0e", "日本語 текст ñandú 😀👩‍👩‍👧",
    "x" * 3000, "ab" * 5000, " " * 500, "1234567890" * 50, "\x00\x01\ufffd", "e\u0301 \u0301", "'S 'T 're", "\t\tif x:\r\n\r\n", "a\u200bb", "½ Ⅷ ٣",
]


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert BPE.encode(text).tolist() == ids
    assert BPE.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_tricky_texts_as_the_library():
    for t in TRICKY:
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_as_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="the aing'sTION \n\u00e9\u00e8\u3000.,!#1", max_size=300))
def test_prose_like_text_as_the_library(text):
    same(text)


def test_every_sf_document(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in encoded_documents(spark.createDataFrame(rows), PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        o = got[r.doc_id]
        assert (o.n_tokens, o.ids_sha256, o.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "hi", "b"), (1, "hi", "b"), (None, "", None)], "doc_id long, text string, ids string")
    tables = shared_tables(spark, PATH)
    both = decode(encode(df, tables, ids_col="tokens"), tables, "tokens").collect()
    assert sorted((r.text or "", r.decoded, tuple(r.tokens)) for r in both) == [("", "", ()), ("", "", ()), ("hi", "hi", (5303,)), ("hi", "hi", (5303,))]
    out = tokenised(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "ids_", "n_tokens"] and out.count() == 4
    assert encoded_documents(df.limit(0), PATH).count() == 0
