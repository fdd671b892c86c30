"""Token files: the coder, the format, damaged files, windows, and the digests against the library."""

import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrub.llm import rans, token_file
from scrub.llm.token_file import encoded, read_tokens, read_windows, token_digests, write_tokens
from scrub.llm.vocab import LibraryBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = LibraryBpe(open(PATH, encoding="utf-8").read())
ODD = [None, "", " ", "a<|endoftext|>b", "<|endoftext|>", "x" * 5000, "word " * 30000, "日本語 😀\x00\ufffd", "same", "same"]


def library(text, end=2):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = library(text)
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**32 - 1)), max_size=400), st.data())
def test_any_ids_round_trip(ids, data):
    ids = np.array(ids, np.uint32)
    table = rans.Table.of(ids)
    again = rans.Table.from_bytes(table.to_bytes())
    block = rans.encode(ids, table)
    assert (rans.decode(block, again) == ids).all()
    i = data.draw(st.integers(0, len(ids)))
    j = data.draw(st.integers(i, len(ids)))
    assert (rans.decode(block, again, i, j) == ids[i:j]).all()


@pytest.mark.parametrize("n", [rans.LANES * rans.STEPS + 1, rans.BLOCK - 1, rans.BLOCK])
def test_long_blocks_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint32)
    table = rans.Table.of(ids)
    assert table.freq.sum() == 1 << table.bits and table.freq.min() >= 1
    block = rans.encode(ids, table)
    share = np.bincount(ids) / n
    assert len(block) * 8 / n < 1.15 * -(share[share > 0] * np.log2(share[share > 0])).sum()
    for i, j in ((0, n), (n - 3, n), (n // 2, n // 2 + 5), (rans.LANES * rans.STEPS - 1, rans.LANES * rans.STEPS + 1)):
        assert (rans.decode(block, table, i, j) == ids[i:j]).all()


def test_as_many_symbols_as_ids():
    ids = np.random.default_rng(5).permutation(1 << 18).astype(np.uint32)
    table = rans.Table.of(ids)
    assert (rans.decode(rans.encode(ids, table), table) == ids).all()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=150))
def test_ids_as_the_library(text):
    assert ENCODER.encode(text).tolist() == library(text)[:-1]


def test_digests_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, start string").repartition(3)
    got = token_digests(df, PATH, 2).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected(list(enumerate(ODD)))


def test_digests_of_the_smallest_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.orderBy("doc_id").collect()
    assert [tuple(r) for r in token_digests(df, PATH, 2).orderBy("doc_id").collect()] == expected([(r.doc_id, r.text) for r in rows])


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "zz"), (3, "yy"), (3, "yy"), (-1, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in token_digests(df, PATH, 2).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [-1, 3, 3, 3, None]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)]).tolist()[:-1]
    assert sorted(r[3] for r in got) == sorted(crc(library(t)) for t in ("a b", "zz", "yy", "yy", None))
    assert token_digests(df.limit(0), PATH, 2).count() == 0


@pytest.fixture()
def files(spark, tmp_path):
    """Files of three partitions with sections of 5,000 ids, and all ids in a row."""
    rng = np.random.default_rng(11)
    rows = [(f"d{i:03d}", (rng.zipf(1.4, rng.integers(0, 900)) % 3000).tolist()) for i in range(120)] + [("e", (rng.zipf(1.2, 30000) % 900).tolist()), ("f", [])]
    path = f"file://{tmp_path}/tokens"
    write_tokens(spark.createDataFrame(rows, "doc_id string, ids array<int>").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id"), path, section=5000)
    return path, rows


def test_sections_and_pieces(spark, files):
    path, rows = files
    back = read_tokens(spark, path, "string", piece=9000)
    assert back.rdd.getNumPartitions() > 3
    got = back.orderBy("start", "doc_id").collect()
    assert [(r.doc_id, r.ids) for r in got] == rows
    assert [r.start for r in got] == np.cumsum([0, *(len(i) for _, i in rows)]).tolist()[:-1]


def test_windows(spark, files):
    path, rows = files
    ids = [i for _, d in rows for i in d]
    ask = [(0, 5), (4990, 30), (len(ids) - 3, 10), (len(ids), 4), (17, 0), (-1, 4), (None, 4), (100, len(ids)), (9000, 8000)]
    got = read_windows(spark.createDataFrame(ask, "begin long, n int"), path).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.begin, r.n, r.ids) for r in got), key=key) == sorted(((b, n, ids[b : b + n] if b is not None and b >= 0 else []) for b, n in ask), key=key)


@pytest.mark.parametrize("where", [0.01, 0.3, 0.6, 0.99])
def test_damage_is_noticed(spark, files, where):
    path, _ = files
    folder = Path(path.removeprefix("file://"))
    hurt = folder / json.loads((folder / token_file.MANIFEST).read_text())[0]["file"]
    data = bytearray(hurt.read_bytes())
    data[int(len(data) * where)] ^= 1
    hurt.write_bytes(data)
    with pytest.raises(Exception, match="match|token file|Invalid|invalid|corrupt"):
        read_tokens(spark, path, "string").collect()


def test_what_a_lost_attempt_left_is_not_read(spark, files):
    path, rows = files
    folder = Path(path.removeprefix("file://"))
    done = json.loads((folder / token_file.MANIFEST).read_text())[0]["file"]
    (folder / "part-000000-999-lost.ans").write_bytes((folder / done).read_bytes()[:100])
    assert read_tokens(spark, path, "string").count() == len(rows)


def test_order_of_the_encoded(spark):
    df = spark.range(2000).selectExpr("cast(1999 - id as long) as doc_id", "concat('text ', id) as text").repartition(5)
    assert [r.doc_id for r in encoded(df, PATH, None).select("doc_id").collect()] == list(range(2000))
