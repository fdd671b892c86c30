"""The alignment against brute force over the libraries' own tokens."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scrub.llm import alignment
from scrub.llm.alignment import align, alignment_digests, alignments, gallop
from scrub.llm.bpe import byte_symbols
from scrub.llm.vocab import LibraryBpe

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
A.encode_special_tokens = True
BYTE = {s: b for b, s in byte_symbols().items()}

ODD = [
    None, "", " ", "a", "  two  spaces ", "\n\nline\n", "<|endoftext|> and <s> </s> <unk> <0x41>", "a▁b", "日本語 текст ñandú 😀👩‍👩‍👧", "x" * 3000, "ab " * 2000, "\x00\x01�", "é",
    "token token token", "token token token", "1234567890 " * 40, " 　 ",
]


def ends(strings):
    return np.cumsum([len(s) for s in strings]).tolist()


def plain(texts):
    """Per text (a ids, b ids, groups, links), from the libraries, by walking over all ends."""
    out = []
    for t in texts:
        if not t:
            out.append(([], [], [], []))
            continue
        a = A.encode(" " + t, add_special_tokens=False).ids
        b = B.encode(t)
        as_ = [bytes(BYTE[c] for c in A.id_to_token(i)) for i in a]
        bs = [bytes([int(p[3:5], 16)]) if B.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [B.id_to_piece(i)]]
        if not b"".join(as_) == b"".join(bs) == (" " + t).encode():
            out.append(([], [], [], []))
            continue
        ea, eb = ends(as_), ends(bs)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        out.append((a, b, groups, [(g[0][-1], g[1][-1]) for g in groups]))
    return out


def expected(texts):
    found = plain(texts)
    count = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    rows = []
    for a, b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 500)), st.sets(st.integers(0, 500)))
def test_gallop_is_a_rank(x, y):
    x, y = np.array(sorted(x), np.int64), np.array(sorted(y), np.int64)
    assert gallop(x, y).tolist() == np.searchsorted(y, x).tolist()


def test_gallop_over_long_runs():
    rng = np.random.default_rng(3)
    for n, m in ((200_000, 90_000), (90_000, 200_000), (3, 100_000), (100_000, 3)):
        x, y = (np.unique(rng.integers(0, 1 << 20, k)) for k in (n, m))
        assert (gallop(x, y) == np.searchsorted(y, x)).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_groups_and_overlaps_of_any_two_cuts(x, y):
    short, long = sorted((x, y), key=sum)
    short = [*short, sum(long) - sum(short)] if sum(short) < sum(long) else short
    for a, b in ((short, long), (long, short)):
        size = np.arange(1 + max(a + b), dtype=np.int64)
        got = align([np.array(a, np.int32)], [np.array(b, np.int32)], size, size)
        ea, eb = np.cumsum(a).tolist(), np.cumsum(b).tolist()
        common = sorted(set(ea) & set(eb))
        assert got.at_a.tolist() == [ea.index(e) for e in common] and got.at_b.tolist() == [eb.index(e) for e in common]
        lo, hi = got.overlaps()
        for i, (s, e) in enumerate(zip([0, *ea], ea)):
            share_ = [j for j, (u, v) in enumerate(zip([0, *eb], eb)) if u < e and s < v]
            assert (lo[i], hi[i]) == (share_[0], share_[-1] + 1)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=120))
def test_plain_text_ids_as_the_library(text):
    encoder = ENCODER.setdefault("plain", LibraryBpe(open(A_PATH, encoding="utf-8").read(), True))
    assert encoder.encode(text).tolist() == A.encode(text, add_special_tokens=False).ids


ENCODER: dict = {}


@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 0])
def test_digests_of_odd_texts(spark, pairs):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, pairs string")
    got = alignment_digests(df, A_PATH, B_PATH, broadcast_pairs=pairs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected(ODD)


@pytest.mark.parametrize("pairs", [alignment.BROADCAST_PAIRS, 0])
def test_digests_of_the_smallest_documents(spark, pairs):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = df.orderBy("doc_id").collect()
    got = alignment_digests(df, A_PATH, B_PATH, broadcast_pairs=pairs).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == expected([r.text for r in rows])


def test_counts_handed_on_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    held = [(rng.integers(0, 5000, 700), np.ones(700, np.int64)) for _ in range(40)]
    monkeypatch.setattr(alignment, "COUNTED", 1000)
    got = Counter()
    for code, n in alignment._totals(held):
        got.update(dict(zip(code.tolist(), n.tolist())))
    assert got == Counter(c for code, _ in held for c in code.tolist())


def test_null_and_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "token"), (1, "token"), (1, "token"), (2, None)], "doc_id long, text string")
    got = sorted(alignment_digests(df, A_PATH, B_PATH).collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [(r.doc_id, r.n_links, r.n_best, r.count_sum) for r in got] == [(None, 1, 1, 3), (1, 1, 1, 3), (1, 1, 1, 3), (2, 0, 0, 0)]
    for pairs in (0, 9):
        assert alignment_digests(df.limit(0), A_PATH, B_PATH, broadcast_pairs=pairs).count() == 0


def test_whole_alignments(spark):
    texts = ["Alignment of tokenizers", None, "ab ab  ab\n", "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r, (a, b, groups, _) in zip(alignments(df, A_PATH, B_PATH).orderBy("doc_id").collect(), plain(texts)):
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [(a[g.a_from : g.a_to], b[g.b_from : g.b_to]) for g in r.groups] == groups
        assert len(r.overlaps) == len(a) and (not a or r.groups[-1].byte_end == len((" " + texts[r.doc_id]).encode()))
