"""Texts encoded together: the library's ids, each different pre-token looked up once."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from scrub.llm.vocab import LibraryBpe

SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
BITS = [*"' \n\tazrels9!?", "'s", "'re", "'ll", "'d", "  ", "12", "\x1c", "\x00", "\x85", "\xa0", " \xa0", "ä", "ɏ", "ɐ", "²", "中", "👍", "<|endoftext|>", " '", "''"]


def test_ids_are_the_librarys_on_random_texts():
    rnd, bpe = random.Random(7), LibraryBpe(SPEC)
    for _ in range(400):
        texts = ["".join(rnd.choices(BITS, k=rnd.randrange(14))) for _ in range(rnd.randrange(10))]
        got = bpe.encode_all(pa.array(["dropped", *texts], pa.string()).slice(1))
        want = [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == want, texts


def test_a_pre_token_is_looked_up_once():
    bpe, asked = LibraryBpe(SPEC), []

    class Asked(dict):
        def __missing__(self, token):
            asked.append(token)
            return bpe.ids_of(token)

    bpe.memo = Asked()
    got = bpe.encode_all(pa.array(["one two don't", "one two", "two two two", "naïve two"]))
    assert sorted(asked) == sorted(["one", " two", " don", "'t", "two", "naïve"])
    assert got[1] == b"".join(bpe.ids_of(t) for t in ("one", " two"))
