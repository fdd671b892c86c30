"""Encoders of public tokenizer files: the tokenizers and sentencepiece libraries, held once a Python worker.

The driver reads a file once and broadcasts its bytes, so executors need no file of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from dataclasses import dataclass
from operator import attrgetter

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from scrub.llm.bpe import _L, _N, _S, LATIN_TOKEN, PRE_TOKEN, _Memo, byte_symbols


_ID = attrgetter("id")

#: Classes of the characters up to U+024F as LATIN_TOKEN has them: other, letter, digit, white space.
_SPACE = 3
_CLASS = np.array([next((k for k, c in enumerate((_L, _N, _S), 1) if re.match(f"[{c}]", chr(i))), 0) for i in range(0x250)], np.uint8)

#: What may follow the apostrophe of a contraction, by its first letter.
_ONE, _TWO = b"stmd", {b"r": b"e", b"v": b"e", b"l": b"l"}


def latin_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts without characters past U+024F begin: `data` is their UTF-8 in a row, `ends` where each ends.

    LATIN_TOKEN without a regex.  Runs of a class are pre-tokens, but: the last white space before something else stands
    alone, and if it is a space it begins what follows; an apostrophe that is a run by itself, without a space that it
    takes, begins a contraction.
    """
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC2)
    kind[lead] = kind[lead + 1] = _CLASS[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
    first = np.zeros(n + 1, bool)  # the first byte of a text, and the end of all
    first[0] = True
    first[ends] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts = run.copy()
    space = kind == _SPACE
    # The last of a white run, with something of the same text behind it.
    last = np.flatnonzero(space & run[1:] & ~first[1:])
    starts[last - (data[last] >= 0x80)] = True
    plain = last[data[last] == 32]
    starts[plain + 1] = False
    # Contractions: what is left of apostrophes that start a pre-token and are a run of one.
    quote = np.flatnonzero(data == 39)
    quote = quote[starts[quote] & run[quote + 1] & ~first[quote + 1]]
    if len(quote):
        after = data[quote + 1]
        for c in _ONE:
            starts[quote[after == c] + 1] = False
            starts[quote[after == c] + 2] = True
        for c, second in _TWO.items():
            q = quote[after == c[0]]
            q = q[~first[q + 2]]
            q = q[data[q + 2] == second[0]]
            starts[q + 1] = False
            starts[q + 3] = True
    return np.flatnonzero(starts[:n])


class LibraryBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file with add_special_tokens=False.

    The library's own model merges each pre-token; what it made of a short one is remembered, as in `bpe`.  A file
    whose pre-tokens this module doesn't cut itself (a normaliser, another pattern, a prefix space) is left to the
    library whole.  `plain` takes the strings of added tokens in a text as ordinary text.
    """

    def __init__(self, spec: str, plain: bool = False):
        said = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = plain
        self.library.no_truncation()
        self.library.no_padding()
        pre = said.get("pre_tokenizer") or {}
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = said.get("added_tokens", [])
        self.whole = not usual or bool(said.get("normalizer")) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        self.added = {t["content"]: t["id"] for t in added}
        by_length = sorted(self.added, key=len, reverse=True)
        self.special = None if plain or not by_length else re.compile("|".join(map(re.escape, by_length)))
        self.special_bytes = self.special and re.compile(self.special.pattern.encode())
        self.split, self.split_latin = regex.compile(PRE_TOKEN).findall, re.compile(LATIN_TOKEN).findall
        self.wide = re.compile("[^\x00-ɏ]").search
        self.symbols = dict(byte_symbols())
        self.space = self.symbols[0x20]
        self.merge = self.library.model.tokenize
        self.memo = _Memo(self.ids_of)
        to_byte = {s: b for b, s in self.symbols.items()}
        vocab = said["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        #: The bytes of each id; None for ids without an entry.
        self.strings: list[bytes | None] = [None] * self.size
        for s, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        for s, i in self.added.items():
            self.strings[i] = s.encode()

    def ids_of(self, token: str) -> bytes:
        # Letters and digits of ASCII stand for themselves, and a space before them has one symbol.
        word = token[1:] if token[0] == " " else token
        if word.isascii() and word.isalnum():
            said = word if word is token else self.space + word
        else:
            said = token.encode("utf-8").decode("latin-1").translate(self.symbols)
        return array("i", map(_ID, self.merge(said))).tobytes()

    def ordinary(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, (self.split if self.wide(text) else self.split_latin)(text)))

    def encode(self, text: str) -> np.ndarray:
        if self.whole:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [self.ordinary(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        parts.append(self.ordinary(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), np.int32)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (string, no nulls) as little-endian 32-bit integers.

        Texts without characters past U+024F or added tokens are cut together, and each different pre-token of them is
        looked up once.
        """
        strings = texts.cast(pa.large_string())
        if self.whole:
            return [self.encode(t).astype("<i4").tobytes() for t in strings.to_pylist()]
        _, offsets, data = strings.buffers()
        ends = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
        data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        wide = np.flatnonzero(data >= 0xC9)
        wide = wide[(data[wide] > 0xC9) | (data[np.minimum(wide + 1, len(data) - 1)] >= 0x90)]
        special = [m.start() for m in self.special_bytes.finditer(data)] if self.special else []
        aside = set(np.searchsorted(ends, np.concatenate([wide, np.array(special, np.int64)]), "right") - 1)
        out = {i: self.encode(strings[i].as_py()).astype("<i4").tobytes() for i in map(int, aside)}
        rest = [i for i in range(len(strings)) if i not in out]
        if out:
            data = np.concatenate([data[:0], *(data[ends[i] : ends[i + 1]] for i in rest)])
            ends = np.cumsum([0, *(ends[i + 1] - ends[i] for i in rest)])
        starts = latin_starts(data, ends[1:])
        cut = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        words = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([*map(self.memo.__getitem__, words)], pa.large_binary()).take(cut.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int64)[ids.offset :][np.searchsorted(starts, ends)].tolist()
        found = memoryview(data or b"")
        out.update((i, bytes(found[a:b])) for i, a, b in zip(rest, at, at[1:]))
        return [out[i] for i in range(len(strings))]


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of each id (U+2581 as a space, <0xHH> as a byte)."""

    def __init__(self, proto: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = self.library.get_piece_size()
        piece = self.library.id_to_piece
        self.strings = [bytes([int(piece(i)[3:5], 16)]) if self.library.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.size)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


_WORKER: dict[tuple, object] = {}


@dataclass(frozen=True)
class Shared:
    """A broadcast file under the digest of its bytes: a fixed public file of a few MB, never data."""

    key: str
    file: Broadcast

    def encoder(self, kind: type, *how):
        """The worker's encoder of this file, which outlives its tasks, so that what it remembers serves the next."""
        key = (kind, self.key, how)
        if key not in _WORKER:
            for old in [k for k in _WORKER if k[0] is kind]:
                del _WORKER[old]
            _WORKER[key] = kind(self.file.value, *how)
        return _WORKER[key]


def share(spark: SparkSession, path: str, binary: bool = False) -> Shared:
    with open(path, "rb") as f:
        read = f.read()
    return Shared(hashlib.sha256(read).hexdigest(), spark.sparkContext.broadcast(read if binary else read.decode("utf-8")))
