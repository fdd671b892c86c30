"""Byte-level BPE encoding and decoding with a public vocabulary file.

Each pre-token is a doubly linked list of symbols.  A priority queue holds the ranks of the adjacent pairs that can
merge; the lowest rank, leftmost first, is popped, entries that a merge has made stale are skipped, and the merged
symbol's two new pairs are pushed: O(n log n) for a pre-token of n bytes, however long.  Decoding concatenates the
vocabulary strings.  The vocabulary is read by the driver and broadcast, so executors need no file of their own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrub.llm.common import col, fresh, slices, small_batches, text_of

# Fixed value: the published pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same pattern for texts without characters past U+024F, with its classes written out: the standard engine is faster.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN_TOKEN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"

#: Pre-tokens of this many characters or fewer are remembered, MEMO of them in a generation.
MEMO_CHARS, MEMO = 32, 200_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def load_vocabulary(path: str) -> dict:
    """Vocabulary, merge ranks and added tokens of a byte-level BPE file, as plain picklable tables."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = {s: b for b, s in byte_symbols().items()}
    vocab = spec["model"]["vocab"]
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
    base = 1 + max(vocab.values())
    ranks = {vocab[a] * base + vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
    joined = [vocab[a + b] for a, b in pairs]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items() if s not in added}
    strings |= {i: s.encode() for s, i in added.items()}
    bytes_ids = [vocab[s] for _, s in sorted(byte_symbols().items())]
    key = hashlib.sha256(json.dumps(spec).encode()).hexdigest()
    return {"key": key, "base": base, "ranks": ranks, "joined": joined, "strings": strings, "bytes": bytes_ids, "added": added}


class _Memo(dict):
    """Ids of a pre-token as int32 bytes; a pre-token met again in the next generation moves on with it."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, token: str) -> bytes:
        ids = self.old.get(token) or self.make(token)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[token] = ids
        return ids


class Bpe:
    """Encoder and decoder over the tables of `load_vocabulary`."""

    def __init__(self, tables: dict):
        self.base, self.ranks, self.joined, self.bytes, self.added = (tables[k] for k in ("base", "ranks", "joined", "bytes", "added"))
        self.strings = [tables["strings"].get(i) for i in range(1 + max(tables["strings"]))]
        self.split, self.split_latin = regex.compile(PRE_TOKEN).findall, re.compile(LATIN_TOKEN).findall
        self.wide = re.compile("[^\x00-\u024f]").search
        by_length = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, by_length))) if by_length else None
        self.memo = _Memo(lambda token: np.array(self.merge(token), np.int32).tobytes())

    def merge(self, token: str) -> list[int]:
        """Ids of a pre-token.  A queue entry is rank << 32 | place; it is stale unless `rank` still says so of its place."""
        ids = [self.bytes[b] for b in token.encode("utf-8")]
        n, base, ranks, joined = len(ids), self.base, self.ranks, self.joined
        rank = [ranks.get(a * base + b, -1) for a, b in zip(ids, ids[1:])] + [-1]
        queue = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = ranks.get
        while queue:
            e = heappop(queue)
            i = e & 0xFFFFFFFF
            r = e >> 32
            if rank[i] != r:
                continue
            new = ids[i] = joined[r]
            j = after[i]
            rank[j] = rank[i] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank[i] = get(new * base + ids[k], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = rank[h] = get(ids[h] * base + new, -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def ordinary(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, (self.split if self.wide(text) else self.split_latin)(text)))

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            parts += [self.ordinary(text[at : m.start()]), np.int32(self.added[m[0]]).tobytes()]
            at = m.end()
        parts.append(self.ordinary(text[at:] if at else text))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


_WORKER: dict[str, Bpe] = {}


def worker_bpe(key: str, tables) -> Bpe:
    """The worker's encoder, which outlives its tasks, so that what it remembers serves the next one."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Bpe(tables.value)
    return _WORKER[key]


def shared_tables(spark: SparkSession, path: str):
    """Broadcast of the vocabulary's tables: a fixed public file of a few MB, never data."""
    return spark.sparkContext.broadcast(load_vocabulary(path))


def encode(docs: DataFrame, tables, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """`docs` with `ids_col` array<int>: the token ids of the whole text.

    Null and empty texts give an empty array.  Strings of added tokens in a text become their ids.  Rows are
    independent: no shuffle, repeated rows each get their ids, other columns pass through.
    """

    key = tables.value["key"]
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(key, tables)

        def part(some: pa.Array) -> pa.Array:
            ids = [bpe.encode(t) for t in some.to_pylist()]
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)], dtype=np.int32)), pa.array(np.concatenate(ids)))

        return slices(texts, part)

    return docs.withColumn(ids_col, run(text_of(text_col)))


def decode(docs: DataFrame, tables, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`docs` with `text_col`: the text of the ids; null and empty arrays give the empty text.

    Bytes that are no UTF-8 become U+FFFD.  An id that the vocabulary lacks raises an error.
    """

    key = tables.value["key"]

    @F.arrow_udf("string")
    def run(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = worker_bpe(key, tables)

        def part(some: pa.Array) -> pa.Array:
            ends, values = some.offsets.to_numpy(), some.values.to_numpy(zero_copy_only=False)
            return pa.array([bpe.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

        return slices(ids, part)

    return docs.withColumn(text_col, run(F.col(ids_col)))


def encoded_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_tokens, ids_sha256, decoded_sha256), from `encode` and `decode`."""
    tables = shared_tables(docs.sparkSession, path)
    slim = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    both = decode(encode(slim, tables), tables)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pipeline's last stage: every column of `docs` plus ids and n_tokens, under free names if these are taken."""
    tables = shared_tables(docs.sparkSession, path)
    ids, n = fresh(docs, "ids"), fresh(docs, "n_tokens")
    return encode(docs, tables, text_col, ids).withColumn(n, F.size(ids).cast("long"))
