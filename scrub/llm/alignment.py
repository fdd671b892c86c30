"""Cross-tokenizer alignment: where the tokens of two vocabularies end together in a text.

Both token sequences of a text spell the same bytes, so each is a rising list of end offsets.  The shorter list drives
a galloping intersection: each of its ends is searched in the longer list by exponential steps from the place of the
end before it, then by halving.  Ends found in both cut the tokens into groups, whose bounds are the ranks found; the
differences of consecutive ranks say which tokens of the other side a token overlaps.

A link is a pair of token occurrences whose byte ranges end together.  Links of an id pair are counted over the corpus:
tasks count what they hold, one aggregate adds up, and documents meet the counts either as a broadcast, where the pairs
are few enough, or by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scrub.llm.common import Scratch, attach, col, slices, small_batches, text_of
from scrub.llm.vocab import LibraryBpe, Pieces, share

#: Distances between the ends that gallop in one vector step; each starts from the place of the nearest one before it.
STRIDES = (1 << 15, 1 << 12, 1 << 9, 1 << 6, 1 << 3, 1)

#: Most id pairs whose counts are broadcast (16 bytes each); beyond, documents meet the counts by a join.
BROADCAST_PAIRS = 4_000_000

#: Pairs that a task counts before it hands them on.
COUNTED = 1 << 20


def _search(keys: np.ndarray, base: np.ndarray, into: np.ndarray) -> np.ndarray:
    """How many of `into` (rising) are below each key, all before `base` being so: doubling steps, then halving."""
    base, top = base.copy(), np.full(len(keys), len(into))
    open_, step = np.arange(len(keys)), 1
    while open_.size:
        probe = base[open_] + (step - 1)
        inside = probe < len(into)
        open_, probe = open_[inside], probe[inside]
        below = into[probe] < keys[open_]
        top[open_[~below]] = probe[~below]
        open_ = open_[below]
        base[open_] = probe[below] + 1
        step *= 2
    open_ = np.flatnonzero(base < top)
    while open_.size:
        lo, hi = base[open_], top[open_]
        mid = (lo + hi) >> 1
        below = into[mid] < keys[open_]
        base[open_] = np.where(below, mid + 1, lo)
        top[open_] = np.where(below, hi, mid)
        open_ = open_[base[open_] < top[open_]]
    return base


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each of `keys` (rising), how many of `into` (rising) are below it."""
    found, past = np.zeros(len(keys), np.int64), 0
    for stride in STRIDES:
        at = np.arange(0, len(keys), stride)
        if past:
            at = at[at % past != 0]
            found[at] = _search(keys[at], found[at // past * past], into)
        else:
            found[at] = _search(keys[at], np.zeros(len(at), np.int64), into)
        past = stride
    return found


@dataclass
class Alignment:
    """Tokens of some texts in a row: `a` and `b` (ids), where each text's begin, and the places of common ends in both."""

    a: np.ndarray
    b: np.ndarray
    a_from: np.ndarray
    b_from: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray

    def overlaps(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token of `a` the range of tokens of `b` whose bytes it shares, as places from and up to (exclusive).

        The ranks say how many ends of `b` lie below an end of `a`; those at or below the end before it are out.
        """
        if len(self.a_ends) <= len(self.b_ends):
            below = gallop(self.a_ends, self.b_ends)
        else:
            # Ranks of b's ends in a, turned round: the b ends of rank i or less, without those equal to a's i-th.
            below = np.cumsum(np.bincount(gallop(self.b_ends, self.a_ends), minlength=len(self.a_ends)))[: len(self.a_ends)]
            below[self.at_a] -= 1
        upto = below.copy()
        upto[self.at_a] += 1
        return np.concatenate([[0], upto[:-1]]).astype(np.int64), below + 1


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Alignment:
    """Alignment of texts whose two token lists spell equal bytes; `*_sizes` are the bytes of each id, none zero."""
    a, b = (np.concatenate([np.zeros(0, np.int32), *ids]) for ids in (a_ids, b_ids))
    a_from, b_from = (np.cumsum([0, *map(len, ids)], dtype=np.int64) for ids in (a_ids, b_ids))
    # One byte axis for all texts: each ends where the next begins, at a common end.
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    short, long = (a_ends, b_ends) if len(a_ends) <= len(b_ends) else (b_ends, a_ends)
    rank = gallop(short, long)
    same = rank < len(long)
    same[same] = long[rank[same]] == short[same]
    here, there = np.flatnonzero(same), rank[same]
    at_a, at_b = (here, there) if short is a_ends else (there, here)
    return Alignment(a, b, a_from, b_from, a_ends, b_ends, at_a, at_b)


class _Aligner:
    """Both encoders of a worker, and the decimal ids with the separators that may follow them."""

    def __init__(self, shared_a, shared_b):
        self.first, self.second = shared_a.encoder(LibraryBpe, True), shared_b.encoder(Pieces)
        sizes = [np.array([len(s or b"") for s in e.strings], np.int64) for e in (self.first, self.second)]
        self.a_sizes, self.b_sizes = sizes
        self.n_b = len(self.b_sizes)
        # Ids of either side, followed by "," or by what ends their run in a group.
        self.a_text = [b"%d%b" % (i, end) for i in range(len(self.a_sizes)) for end in (b",", b"|")]
        self.b_text = [b"%d%b" % (i, end) for i in range(self.n_b) for end in (b",", b";")]
        self.text = self.a_text + self.b_text

    def texts(self, texts: list[str]) -> Alignment:
        """Texts that are empty or spelled otherwise by one of the two have no tokens."""
        spell_a, spell_b = self.first.strings.__getitem__, self.second.strings.__getitem__
        none = np.zeros(0, np.int32)
        both = []
        for text, b in zip(texts, self.second.encode(texts)):
            if not text:
                both.append((none, none))
                continue
            whole, a = (" " + text).encode(), self.first.encode(" " + text)
            fits = b"".join(map(spell_b, b)) == whole and b"".join(map(spell_a, a.tolist())) == whole
            both.append((a, np.array(b, np.int32)) if fits else (none, none))
        return align([a for a, _ in both], [b for _, b in both], self.a_sizes, self.b_sizes)

    def spelled(self, x: Alignment) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`: ids of a group's first side, then those of its second."""
        last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
        last_a[x.at_a] = 1
        last_b[x.at_b] = 1
        n_a, n_b = np.diff(x.at_a, prepend=-1), np.diff(x.at_b, prepend=-1)
        before_b, upto_a = np.concatenate([[0], x.at_b[:-1] + 1]) if len(x.at_b) else x.at_b, x.at_a + 1
        code = np.empty(len(x.a) + len(x.b), np.int64)
        code[np.arange(len(x.a)) + np.repeat(before_b, n_a)] = 2 * x.a.astype(np.int64) + last_a
        code[np.arange(len(x.b)) + np.repeat(upto_a, n_b)] = 2 * x.b.astype(np.int64) + last_b + len(self.a_text)
        cuts = (x.a_from + x.b_from).tolist()
        return [b"".join(map(self.text.__getitem__, code[i:j].tolist()))[:-1] for i, j in zip(cuts, cuts[1:])]


GROUPS = "array<struct<a_from:int,a_to:int,b_from:int,b_to:int,byte_end:long>>"
ALIGNED = f"a_ids array<int>, b_ids array<int>, groups {GROUPS}, overlaps array<struct<b_from:int,b_to:int>>"


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, a_ids, b_ids, groups, overlaps).

    `a_ids` are the ids of a space and the text by the byte-level BPE file, `b_ids` those of the text by the
    sentencepiece model.  A group holds the tokens `a_from` to `a_to` (exclusive) and `b_from` to `b_to` up to a common
    end `byte_end`; `overlaps` has for each token of `a_ids` the tokens of `b_ids` that share bytes with it.  Null and
    empty texts, and texts that either tokenizer spells otherwise, have empty arrays.  Rows are independent: repeated
    rows each get theirs, other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    first, second = share(spark, a_path), share(spark, b_path, binary=True)
    ddl = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {ALIGNED}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(first, second)

        def part(some: pa.RecordBatch) -> pa.RecordBatch:
            x = aligner.texts(some.column(1).to_pylist())
            groups = np.searchsorted(x.at_a, x.a_from)
            out: list[list] = [[], [], [], []]
            ends = np.concatenate([[0], x.a_ends])
            lo, hi = x.overlaps()
            for k in range(len(some)):
                a0, a1, b0, b1 = x.a_from[k], x.a_from[k + 1], x.b_from[k], x.b_from[k + 1]
                to_a, to_b = (at[groups[k] : groups[k + 1]] + 1 for at in (x.at_a, x.at_b))
                bounds = zip([0, *(to_a - a0)[:-1]], to_a - a0, [0, *(to_b - b0)[:-1]], to_b - b0, ends[to_a] - ends[a0])
                out[0].append(x.a[a0:a1])
                out[1].append(x.b[b0:b1])
                out[2].append([dict(zip(("a_from", "a_to", "b_from", "b_to", "byte_end"), map(int, g))) for g in bounds] if a1 > a0 else [])
                out[3].append([{"b_from": int(i - b0), "b_to": int(j - b0)} for i, j in zip(lo[a0:a1], hi[a0:a1])])
            return pa.RecordBatch.from_arrays([some.column(0), *(pa.array(o, schema.field(i + 1).type) for i, o in enumerate(out))], schema=schema)

        return slices(batches, part)

    small_batches(spark)
    return docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, ddl)


def _linked(docs: DataFrame, first, second, scratch: Scratch) -> DataFrame:
    """Written: a row's counts and digest, with its different links (`pairs`, rising codes) and how often it has each."""
    ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_a long, n_b long, n_links long, groups_sha256 string, pairs binary, times binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(first, second)

        def part(some: pa.RecordBatch) -> pa.RecordBatch:
            x = aligner.texts(some.column(1).to_pylist())
            links = np.searchsorted(x.at_a, x.a_from)
            pair = x.a[x.at_a].astype(np.int64) * aligner.n_b + x.b[x.at_b]
            pairs, times = [], []
            for i, j in zip(links, links[1:]):
                code, n = np.unique(pair[i:j], return_counts=True)
                pairs.append(code.tobytes())
                times.append(n.astype(np.int32).tobytes())
            digests = [hashlib.sha256(s).hexdigest() if s else "" for s in aligner.spelled(x)]
            columns = [some.column(0), pa.array(np.diff(x.a_from)), pa.array(np.diff(x.b_from)), pa.array(np.diff(links)), pa.array(digests), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        return slices(batches, part)

    small_batches(docs.sparkSession)
    return scratch.save(docs.mapInArrow(run, ddl))


def _totals(held: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes with their counts added up, COUNTED or so at a time, whatever a task holds."""
    codes, counts, size = [], [], 0

    def merged():
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)

    for code, n in held:
        codes.append(code)
        counts.append(n)
        size += len(code)
        if size >= 2 * COUNTED:
            code, n = merged()
            if len(code) >= COUNTED:
                yield code, n
                code, n = code[:0], n[:0]
            codes, counts, size = [code], [n], len(code)
    if size:
        yield merged()


def _held(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All codes and times of a batch of (pairs, times)."""
    pairs, times = (b"".join(c.to_pylist()) for c in batch.columns)
    return np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int32).astype(np.int64)


def pair_counts(linked: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): each linked id pair's links over the corpus, and the highest count of its second id."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in _totals(held for held in slices(batches, _held)):
            for at in range(0, len(code), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], schema=schema)

    counts = linked.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair") % n_b
    best = counts.groupBy(second.alias("b")).agg(F.max("n").alias("best"))
    return counts.join(best, second == F.col("b")).select("pair", "n", "best")


def _scored_by_broadcast(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """`linked` with n_best and count_sum from the counts, held by every worker as sorted arrays."""
    table = counts.toArrow()
    order = np.argsort(table["pair"].to_numpy())
    pair, n, best = (table[c].to_numpy()[order] for c in ("pair", "n", "best"))
    shared = linked.sparkSession.sparkContext.broadcast((pair, n, n == best))

    @F.arrow_udf("struct<n_best:long,count_sum:long>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pair, n, best = shared.value
        for pairs, times in batches:
            code, often = _held(pa.RecordBatch.from_arrays([pairs, times], ["pairs", "times"]))
            at = np.searchsorted(pair, code)
            cuts = np.concatenate([[0], np.cumsum([len(p) // 8 for p in pairs.to_pylist()])]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(v, dtype=np.int64)]) for v in (often * best[at], often * n[at])]
            yield pa.StructArray.from_arrays([pa.array(np.diff(s[cuts])) for s in sums], names=["n_best", "count_sum"])

    scored = linked.withColumn("s", run("pairs", "times"))
    return scored.select("doc_id", "n_a", "n_b", "n_links", F.col("s.n_best").alias("n_best"), F.col("s.count_sum").alias("count_sum"), "groups_sha256")


def _scored_by_join(linked: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """The same through a join of (row, pair) with the counts; pairs that hold many rows are met map-side."""
    rows = scratch.save(linked.withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.save(counts)
    schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def part(some: pa.RecordBatch) -> pa.RecordBatch:
            code, often = _held(some.select(["pairs", "times"]))
            row = np.repeat(some.column(0).to_numpy(), [len(p) // 8 for p in some.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([pa.array(row), pa.array(code), pa.array(often)], schema=schema)

        return slices(batches, part)

    links = rows.select("row", "pairs", "times").mapInArrow(run, "row long, pair long, times long")
    met = attach(links, counts, ["pair"], "n", counts.agg(F.sum("n")).first()[0] or 0)
    per_row = met.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(per_row, "row", "left").select("doc_id", "n_a", "n_b", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def alignment_digests(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of `docs`: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    An id pair's count is the number of links corpus-wide that hold it.  `n_best` counts a row's links whose count is
    the highest of their second id, ties included; `count_sum` adds up the counts of all its links.  `groups_sha256` is
    the digest of `a1,a2|b1;a3|b2,b3`, the ids of each group in order, or '' without tokens.  Null and empty texts, and
    texts that either tokenizer spells otherwise, have zeros and no part in the counts.  Rows that repeat an id or a
    text count each and have a result each; other columns are ignored; an empty table gives no rows.

    Every token is at least a byte long, so an end is that of one token on each side, and a group has one link.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "align")
    first, second = share(spark, a_path), share(spark, b_path, binary=True)
    n_b = Pieces(second.file.value).size
    slim = docs.select(col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    linked = _linked(slim, first, second, scratch)
    counts = scratch.save(pair_counts(linked, n_b))
    few = counts.count() <= broadcast_pairs
    out = _scored_by_broadcast(linked, counts) if few else _scored_by_join(linked, counts, scratch)
    return out.withColumn("n_groups", F.col("n_links")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
