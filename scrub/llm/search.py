"""Ranked lexical search: the best documents of each item, by a dual-tree search.

Documents and items are vectors over terms: a document holds each term's impact on a score, an item which terms it asks
for.  Both sides have a hierarchy whose nodes hold the maxima of their members' coordinates, so the product of two nodes
bounds every score between their members.  A pair of nodes whose bound is below the weakest kth score among its items is
left out with all that it holds; what is left is scored exactly.

Every task searches its own documents, BATCH at a time, and hands on the best k of each item; one window ranks these.
A first search over a share of the documents gives every item a score that its kth document reaches at least, from which
the search over all documents starts: the share decides what is pruned, not what is found.  Items come in blocks of
bounded size, each a pass over the documents, so nothing that grows with the data is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrub.llm.common import Scratch, col, fresh, ordered_index, slices, small_batches, text_of

#: Documents of a tree; each level of it has FAN times the nodes of the one above, down to leaves of BATCH / FAN**3.
BATCH, FAN, LEVELS = 1024, 4, 4

#: An item block: CELL items at least, ITEMS at most, and TERMS terms (repeats between items counted) where CELL items have fewer.
CELL, ITEMS, TERMS = 64, 1024, 1 << 17

#: Terms whose dense columns are held at a time.
COLUMNS = 4096

#: One in so many documents is searched first.
FIRST = 32

#: Bytes of a text that are cut into terms at a time.
STRETCH = 1 << 20

# ASCII letters in lower case, digits, and all bytes of other characters; every other byte parts terms.
_KEPT = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 0x20 for b in range(256))


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, STRETCH bytes or so at a time."""
    plain, at = text.translate(_KEPT), 0
    while len(plain) - at > STRETCH:
        cut = plain.find(b" ", at + STRETCH)
        if cut < 0:
            break
        yield plain[at:cut].split()
        at = cut
    yield plain[at:].split() if at else plain.split()


def _binary(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


@dataclass
class Items:
    """A block of items: their numbers, and each one's terms as places in the block's sorted vocabulary."""

    numbers: np.ndarray
    terms: list[np.ndarray]
    vocabulary: list[bytes]

    @staticmethod
    def of(rows: list) -> Items:
        """Items in an order that puts those of like terms together, so that the maxima of a node stay low."""
        vocabulary = sorted({bytes(t) for r in rows for t in r.terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        terms = [np.array(sorted(place[bytes(t)] for t in r.terms), np.int64) for r in rows]
        often = np.bincount(np.concatenate([np.zeros(0, np.int64), *terms]), minlength=len(vocabulary))
        order = sorted(range(len(rows)), key=lambda i: tuple(sorted(terms[i], key=lambda t: (-often[t], t))[:8]))
        return Items(np.array([rows[i].item for i in order], np.int64), [terms[i] for i in order], vocabulary)

    def levels(self) -> list[list[tuple[int, int]]]:
        """Nodes of each level as ranges of items: from all of them down to single ones."""
        n, out = len(self.terms), []
        for level in range(LEVELS):
            width = max(1, math.ceil(n ** (1 - level / (LEVELS - 1))))
            # Ranges nest: a level's bounds are those of the level above, cut further.
            upper = out[-1] if out else [(0, n)]
            out.append([(a, min(b, a + width)) for x, b in upper for a in range(x, b, width)])
        return out


def term_counts(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and which of the items' terms it has how often (int32s)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t: i + 1 for i, t in enumerate(shared.value)}.get

        def counted(text: bytes) -> tuple[int, bytes, bytes]:
            n, found = 0, []
            for terms in stretches(text):
                n += len(terms)
                found.append(np.unique(np.fromiter(filter(None, map(get, terms)), np.int32), return_counts=True))
            if len(found) == 1:
                term, tf = found[0]
            else:
                term, back = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True)
                tf = np.bincount(back, np.concatenate([c for _, c in found]), len(term))
            return n, (term - 1).astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()

        def part(some: pa.RecordBatch) -> pa.RecordBatch:
            n, terms, tfs = zip(*map(counted, _binary(some.column(1)))) if len(some) else ((), (), ())
            return pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

        return slices(batches, part)

    small_batches(spark)
    return docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All int32s of a binary column in a row, and how many each row has."""
    each = column.to_pylist()
    return np.frombuffer(b"".join(each), np.int32), np.array([len(x) // 4 for x in each], np.int64)


def document_counts(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the items' terms: one row a term and task, then one a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_joined(b.column(0))[0], minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    found = counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class _Search:
    """A task's search: the items' hierarchy, and the best k documents of each item so far."""

    def __init__(self, items: Items, weight: np.ndarray, documents: int, length: int, k: int, least: np.ndarray):
        self.items, self.weight, self.documents, self.length, self.k = items, weight, documents, length, k
        self.n, self.size = len(items.terms), len(items.vocabulary)
        self.levels = items.levels()
        #: Best scores, and the ids they belong to (nulls last); an unused place has score 0.
        self.score = np.zeros((self.n, k), np.int64)
        self.null = np.ones((self.n, k), np.int8)
        self.doc = np.full((self.n, k), np.iinfo(np.int64).max)
        self.least = least
        self.seen = self.scored = 0
        # Terms in chunks of dense columns; each chunk has its levels of item maxima.
        self.chunks = []
        for a in range(0, self.size, COLUMNS):
            b = min(self.size, a + COLUMNS)
            each = np.zeros((self.n, b - a))
            for i, t in enumerate(items.terms):
                each[i, t[np.searchsorted(t, a) : np.searchsorted(t, b)] - a] = 1
            self.chunks.append((a, b, [np.maximum.reduceat(each, [x for x, _ in nodes], axis=0) if self.n else each for nodes in self.levels]))

    def kth(self) -> np.ndarray:
        """The score that a document needs at least: the kth so far, or the one known to be reached."""
        return np.maximum(self.score[:, -1], self.least)

    def batch(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Search some documents, given their (row, term, tf), rows rising."""
        m = 10 + 90 * n * self.documents // max(1, self.length)
        impact = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        keep = impact > 0
        row, term, impact = row[keep], term[keep], impact[keep]
        if not len(row) or not self.n:
            return
        # Documents in order of their strongest terms: copies, and documents of one passage, come to lie together.
        by = np.lexsort((-impact, row))
        heads = np.flatnonzero(np.diff(row[by], prepend=-1))
        first = np.full(len(doc), self.size, np.int64)
        second = first.copy()
        first[row[by][heads]] = term[by][heads]
        after = heads + 1
        more = (after < len(by)) & np.isin(after, heads, invert=True)
        second[row[by][heads[more]]] = term[by][after[more]]
        order = np.lexsort((second, first))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        row, doc, null = place[row], doc[order], null[order]

        counts = [min(FAN**s, len(doc)) for s in range(LEVELS)]
        starts = [np.arange(c) * len(doc) // c for c in counts]
        chunks = []
        for a, b, maxima in self.chunks:
            at = (term >= a) & (term < b)
            dense = np.zeros((len(doc), b - a))
            dense[row[at], term[at] - a] = impact[at]
            # Maxima from the leaves up: a node's starts are among those of the level below.
            nodes = [np.maximum.reduceat(dense, starts[-1], axis=0)]
            for s in range(LEVELS - 2, -1, -1):
                nodes.insert(0, np.maximum.reduceat(nodes[0], np.searchsorted(starts[s + 1], starts[s]), axis=0))
            chunks.append((maxima, dense, nodes))

        alive = np.ones((1, 1), bool)
        bound = np.zeros((1, 1))
        for s in range(LEVELS):
            # Children of the pairs that are left.
            if s:
                up_i = np.searchsorted([a for a, _ in self.levels[s - 1]], [a for a, _ in self.levels[s]], "right") - 1
                up_d = np.searchsorted(starts[s - 1], starts[s], "right") - 1
                alive = alive[np.ix_(up_i, up_d)]
            some_i, some_d = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(some_i):
                return
            bound = np.zeros(alive.shape)
            bound[np.ix_(some_i, some_d)] = sum(maxima[s][some_i] @ nodes[s][some_d].T for maxima, _, nodes in chunks)
            weakest = np.minimum.reduceat(self.kth(), [a for a, _ in self.levels[s]])
            alive &= (bound > 0) & (bound >= weakest[:, None])

        self.seen += self.n * len(doc)
        ends = np.append(starts[-1][1:], len(doc))
        # The most promising leaves first: they raise the scores that the others must reach.
        for leaf in np.argsort(-np.where(alive, bound, 0).max(0), kind="stable"):
            who = np.flatnonzero(alive[:, leaf] & (bound[:, leaf] >= self.kth()))
            if not len(who):
                continue
            a, b = starts[-1][leaf], ends[leaf]
            # Sums of whole numbers below 2**53 are exact in doubles; `exact` is false where they might not be.
            score = sum(maxima[-1][who] @ dense[a:b].T for maxima, dense, _ in chunks).astype(np.int64)
            self.scored += score.size
            hit = (score > 0) & (score >= self.kth()[who][:, None])
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            who = who[some]
            new = np.where(hit[some], score[some], 0)
            wide = lambda x: np.broadcast_to(x[a:b], new.shape)
            s_, z_, d_ = np.hstack([self.score[who], new]), np.hstack([self.null[who], wide(null)]), np.hstack([self.doc[who], wide(doc)])
            best = np.lexsort((d_, z_, -s_), axis=1)[:, : self.k]
            self.score[who], self.null[who], self.doc[who] = (np.take_along_axis(x, best, 1) for x in (s_, z_, d_))

    def results(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > 0)
        doc = pa.array(self.doc[i, j], mask=self.null[i, j].astype(bool))
        return pa.RecordBatch.from_arrays([pa.array(self.items.numbers[i]), doc, pa.array(self.score[i, j])], ["item", "doc_id", "score"])


def _found(counted: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc_id, score): the best k of each item among each task's documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(*shared.value[:4], k, shared.value[4])
        held: list[pa.RecordBatch] = []

        def go() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if not len(table):
                return
            ids, n, terms, tfs = (table.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tfs"))
            term, each = _joined(terms)
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int8)
            doc = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
            search.batch(doc, null, n.to_numpy(), np.repeat(np.arange(len(each)), each), term.astype(np.int64), _joined(tfs)[0].astype(np.int64))

        for b in batches:
            for at in range(0, len(b), BATCH):
                held.append(b.slice(at, BATCH))
                if sum(map(len, held)) >= BATCH:
                    go()
        if held:
            go()
        yield search.results()

    return counted.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of item numbers, each a block: whole cells, as many as the limits allow, one at least."""
    cells = items.groupBy(F.floor(F.col("item") / CELL).alias("cell")).agg(F.sum(F.size("terms")).alias("n")).orderBy("cell").collect()
    first, held = 0, 0
    for c in cells:
        if c.cell > first and (held + c.n > TERMS or (c.cell - first) * CELL >= ITEMS):
            yield first * CELL, c.cell * CELL
            first, held = c.cell, 0
        held += c.n
    if cells:
        yield first * CELL, (cells[-1].cell + 1) * CELL


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", first: int = FIRST) -> DataFrame:
    """The `k` best documents of each item: (item, item_id, rank, doc_id, score).

    Terms are maximal runs of ASCII letters, in lower case, ASCII digits and characters beyond ASCII.  A term's weight is
    floor(1000 ln((2N + 2) / (2 df + 1))), N being the documents with a term; its share of a document's score is the
    weight times (10**9 tf) div (1000 tf + 8 m), with m = 10 + (90 n N) div L for a document of n terms among L in all.
    Only documents with a score above 0 are ranked; equal scores by ascending doc_id, null last.

    Ids of documents must be whole numbers.  Null and empty texts have no terms: such documents count nowhere, such items
    have no rows.  Documents that repeat an id or a text are documents each.  `item` numbers the items in order of
    item_id and text, so rows that repeat an item are told apart and have the same result each.  Other columns are
    ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    asked = _terms_of_items(items, item_col, item_text_col, scratch)
    out = None
    for low, high in _blocks(asked):
        block = Items.of(asked.filter((F.col("item") >= low) & (F.col("item") < high)).select("item", "terms").orderBy("item").collect())
        if not block.vocabulary:
            continue
        counted = scratch.save(term_counts(docs, block, id_col, text_col))
        documents, length = counted.agg(F.count(F.when(F.col("n") > 0, True)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = weights(document_counts(counted, len(block.vocabulary)), documents)
        # No impact is above 10**6 times its weight, so no sum of them leaves the doubles' whole numbers.
        if int(weight.max(initial=0)) * 1_000_000 * max(map(len, block.terms)) >= 1 << 53:
            raise ValueError("an item has too many terms for exact sums in doubles")
        shared = spark.sparkContext.broadcast((block, weight, documents, length, np.zeros(len(block.terms), np.int64)))
        sample = counted.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(first)) == 0)
        least = _ranked(_found(sample, shared, k), k).filter(F.col("rank") == k).select("item", "score").collect()
        known = dict(map(tuple, least))
        shared = spark.sparkContext.broadcast((block, weight, documents, length, np.array([known.get(i, 0) for i in block.numbers.tolist()], np.int64)))
        found = scratch.save(_ranked(_found(counted, shared, k), k))
        scratch.drop(counted)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    return out.join(asked.select("item", "item_id"), "item").select("item", "item_id", "rank", "doc_id", "score")


def _terms_of_items(items: DataFrame, item_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Written: (item, item_id, terms), items numbered from 0 by id and text, with their different terms."""

    @F.arrow_udf("array<binary>")
    def terms(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in texts:
            yield pa.array([sorted({t for part in stretches(x) for t in part}) for x in _binary(some)], pa.list_(pa.binary()))

    slim = items.select(col(item_col).alias("item_id"), text_of(text_col).alias("text"))
    numbered = ordered_index(slim, [F.col("item_id").asc_nulls_last(), F.col("text")], fresh(slim, "item"), scratch)
    return scratch.save(numbered.select("item", "item_id", terms("text").alias("terms")))
