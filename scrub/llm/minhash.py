"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch has T coordinates.  In round i every shingle is hashed into one bin and offers (i, hash) there; the least
offer stays, so coordinates agree with probability the Jaccard similarity.  Rounds end when every bin is filled; should T rounds
not fill all, round T + b offers all shingles to bin b, so every coordinate is filled for any set, with T log T
hashes or one for each shingle in all, whichever is more, and estimates concentrate as for independent coordinates.

Documents with equal shingle sets are one class.  Class representatives meet in band buckets: all pairs of a small
bucket, or a star around the smallest id of a large one, are candidates.  Sketches in one byte a coordinate discard
candidates that are far below the threshold, and the others are confirmed on full shingle sets.  Large buckets that
links do not join into one component are then compared in blocks of full sets, the members outside the largest component
with all others, so a link that a star misses is found.  No bucket is ever gathered and none is capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types

from scrub.llm.common import SLICE, Scratch, attach, col, components, fresh, map_slices, only_ids, text_of
from scrub.llm.words import U, mix64, shingle_set, word_hashes

BANDS, ROWS = 42, 6
T = BANDS * ROWS
#: Buckets up to this many members give all their pairs at once.
SMALL = 6
#: Bytes of shingles in a block of a large bucket.
BLOCK = 1 << 20

_SEEDS = mix64(np.arange(1, 2 * T + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_LOW, _OPEN = U(0xFFFFFFFF), U(0xFFFFFFFFFFFFFFFF)


def sketch(shingles: np.ndarray, t: int = T, seeds: np.ndarray = _SEEDS) -> np.ndarray:
    """T coordinates (round << 32 | hash) of a set that isn't empty."""
    out = np.full(t, _OPEN, U)
    at, n = 0, len(shingles)
    while at < t:
        rounds = min(t - at, max(1, int(t * (np.log(t) + 2) / n))) if at == 0 else min(t - at, max(1, t // n))
        x = mix64(shingles[None, :] ^ seeds[at : at + rounds, None])
        offer = (np.arange(at, at + rounds, dtype=U) << U(32))[:, None] | (x & _LOW)
        np.minimum.at(out, ((x >> U(32)) % U(t)).ravel().astype(np.intp), offer.ravel())
        at += rounds
        if not (out == _OPEN).any():
            return out
    for b in np.flatnonzero(out == _OPEN):
        out[b] = (U(t + b) << U(32)) | (mix64(shingles ^ seeds[t + b]) & _LOW).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    rows = mix64(coordinates).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix64(key ^ rows[:, j]) * U(0xFF51AFD7ED558CCD)
    return key.view(np.int64)


def agreement_cut(percent: int) -> int:
    """Least agreeing coordinates of a candidate: 5.5 standard deviations below the threshold's mean."""
    j = percent / 100
    return max(0, int(T * (j - 5.5 * np.sqrt(j * (1 - j) / T))))


def _sketched(k: int):
    def make():
        def run(batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                s = shingle_set(word_hashes(text), k)
                if len(s):
                    c = sketch(s)
                    rows.append((i, len(s), xxhash.xxh3_128_digest(s.tobytes()), (mix64(c) & U(255)).astype(np.uint8).tobytes(), band_keys(c)))
                else:
                    rows.append((i, 0, None, None, None))
            return pd.DataFrame(rows, columns=["id", "n", "digest", "sig", "bands"])

        return run

    return make


@F.arrow_udf(types.IntegerType())
def _agreeing(a: pa.Array, b: pa.Array) -> pa.Array:
    """Coordinates in which two sketches agree."""

    def count(at: int) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(s.slice(at, SLICE).to_pylist()), np.uint8).reshape(-1, T) for s in (a, b))
        return (x == y).sum(axis=1, dtype=np.int32)

    return pa.array(np.concatenate([count(at) for at in range(0, len(a), SLICE)] or [np.empty(0, np.int32)]))


@F.arrow_udf(types.LongType())
def _common(a: pa.Array, b: pa.Array) -> pa.Array:
    """Shingles that two sorted sets share."""

    def count(x, y) -> int:
        x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        return int((y[at] == x).sum())

    return pa.array([count(x, y) for x, y in zip(a, b)], pa.int64())


def _sets(docs: DataFrame, ids: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Full shingle sets, sorted, as bytes, of the documents in `ids`."""

    def make():
        return lambda batch: pd.DataFrame({"id": batch["id"], "set": [shingle_set(word_hashes(t), k).tobytes() for t in batch["text"]]})

    return scratch.save(map_slices(only_ids(docs, ids), make, "id long, set binary"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Sets of one id given twice count once."""
    x = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    met = pairs.select("a", "b").join(x, "a").join(y, "b")
    met = met.select("a", "b", (F.octet_length("sa") / 8).cast("long").alias("na"), (F.octet_length("sb") / 8).cast("long").alias("nb"), _common("sa", "sb").alias("common"))
    return scratch.save(met.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"))


def _bucket_pairs(rows: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, of `rows` (id, key, pivot, members)."""
    star = rows.filter((F.col("members") > SMALL) & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    small = rows.filter(F.col("members") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    pairs = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice(F.col("ids"), i + 2, SMALL), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return star.unionByName(small.select(F.explode(pairs).alias("p")).select("p.a", "p.b")).distinct()


def _odd_ones(rows: DataFrame, comp: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of large buckets that links haven't made one component: (key, id, comp, odd).

    Those outside the bucket's largest component are odd.
    """
    large = rows.filter(F.col("members") > SMALL).select("id", "key")
    placed = scratch.save(large.join(comp, "id", "left").select("id", "key", F.coalesce("component_id", "id").alias("comp")))
    parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    live = parts.groupBy("key").agg(F.max_by("comp", "n").alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    live = scratch.save(live.drop("comps"))
    return scratch.save(attach(placed, live, ["key"], "size", placed.count()).select("key", "id", "comp", (F.col("comp") != F.col("top")).alias("odd")))


def _block_links(members: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of the odd members with members of other components in their bucket, from full sets.

    A bucket's odd members and all its members are packed into blocks of about BLOCK bytes of shingles, and every
    block of the former meets every block of the latter in a row of its own.  A pair of blocks returns a forest of its links.
    """
    held = members.join(sets, "id")
    size = held.groupBy("key").agg(
        F.ceil(F.sum(F.octet_length("set")) / BLOCK).cast("int").alias("all_blocks"), F.ceil(F.sum(F.when(F.col("odd"), F.octet_length("set"))) / BLOCK).cast("int").alias("odd_blocks")
    )
    held = held.join(scratch.save(size), "key")
    member = F.collect_list(F.struct("id", "comp", "set"))

    def packed(these: DataFrame, blocks: str, block: str, ms: str) -> DataFrame:
        return these.groupBy("key", F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int").alias(block), "all_blocks", "odd_blocks").agg(member.alias(ms))

    odd = packed(held.filter("odd"), "odd_blocks", "i", "x").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    every = packed(held, "all_blocks", "j", "y").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)))

    def make():
        def table(ms):
            sets = [np.frombuffer(m["set"], U) for m in ms]
            return [m["id"] for m in ms], np.array([m["comp"] for m in ms]), np.array([len(s) for s in sets]), sets

        def forest(xm, ym):
            (ia, ca, na, sa), (ib, cb, nb, sb) = table(xm), table(ym)
            codes = np.unique(np.concatenate([*sa, *sb]), return_inverse=True)[1]
            xs, ys = np.split(codes[: na.sum()], na.cumsum()[:-1]), codes[na.sum() :]
            starts, mark = np.concatenate([[0], nb.cumsum()[:-1]]), np.zeros(len(codes), np.int32)
            root: dict[int, int] = {}

            def find(v):
                while (p := root.setdefault(v, v)) != v:
                    v = p
                return v

            for i, own in enumerate(xs):
                mark[own] = 1
                common = np.add.reduceat(mark[ys], starts)
                mark[own] = 0
                for j in np.flatnonzero((100 * common >= percent * (na[i] + nb - common)) & (cb != ca[i])):
                    p, q = find(int(ca[i])), find(int(cb[j]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        yield min(ia[i], ib[j]), max(ia[i], ib[j])

        return lambda batch: pd.DataFrame([e for x, y in zip(batch["x"], batch["y"]) for e in forest(x, y)], columns=["a", "b"])

    met = odd.select("key", "i", "j", "x").join(every.select("key", "i", "j", "y"), ["key", "i", "j"]).select("x", "y")
    return scratch.save(map_slices(met, make, "a long, b long"))


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, n_shingles, component_id, kept).

    Shingles are `k` words, A-Z lower-cased; a text with fewer words is one shingle, one without words (null, empty,
    white space) has none and links with nothing.  Documents link when 100 * common >= percent * union of their sets,
    confirmed on the full sets.  component_id is the smallest id that links reach, kept says that it is the row's own.
    Rows with a null id link with nothing, have a null component_id and are kept; rows that share an id are one document.
    A pair at the threshold goes unseen with probability 3e-6, one above with less.  An empty table gives no rows;
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    texts = docs.select(col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    given = texts.select(F.coalesce("id", F.lit(0)).alias("id"), "text", F.col("id").isNull().alias("no_id"))
    wide = scratch.save(map_slices(given.filter("not no_id").select("id", "text"), _sketched(k), "id long, n int, digest binary, sig binary, bands array<long>"))
    total = wide.count()
    classes = scratch.save(wide.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    members = scratch.save(attach(wide.filter("n > 0").select("id", "n", "digest"), classes, ["digest"], "size", total).select("id", "n", "rep"))
    own = scratch.save(attach(wide.filter("n > 0"), classes, ["digest"], "size", total).filter("id = rep").drop("rep"))
    reps = own.filter("size = 1").unionByName(own.filter("size > 1").dropDuplicates(["digest"]))
    wordless = scratch.save(wide.filter("n = 0").select("id", "n"))
    sigs = reps.select("id", "n", "sig")

    banded = reps.select("id", F.explode("bands").alias("key"))
    buckets = scratch.save(banded.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    rows = scratch.save(attach(banded, buckets, ["key"], "members", total))
    met = _bucket_pairs(rows)
    for side in ("a", "b"):
        met = met.join(sigs.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}")), side)
    met = met.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", _agreeing("sa", "sb").alias("agree"))
    pairs = scratch.save(met.filter(F.col("agree") >= agreement_cut(percent)))
    scratch.drop(wide, buckets)

    plain = given.filter("not no_id").select("id", "text")
    ids = lambda p: p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id"))).distinct()
    sets = _sets(plain, ids(pairs), k, scratch)
    # Each document's most alike partner first; then only what is still between two components.
    first = scratch.save(pairs.groupBy("b").agg(F.max_by("a", "agree").alias("a")).select("a", "b"))
    links = _confirmed(first, sets, percent, scratch)
    comp = scratch.save(components(links, scratch))
    rest = _across(pairs, comp).join(first, ["a", "b"], "left_anti")
    links = scratch.save(links.union(_confirmed(rest, sets, percent, scratch)))
    comp = scratch.save(components(links, scratch))
    scratch.drop(sets)
    odd = _odd_ones(rows, comp, scratch)
    more = _block_links(odd, _sets(plain, odd.select("id").distinct(), k, scratch), percent, scratch)
    if not more.isEmpty():
        comp = scratch.save(components(links.union(more), scratch))

    out = members.join(comp.select(F.col("id").alias("rep"), "component_id"), "rep", "left").select("id", "n", F.coalesce("component_id", "rep").alias("component_id"))
    # Rows that share an id have shared links: the least component of any.
    linked = scratch.save(out)
    least = linked.groupBy("id").agg(F.min("component_id").alias("component_id"))
    again = linked.select("id", "n").join(least, "id")
    bare = map_slices(given.filter("no_id").select("text"), _sizes(k), "id long, n int")
    none = bare.select("id", "n", F.lit(None).cast("long").alias("component_id"))
    empty = wordless.join(least, "id", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    every = again.unionByName(none).unionByName(empty)
    return every.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _sizes(k: int):
    def make():
        return lambda batch: pd.DataFrame({"id": pd.array([None] * len(batch), "Int64"), "n": [len(shingle_set(word_hashes(t), k)) for t in batch["text"]]})

    return make


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    for side in ("a", "b"):
        pairs = pairs.join(comp.select(F.col("id").alias(side), F.col("component_id").alias(f"c{side}")), side, "left")
    return pairs.filter(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b")


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component of `near_components`, all columns as they were."""
    scratch = Scratch(docs.sparkSession, "near")
    key = fresh(docs, "_lost")
    lost = scratch.save(near_components(docs, k, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(key)).distinct())
    return docs.join(lost, col(id_col) == col(key), "left_anti")
