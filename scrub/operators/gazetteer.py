"""Dictionary (gazetteer) detection: a Bloom filter inside the row, then a token n-gram equi-join.

Names such as people, places or nationalities come as a DataFrame that may
grow with the data, so they are never collected into a regex on the driver.

* Text side: words (``[\\p{L}\\p{N}_]+``) with their code-point offsets, then
  every run of ``n`` consecutive words, for each word count ``n`` that occurs in
  the dictionary, lower-cased and joined by one space.
* Dictionary side: each name normalised the same way.
* A Bloom filter of bounded size over the dictionary's first words and whole names
  travels with the plan.  A text without a first word of some name isn't looked at
  further; of the others only runs that may be names leave the row.
* One equi-join on the normalised n-gram makes it exact.  The dictionary is broadcast
  only when a measured size bound says it fits (``broadcast_limit``); beyond that the
  join is a shuffle join on ``(gram, salt)`` with the dictionary replicated per
  salt bucket, so a common n-gram is spread over many tasks.

A match therefore means: the same words in the same order, letter case and the
characters between the words ignored.  Only the word counts, the dictionary's
byte size and the filter's bits reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrub.functions.arrays import explode_kept
from scrub.functions.detector import DETECTION_TYPE
from scrub.functions.mask import financial_mask
from scrub.functions.text import let, word_offsets
from scrub.names import col, fresh
from scrub.operators.redact import redact_frame
from scrub.policy import DEFAULT_POLICY, Policy
from scrub.session import ensure_checkpoint_dir

WORD_RE = r"[\p{L}\p{N}_]+"
GAZETTEER_STAGE = "scored"
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
DEFAULT_SALT_BUCKETS = 16

#: A Bloom filter has BITS bits a byte (so that every byte is an ASCII character) and at most MAX_BYTES bytes; larger
#: dictionaries fill it more, and more runs of words go to the join.
BITS, MAX_BYTES = 7, 1 << 20
#: Bytes that a hit takes in a broadcast, about.
HIT_BYTES = 64
#: Bytes for each bit that is set, up to the most: at 3, one run in 400 that is no name passes.
BYTES_A_BIT = 3


def _words(text):
    """``array<struct<w, s, e>>``: words with start/end offsets."""
    return word_offsets(text, WORD_RE)


def normalise(name_col):
    """Name -> its words lower-cased, joined by one space (never null: a null name gives ``''``).

    Being non-nullable lets Catalyst drop the ``isnotnull`` it would otherwise
    infer from the join and push into the scan, normalising every name twice.
    """
    words = F.transform(F.regexp_extract_all(name_col, F.lit(WORD_RE), 0), lambda w: F.lower(w))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def dictionary(terms: DataFrame, term_col: str) -> DataFrame:
    """Distinct normalised names with their word count.

    A name without words normalises to ``''``, which no text n-gram equals; it
    is left in rather than filtered (a filter would be pushed into the scan and
    normalise every name twice).
    """
    norm = normalise(F.col(term_col))
    return (
        terms.select(norm.alias("gram"))
        .distinct()
        .select("gram", F.size(F.split("gram", " ")).alias("n"))
    )


def _places(value: Column, kind: int, size: int) -> list[Column]:
    """The two bits of a value, as places among ``size``; first words and whole names are told apart by ``kind``."""
    return [F.pmod(F.xxhash64(F.lit(2 * kind + i), value), F.lit(size)) for i in range(2)]


FIRST_WORD, WHOLE_NAME = 0, 1


@dataclass(frozen=True)
class Filter:
    """What is known of a dictionary on the driver: word counts, bytes, and its Bloom filter."""

    sizes: list[int]
    nbytes: int
    bits: bytes

    def may_hold(self, value: Column, kind: int) -> Column:
        """False only if no name has this first word, or is this (normalised)."""
        held = F.lit(self.bits)

        def bit(place: Column) -> Column:
            byte = F.ascii(F.substring(held, (F.floor(place / BITS) + 1).cast("int"), 1).cast("string"))
            return F.getbit(byte, (place % BITS).cast("int")) == 1

        one, two = _places(value, kind, BITS * len(self.bits))
        return bit(one) & bit(two)


def measure(d: DataFrame) -> Filter:
    """The dictionary's word counts, bytes and Bloom filter, from one aggregate job.

    One row per byte of the largest filter reaches the driver at most.  The filter is folded to a size that suits the
    number of its bits: places modulo a size are those modulo any multiple of it, reduced.
    """
    first = F.split("gram", " ")[0]
    places = F.array(*_places(first, FIRST_WORD, BITS * MAX_BYTES), *_places(F.col("gram"), WHOLE_NAME, BITS * MAX_BYTES))
    each = d.where(F.col("gram") != "").select("n", F.length("gram").alias("len"), F.posexplode(places).alias("i", "place"))
    of_name = F.col("i") == 0
    rows = each.groupBy(F.floor(F.col("place") / BITS).alias("byte")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("place") % BITS).cast("int"))).alias("bits"),
        F.collect_set("n").alias("sizes"),
        F.sum(F.when(of_name, F.col("len") + 16)).alias("bytes"),
    ).toArrow()
    if not len(rows):
        return Filter([], 0, b"")
    at, bits = rows["byte"].to_numpy(), rows["bits"].to_numpy()
    place = np.concatenate([at[bits >> k & 1 == 1] * BITS + k for k in range(BITS)])
    size = 64
    while size < MAX_BYTES and size < BYTES_A_BIT * len(place):
        size *= 2
    place = np.unique(place % (BITS * size))
    held = np.zeros(size, np.uint8)
    np.bitwise_or.at(held, place // BITS, (1 << place % BITS).astype(np.uint8))
    sizes = sorted({n for some in rows["sizes"].to_pylist() for n in some})
    return Filter(sizes, sum(x or 0 for x in rows["bytes"].to_pylist()), held.tobytes())


def none_found() -> Column:
    return F.array().cast("array<struct<gram:string,s:int,e:int>>")


def candidates(text: Column, known: Filter) -> Column:
    """``array<struct<gram, s, e>>``: the runs of words of a text that the filter lets pass, with their offsets."""

    def begins(words: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(words)), lambda i: known.may_hold(F.lower(F.element_at(words, i)), FIRST_WORD)
        )

    def run_of(w: Column, n: int):
        def run(i):
            there = i + n - 1 <= F.size(w)
            gram = F.array_join(F.transform(F.slice(w, i, n), lambda x: F.lower(x["w"])), " ")
            made = F.struct(gram.alias("gram"), F.element_at(w, i)["s"].alias("s"), F.try_element_at(w, i + n - 1)["e"].alias("e"))
            return F.when(there, made)

        return run

    def runs(w: Column, at: Column) -> Column:
        every = [F.transform(at, run_of(w, n)) for n in known.sizes]
        return F.filter(F.flatten(F.array(*every)), lambda g: g.isNotNull() & known.may_hold(g["gram"], WHOLE_NAME))

    none = none_found()

    def look(at: Column) -> Column:
        # Offsets are worked out only for texts that hold some name's first word.
        return F.when(F.size(at) > 0, let(_words(text), lambda w: runs(w, at))).otherwise(none)

    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    starts = let(words, lambda ws: F.when(F.size(ws) > 0, begins(ws)).otherwise(F.array().cast("array<int>")))
    return F.when(text.isNull(), none).otherwise(let(starts, look))


def _in_dictionary(cand: DataFrame, d: DataFrame, known: Filter, keys: list[str], broadcast_limit: int, salt_buckets: int) -> DataFrame:
    """The candidates (keys, gram, s, e) that the dictionary holds."""
    right = d.select("gram")
    if known.nbytes <= broadcast_limit:
        return cand.join(F.broadcast(right), "gram", "inner")
    # Shuffle join: a common n-gram (say "the") could hold a third of all
    # candidates and land in one task.  Salt it: every candidate gets a
    # deterministic bucket from its own position, the dictionary is
    # replicated once per bucket, and the join key is (gram, bucket).
    salt = F.pmod(F.xxhash64(*map(col, keys), F.col("s")), F.lit(salt_buckets)).cast("int")
    salted = cand.withColumn("_salt", salt)
    buckets = right.select("gram", F.explode(F.sequence(F.lit(0), F.lit(salt_buckets - 1))).alias("_salt"))
    return salted.join(buckets, ["gram", "_salt"], "inner").drop("_salt")


def gazetteer_spans(df: DataFrame, keys, text_col: str, terms: DataFrame, term_col: str, entity_type: str,
                    score: float = 0.85, broadcast_limit: int = DEFAULT_BROADCAST_LIMIT,
                    salt_buckets: int = DEFAULT_SALT_BUCKETS) -> DataFrame:
    """One row per dictionary hit: ``keys, entity_type, start_pos, end_pos, term, score``.

    ``term`` is the matched name in normalised form (lower-case words joined by
    one space), not the raw text: candidates never carry the text itself.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    d = dictionary(terms, term_col)
    known = measure(d)
    if not known.sizes:
        return df.sparkSession.createDataFrame([], _schema(df, keys))
    # Candidate rows carry offsets and the normalised words only, never the text.
    cand = explode_kept(df, keys, candidates(col(text_col), known), "g").select(
        *map(col, keys), F.col("g.gram").alias("gram"), F.col("g.s").alias("s"), F.col("g.e").alias("e"))
    hits = _in_dictionary(cand, d, known, keys, broadcast_limit, salt_buckets)
    return hits.select(
        *map(col, keys),
        F.lit(entity_type).alias("entity_type"),
        F.col("s").alias("start_pos"),
        F.col("e").alias("end_pos"),
        F.col("gram").alias("term"),
        F.lit(float(score)).alias("score"),
    )


def _schema(df: DataFrame, keys):
    from pyspark.sql import types as T

    fields = [df.schema[k] for k in keys] + [
        T.StructField("entity_type", T.StringType()),
        T.StructField("start_pos", T.IntegerType()),
        T.StructField("end_pos", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
    return T.StructType(fields)


def redact_gazetteers(df: DataFrame, text_col: str, gazetteers, policy: Policy = DEFAULT_POLICY, alias: str = "r",
                      broadcast_limit: int = DEFAULT_BROADCAST_LIMIT) -> DataFrame:
    """``df`` plus ``alias``, as ``redact_frame`` gives it, with dictionary hits redacted in the same pass.

    ``gazetteers`` are ``(terms, term_col, entity_type, score)`` with ``terms`` a
    DataFrame of any size.  Names are found on the text that the scored stage sees
    (after number masking) and join its spans before overlap resolution, so
    threshold, switch, replacement template and scores hold for them too.

    Hits find their row by a number that the rows get here and that is kept in a checkpoint, so no column needs to be
    unique or set: rows that repeat one another, or hold nulls, are redacted each.  Texts without a candidate are
    never shuffled; where the hits are small enough to broadcast, none are.
    """
    if not gazetteers:
        return redact_frame(df, text_col, policy, alias=alias)
    ensure_checkpoint_dir(df.sparkSession)
    row, cand, found = (fresh(df, x) for x in ("_row", "_candidates", "_names"))
    dictionaries = []
    for terms, term_col, entity_type, score in gazetteers:
        d = dictionary(terms, term_col)
        dictionaries.append((d, measure(d), entity_type, float(score)))
    masked = financial_mask(col(text_col), policy.financial, False)["text"]
    per_list = let(masked, lambda t: F.array(*[candidates(t, known) if known.sizes else none_found() for _, known, _, _ in dictionaries]))
    rows = df.withColumn(row, F.monotonically_increasing_id()).withColumn(cand, per_list).checkpoint()
    hits = None
    for i, (d, known, entity_type, score) in enumerate(dictionaries):
        if not known.sizes:
            continue
        some = explode_kept(rows, [row], col(cand)[i], "g").select(col(row), F.col("g.gram").alias("gram"), F.col("g.s").alias("s"), F.col("g.e").alias("e"))
        some = _in_dictionary(some, d, known, [row], broadcast_limit, DEFAULT_SALT_BUCKETS)
        some = some.select(col(row), F.struct(F.lit(entity_type).alias("entity_type"), F.col("s").alias("start"), F.col("e").alias("end"), F.lit(score).alias("score")).alias("hit"))
        hits = some if hits is None else hits.unionByName(some)
    if hits is None:
        return redact_frame(df, text_col, policy, alias=alias)
    per_row = hits.groupBy(col(row)).agg(F.collect_list("hit").cast(DETECTION_TYPE).alias(found)).checkpoint()
    size = per_row.agg(F.sum(F.size(col(found)) * HIT_BYTES + HIT_BYTES)).first()[0] or 0
    any_left = F.exists(col(cand), lambda c: F.size(c) > 0)
    if size <= broadcast_limit:
        ready = rows.join(F.broadcast(per_row), row, "left")
    else:
        plain = rows.where(~any_left).withColumn(found, F.lit(None).cast(DETECTION_TYPE))
        ready = rows.where(any_left).join(per_row, row, "left").unionByName(plain)
    return redact_frame(ready.drop(cand, row), text_col, policy, alias=alias, found=found).drop(found)
