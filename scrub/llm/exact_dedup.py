"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries summary (Spark's frequent-items sketch) names the digests that may be frequent.  Their true counts and
smallest ids are verified by one aggregate over the digests, and these winners, a bounded table, are broadcast: rows of
a heavy digest are settled map-side, whatever share of the corpus they hold.  All other digests, none of which can hold
a large share, are settled by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrub.llm.common import SPACE, Scratch, col, fresh, text_of

#: Counters of a summary: a digest with over 4/TRACKED of all rows is always found. A power of two.
TRACKED = 4096
#: Most digests broadcast.
WINNERS = 1024
#: First-level merges of the summaries of all tasks.
MERGES = 64


def text_digest(name: str):
    """Lowercase hex SHA-256 of the text after each run of ASCII white space became one space; null is empty."""
    return F.sha2(F.regexp_replace(text_of(name), f"[{SPACE}]+", " "), 256)


def heavy_digests(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified winners of `rows` (id, digest): (digest, keep_id, group_size), at most WINNERS rows, each of 2 rows or more."""
    parts = rows.groupBy((F.spark_partition_id() % MERGES).alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {TRACKED})").alias("s"))
    parts = scratch.save(parts)
    if parts.isEmpty():
        return rows.select("digest", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size")).limit(0)
    # The last merge reads the MERGES written summaries in one task: Spark can't combine an empty partition.
    top = parts.coalesce(1).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {WINNERS})").alias("t"))
    named = top.select(F.explode("t.item").alias("digest"))
    exact = rows.join(F.broadcast(named), "digest").groupBy("digest")
    return exact.agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of ASCII white space became one space.  The smallest id stays.  Null
    texts count as empty and are one group.  A null id stays only when its group has no other; of rows that repeat the
    staying id exactly one is kept.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.save(docs.select(col(id_col).alias("id"), text_digest(text_col).alias("digest")))
    heavy = scratch.save(heavy_digests(rows, scratch))
    met = rows.join(F.broadcast(heavy), "digest", "left")
    lost = F.col("group_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep_id"))
    same = Window.partitionBy("digest")
    first = F.row_number().over(same.orderBy(F.col("id").asc_nulls_last())) == 1
    rest = met.filter(~lost).select(
        "id",
        F.coalesce("keep_id", F.min("id").over(same)).alias("keep_id"),
        F.coalesce("group_size", F.count(F.lit(1)).over(same)).alias("group_size"),
        first.alias("kept"),
        "digest",
    )
    dropped = met.filter(lost).select("id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest")
    return rest.unionByName(dropped).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, that of the smallest id; all columns as they were.

    Rows of heavy digests are removed map-side before the shuffle, which carries the other rows once.
    """
    scratch = Scratch(docs.sparkSession, "drop")
    rows = scratch.save(docs.select(col(id_col).alias("id"), text_digest(text_col).alias("digest")))
    heavy = scratch.save(heavy_digests(rows, scratch))
    scratch.drop(rows)
    key, win, n, nth = (fresh(docs, x) for x in ("_digest", "_keep", "_size", "_nth"))
    winners = heavy.select(F.col("digest").alias(key), F.col("keep_id").alias(win), F.col("group_size").alias(n))
    met = docs.withColumn(key, text_digest(text_col)).join(F.broadcast(winners), key, "left")
    stays = met.filter(col(n).isNull() | col(id_col).eqNullSafe(col(win)))
    order = Window.partitionBy(col(key)).orderBy(col(id_col).asc_nulls_last())
    return stays.withColumn(nth, F.row_number().over(order)).filter(col(nth) == 1).select(*[col(c) for c in docs.columns])
