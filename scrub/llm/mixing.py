"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that a seeded MD5 of id and text fixes.  A document's
virtual finish time is the words its source has sent up to and including it, over the source's target; the second
pass over a source goes on where the first ended.  All documents of all sources, sorted by finish time, are one
stream, cut where its total reaches the budget.  So the sources are interleaved in their proportions all along, and each
ends within a document or so of its target.

Running totals are two-level: a source's queue is dealt into cells of about sqrt(rows) documents by ranges of the
hash, cell totals are summed up per source, and a window runs inside each cell only.  A source with a third of all
rows is thus spread over as many tasks as its cells.  The global cut is found on a grid of finish times the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrub.llm.common import SPACE, Scratch, attach, cell_rows, col, fresh, ordered_index, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 20240817


def words(name: str):
    """Number of runs of characters that are no ASCII white space; null has none."""
    return F.regexp_count(text_of(name), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """`sources` (source_size, weight) with `target`: the budget shared by weight, none above `cap` times its size.

    The excess of capped sources is shared among the others by weight until none is above, which is a water level:
    each round is one aggregate and the level only rises.
    """
    level = 0.0
    while True:
        full = F.lit(level) * F.col("weight") > cap * F.col("source_size")
        r = sources.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("full"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not r["open"]:
            break
        now = (budget - cap * (r["full"] or 0)) / r["open"]
        if now <= level:
            break
        level = now
    return sources.withColumn("target", F.least(F.col("source_size") * float(cap), F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: (doc_id, text_md5, size, source_size, target, copies, taken).

    Sources, ordered by code point with null last, get `weights` in turn, and targets that sum up to `share` of all
    words, none above `cap` times its source.  `copies` (0 to `cap`) is how often the mix takes the document, `taken`
    its words in all.  Documents without words have size 0, take part in the order and take no words.  Null ids are
    ordinary documents, told apart by their texts; rows that repeat an id and text are queued each.  The same rows give
    the same result on every run and layout.  An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.save(
        docs.select(
            col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("s"), col(source_col).cast("string")), F.lit("z")).alias("source"),
            words(text_col).alias("size"),
            F.md5(text_of(text_col).cast("binary")).alias("md5"),
        )
    )
    # "s..." sorts before "z", so null comes last.
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = ordered_index(per_source, [F.col("source").asc()], "place", scratch)
    turn = F.array(*map(F.lit, weights))
    sources = scratch.save(ranked.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int")).cast("long")).drop("place"))
    count, size = sources.agg(F.sum("n"), F.sum("source_size")).first()
    count, budget = count or 0, share * (size or 0)
    sources = scratch.save(source_targets(sources, budget, cap))

    step = cell_rows(count)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("md5")).cast("binary"))
    share_of = F.conv(F.substr("draw", F.lit(1), F.lit(13)), 16, 10).cast("double") / 2.0**52
    cells = F.ceil(F.col("n") / step).cast("long")
    queued = scratch.save(
        attach(rows, sources, ["source"], "n", count)
        .withColumn("draw", draw)
        .withColumn("cell", F.least(cells - 1, F.floor(share_of * cells)).cast("long"))
    )
    scratch.drop(rows)
    by_source = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = queued.groupBy("source", "cell").agg(F.sum("size").alias("sum")).select("source", "cell", F.coalesce(F.sum("sum").over(by_source), F.lit(0)).alias("ahead"))
    in_cell = Window.partitionBy("source", "cell").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0)
    sent = queued.withColumn("sent", F.sum("size").over(in_cell)).join(ahead, ["source", "cell"])
    passes = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: (k * F.col("source_size") + F.col("ahead") + F.col("sent")) / F.greatest("target", F.lit(1e-300)))
    timed = scratch.save(sent.select("id", "md5", "size", "source_size", "target", F.when(F.col("size") > 0, passes).otherwise(F.array().cast("array<double>")).alias("finish")))
    scratch.drop(queued)

    # Finish times beyond the last that can matter share the grid's last step.
    grid = max(1, math.ceil(cap * count / step))
    at = lambda f: F.floor(F.least(f, F.lit(float(cap))) * grid).cast("long")
    each = timed.select("size", F.explode("finish").alias("f")).withColumn("g", at(F.col("f")))
    run = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    over = each.groupBy("g").agg(F.sum("size").alias("sum")).withColumn("total", F.sum("sum").over(run)).filter(F.col("total") > budget).orderBy("g").first()
    if over is None:
        takes = F.size("finish")
    else:
        base, last = over["total"] - over["sum"], over["g"]
        part = each.filter(F.col("g") == last).groupBy("f").agg(F.sum("size").alias("sum")).withColumn("total", F.sum("sum").over(Window.orderBy("f")))
        cut = part.filter(F.col("total") + base <= budget).agg(F.max("f")).first()[0]
        takes = F.size(F.filter("finish", lambda f: (at(f) < last) | ((at(f) == last) & (f <= F.lit(-1.0 if cut is None else cut)))))
    return timed.select(
        F.col("id").alias("doc_id"), F.col("md5").alias("text_md5"), "size", "source_size", "target", takes.alias("copies"), (takes * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """`docs` as the mix takes them: each row as many times as `mix` copies it, all columns as they were.

    Rows that repeat an id and text share one decision, the largest of theirs.  The texts are shuffled once, by id.
    """
    plan = mix(docs, id_col, text_col, source_col, **how)
    i, c, n, k = (fresh(docs, x) for x in ("_id", "_md5", "_copies", "_nth"))
    plan = plan.filter("copies > 0").groupBy(F.col("doc_id").alias(i), F.col("text_md5").alias(c)).agg(F.max("copies").alias(n))
    same = col(id_col).eqNullSafe(col(i)) & (F.md5(text_of(text_col).cast("binary")) == col(c))
    out = docs.join(plan, same).withColumn(k, F.explode(F.sequence(F.lit(1), col(n))))
    return out.select(*[col(x) for x in docs.columns])
