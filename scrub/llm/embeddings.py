"""Embedding near-dedup by epsilon grid order.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other.  Vectors are rotated so that a few leading
principal dimensions hold most variance, and sorted, within their label, by the grid cells of width eps on
these dimensions.  The sequence is cut into blocks; a block, and any interval of 16^h blocks, knows its bounds in the
leading dimensions and in the length of the remaining part.  Two intervals whose bounds are over eps apart hold no
pair: their join ends there.  The others are split and joined again, level by level, until blocks meet, whose vectors
are compared in full, in double precision.  The rotation only decides how much is skipped, never what is found.

Equal vectors of one label are one class with a multiplicity.  A block pair returns link counts for each vector and a
spanning forest of its links instead of the links themselves, so its output is linear in the block size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrub.llm.common import Scratch, attach, col, components, ordered_index

#: Leading principal dimensions of the grid.
LEAD = 8
#: Vectors that the rotation is fitted on, those of least hash.
FIT_ROWS = 4096
#: Vectors in a block, and children of an interval.
BLOCK, FAN = 512, 16
#: Slack for rounding in the bounds; comparisons are exact.
SLACK = 1e-6


def rotation(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions for each dimension, from at most FIT_ROWS vectors of each of the most common dimensions."""
    out = {}
    for r in vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(4).collect():
        rate = min(1.0, 2 * FIT_ROWS / r["count"])
        draw = F.xxhash64(F.lit(29), F.col("id"))
        drawn = vectors.filter((F.col("dim") == r["dim"]) & ((draw / 2.0**64 + 0.5) <= rate))
        x = np.array([np.asarray(v[0], float) for v in drawn.orderBy(draw, "id").limit(FIT_ROWS).select("vec").collect()])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x -= x.mean(axis=0)
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        out[r["dim"]] = axes[:LEAD]
    return out


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _project(axes: dict[int, np.ndarray], eps: float):
    """Leading coordinates, the rest's length and grid cells of each vector."""

    @F.pandas_udf("struct<lead:array<double>,cells:array<int>>")
    def run(vectors: pd.Series, dims: pd.Series) -> pd.DataFrame:
        lead, cells = [None] * len(vectors), [None] * len(vectors)
        for dim, at in dims.groupby(dims).groups.items():
            where = dims.index.get_indexer(at)
            x = _unit(vectors.loc[at])
            p = np.zeros((len(x), LEAD + 1))
            if dim in axes:
                a = axes[dim]
                p[:, : len(a)] = x @ a.T
            p[:, LEAD] = np.sqrt(np.maximum(0, 1 - (p[:, :LEAD] ** 2).sum(axis=1)))
            g = np.floor(p / eps).astype(np.int32)
            for i, w in enumerate(where):
                lead[w], cells[w] = p[i].tolist(), g[i].tolist()
        return pd.DataFrame({"lead": lead, "cells": cells})

    return run


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks of at most BLOCK vectors of one label and dimension from a sorted partition."""
    rest: pd.DataFrame | None = None

    def packed(part: pd.DataFrame) -> dict:
        box = np.array(part["lead"].tolist())
        return {
            "label": part["label"].iloc[0], "dim": int(part["dim"].iloc[0]),
            "lo": box.min(axis=0).tolist(), "hi": box.max(axis=0).tolist(),
            "ids": part["id"].to_numpy(np.int64).tobytes(), "sizes": part["size"].to_numpy(np.int64).tobytes(),
            "vecs": np.concatenate([np.asarray(v) for v in part["vec"]]).tobytes(),
        }

    def cut(rows: pd.DataFrame, last: bool):
        out, start = [], 0
        keys = list(zip(rows["label"], rows["dim"]))
        edges = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        for end in edges:
            while end - start > BLOCK or (start < end and (end < len(keys) or last)):
                stop = min(start + BLOCK, end)
                out.append(packed(rows.iloc[start:stop]))
                start = stop
        return pd.DataFrame(out, columns=["label", "dim", "lo", "hi", "ids", "sizes", "vecs"]), rows.iloc[start:]

    for batch in batches:
        rest = batch if rest is None or rest.empty else pd.concat([rest, batch], ignore_index=True)
        done, rest = cut(rest, False)
        if len(done):
            yield done
    if rest is not None and len(rest):
        yield cut(rest, True)[0]


def _compare(threshold: float, kind: str):
    def one(dim, ax, ay, ids_x, ids_y, size_x, size_y, same):
        x, y = (np.frombuffer(b, kind).reshape(-1, dim).astype(np.float64) for b in (ax, ay))
        x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
        cos = (x @ y.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
        link = cos >= threshold
        if same:
            np.fill_diagonal(link, False)
        ix, iy, nx, ny = (np.frombuffer(b, np.int64) for b in (ids_x, ids_y, size_x, size_y))
        to_x, to_y = link @ ny, link.T @ nx
        counts = [(int(i), int(c)) for i, c in zip(ix, to_x) if c]
        if not same:
            counts += [(int(i), int(c)) for i, c in zip(iy, to_y) if c]
        # A spanning forest of the block pair's links.
        root: dict[int, int] = {}

        def find(v):
            while (p := root.setdefault(v, v)) != v:
                root[v] = v = root[p]
            return v

        edges = []
        for p, q in np.argwhere(link):
            a, b = find(int(ix[p])), find(int(iy[q]))
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((int(ix[p]), int(iy[q])))
        return counts, edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                counts, edges = one(r.dim, r.vx, r.vy, r.ix, r.iy, r.sx, r.sy, r.same)
                rows += [(a, None, n) for a, n in counts] + [(a, b, None) for a, b in edges]
            yield pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "Int64"})

    return run


def _apart(eps: float):
    """The squared distance of two boxes of arrays, none of it if they overlap, is at most eps squared."""
    gap = F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda p, q: F.greatest(p, q, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda t, g: t + g * g) <= (eps + SLACK) ** 2


def _near_blocks(blocks: DataFrame, eps: float, scratch: Scratch) -> DataFrame:
    """Pairs of blocks (i <= j) of one sequence that their bounds can't prove distant, by recursive splitting."""
    group = ["label", "dim"]
    boxes = blocks.select(*group, "block", "lo", "hi")
    top = boxes.agg(F.max("block")).first()[0] or 0
    height = 0
    while FAN ** height <= top:
        height += 1
    least = lambda c, f: F.array(*[f(F.col(c)[i]) for i in range(LEAD + 1)]).alias(c)
    pairs = boxes.select(*group).distinct().withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    for level in range(height - 1, -1, -1):
        node = F.floor(F.col("block") / FAN**level).cast("long").alias("node")
        nodes = boxes if level == 0 else boxes.groupBy(*group, node).agg(least("lo", F.min), least("hi", F.max))
        nodes = nodes.withColumnRenamed("block", "node") if level == 0 else nodes
        nodes = scratch.save(nodes.withColumn("parent", F.floor(F.col("node") / FAN).cast("long")))
        left = nodes.withColumnRenamed("parent", "i")
        right = nodes.select(*group, F.col("parent").alias("j"), F.col("node").alias("node2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        met = pairs.join(left, [*group, "i"]).join(right, [*group, "j"]).filter("node <= node2").filter(_apart(eps))
        pairs = scratch.save(met.select(*group, F.col("node").alias("i"), F.col("node2").alias("j")))
    return pairs


def embedding_links(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per row of `vectors`: (vec_id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null, they have the same dimension and their cosine in double
    precision is at least `threshold` (over 0).  Null, empty and zero vectors and those with a null or non-finite component link
    with nothing; so do rows with a null id, whose component_id is null and which are kept.  n_links counts the other
    rows linked directly, equal vectors among them; component_id is the smallest id that links reach.  Rows that
    repeat an id count as vectors of their own and share its component.  An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "embed")
    eps = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    wide = dict(vectors.select(col(vec_col)).dtypes)[vec_col] != "array<float>"
    kind = "float64" if wide else "float32"
    given = vectors.select(col(id_col).cast("long").alias("id"), col(label_col).alias("label"), col(vec_col).cast("array<double>" if wide else "array<float>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite, F.lit(False))
    rows = scratch.save(given.withColumn("usable", usable))
    live = rows.filter("usable").select("id", "label", "vec")
    # -0.0 and 0.0 compare as equal when grouped, so equal vectors are one class.
    classes = scratch.save(live.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")))
    count = rows.count()
    members = scratch.save(attach(live, classes, ["label", "vec"], "size", count).select("id", "rep", "size"))
    lone = rows.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))

    sized = classes.select("label", "vec", F.col("rep").alias("id"), "size", F.size("vec").alias("dim"))
    seen = _project(rotation(sized), eps)
    order = ["label", "dim", *(f"c{i}" for i in range(LEAD + 1)), "id"]
    grid = sized.withColumn("p", seen("vec", "dim")).select("*", "p.lead", *[F.col("p.cells")[i].alias(f"c{i}") for i in range(LEAD + 1)]).drop("p")
    grid = scratch.save(grid)
    lined = grid.repartitionByRange(*order).sortWithinPartitions(*order)
    label_type = dict(sized.dtypes)["label"]
    schema = f"label {label_type}, dim int, lo array<double>, hi array<double>, ids binary, sizes binary, vecs binary"
    made = scratch.save(lined.select("label", "dim", "id", "size", "lead", "vec").mapInPandas(_blocks, schema).withColumn("nth", F.monotonically_increasing_id()))
    numbered = scratch.save(ordered_index(made.select("nth", "label", "dim", "lo", "hi"), [F.col("nth")], "block", scratch))
    near = _near_blocks(numbered, eps, scratch)
    full = made.select("nth", "ids", "sizes", "vecs").join(numbered.select("nth", "label", "dim", "block"), "nth")
    full = scratch.save(full)
    left = full.select("label", "dim", F.col("block").alias("i"), F.col("ids").alias("ix"), F.col("sizes").alias("sx"), F.col("vecs").alias("vx"))
    right = full.select("label", "dim", F.col("block").alias("j"), F.col("ids").alias("iy"), F.col("sizes").alias("sy"), F.col("vecs").alias("vy"))
    met = near.join(left, ["label", "dim", "i"]).join(right, ["label", "dim", "j"]).withColumn("same", F.col("i") == F.col("j"))
    found = scratch.save(met.select("dim", "ix", "sx", "vx", "iy", "sy", "vy", "same").mapInPandas(_compare(threshold, kind), "a long, b long, n long"))
    counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    comp = components(found.filter("b is not null").select("a", "b"), scratch)
    linked = members.join(counts.withColumnRenamed("a", "rep"), "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    linked = linked.select("id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    every = linked.unionByName(lone)
    return every.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
