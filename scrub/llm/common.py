"""Helpers shared by the operators of this subpackage: scratch tables, column names, joins on hot keys, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from scrub.session import ensure_checkpoint_dir

#: The six ASCII whitespace bytes, as a class body for Java and Python regexes.
SPACE = r"\x20\x09-\x0D"

#: Most rows that `attach` broadcasts: keys that hold at least this share of all rows.
HOT_SHARE = 1e-3


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name


def text_of(name: str) -> Column:
    """The text column with null as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


class Scratch:
    """Tables of one run, written as Parquet below the shared checkpoint folder.

    A written table cuts the lineage: a lost executor costs a reread, never a recomputation with other random or
    range boundaries.  `drop` removes a table that no lazy result reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scrub-llm-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with one row per key, safe when one key holds a large share of the rows.

    Keys with at least `HOT_SHARE` of the `total` rows (column `weight`), so 1,000 keys at most, are broadcast and
    met map-side; the others go through an ordinary shuffle.  Both inputs should be written tables.
    """
    least = max(2, int(total * HOT_SHARE))
    hot = groups.filter(col(weight) >= least)
    cold = groups.filter(col(weight) < least)
    met = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return met.unionByName(rest)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of `edges` (a, b: long): one row per vertex of an edge, (id, component_id).

    component_id is the smallest id of the component.  Each round points every vertex at its neighbour of least hash
    (or itself), jumps the pointers twice and contracts the edges, so a path shrinks by a constant share a round
    whatever its order of ids; rounds end when no edge is left.  All state is in written tables.
    """
    edges = scratch.save(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.xxhash64(F.lit(17), F.col("b"))
        near = both.groupBy("a").agg(F.min(order).alias("h"), F.min_by("b", order).alias("b"))
        step = scratch.save(near.select(F.col("a").alias("id"), F.when(F.col("h") < F.xxhash64(F.lit(17), F.col("a")), F.col("b")).otherwise(F.col("a")).alias("to")))
        for _ in range(2):
            jump = step.select(F.col("id").alias("to"), F.col("to").alias("to2"))
            after = scratch.save(step.join(jump, "to").select("id", F.col("to2").alias("to")))
            scratch.drop(step)
            step = after
        # A vertex without edges left isn't in `step`: it stays where it is.
        if maps is None:
            new = scratch.save(step)
        else:
            ahead = step.select(F.col("id").alias("to"), F.col("to").alias("to2"))
            new = scratch.save(maps.join(ahead, "to", "left").select("id", F.coalesce("to2", "to").alias("to")))
            scratch.drop(maps)
        left = edges.join(step.select(F.col("id").alias("a"), F.col("to").alias("ra")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("rb")), "b")
        left = left.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        after = scratch.save(left)
        scratch.drop(edges, step)
        edges, maps = after, new
    if maps is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component_id"))
    roots = scratch.save(maps.groupBy("to").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    return attach(maps, roots, ["to"], "n", maps.count()).select("id", "component_id")


def ordered_index(df: DataFrame, order: list[Column], name: str, scratch: Scratch) -> DataFrame:
    """`df`, written, with `name`: the row's 0-based place in `order`, gapless, without a single-task sort.

    A global sort numbers the rows inside its range partitions; the partitions' counts, as many rows as there are
    shuffle partitions, give the offsets.
    """
    spot, part = fresh(df, "_spot"), fresh(df, "_part")
    rows = scratch.save(df.orderBy(*order).withColumn(spot, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(col(spot), 33))
    before = Window.orderBy(col(part)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(col(part)).agg(F.count(F.lit(1)).alias("n")).select(col(part), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))
    out = rows.join(F.broadcast(offsets), part)
    return out.withColumn(name, col(name) + col(spot).bitwiseAND((1 << 33) - 1)).drop(spot, part)


def cell_rows(total: int) -> int:
    """Rows that one cell of a two-level running total or numbering holds: the square root of the table, 256 at least."""
    return max(256, int(total**0.5))


#: Rows that Python holds at a time; an Arrow batch is worked off in slices.
SLICE = 256


#: Rows of an Arrow batch on its way to Python. Texts of some kB each make the default, 10,000 rows, tens of MB a task and side.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold ARROW_ROWS rows at most, unless it asks for fewer already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def slices(batches: Iterable, take: Callable) -> Iterator:
    """What `take` makes of SLICE rows at a time; a batch is given back before the next one is read."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield take(batch.slice(at, SLICE))
        del batch
        pa.default_memory_pool().release_unused()


def map_slices(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], ddl: str) -> DataFrame:
    """`df` mapped by the function that `make` returns in each task, SLICE rows at a time, to rows of `ddl`."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        return slices(batches, lambda part: pa.RecordBatch.from_pandas(work(part.to_pandas()), schema=schema, preserve_index=False))

    return df.mapInArrow(run, ddl)


#: Hashes that `only_ids` broadcasts at most.
ID_HASHES = 1 << 20


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is in `ids` (id, distinct): a semi-join that first drops most other rows map-side.

    The ids' hashes, ID_HASHES different ones at most, are broadcast; a row whose hash isn't among them is not in `ids`,
    so its text need not be shuffled.  The exact join follows; the more ids, the less the first step saves.
    """
    hashed = F.pmod(F.xxhash64(F.lit(71), F.col("id")), F.lit(ID_HASHES))
    hashes = ids.select(hashed.alias("_hash")).distinct()
    return docs.join(F.broadcast(hashes), hashed == F.col("_hash"), "left_semi").join(ids, "id", "left_semi")
