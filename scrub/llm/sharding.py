"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are packed whole, largest first, each into the bin with the least room that still holds it; the
bins' remaining capacities are in a balanced tree, so one placement costs O(log bins).  Millions of groups far smaller
than a bin need not be placed one by one: they are first dealt by hash into lots of about a thousandth of a bin,
and lots and large groups together, a number bounded by ITEMS, are the items that the driver packs.  A fixed capacity that
needs more items than that has them packed in Spark tasks, a share of them in each.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrub.llm.common import Scratch, cell_rows, col, text_of

#: Lots of small groups; also the most groups that can be larger than a lot. Three times as many items reach the driver at most.
ITEMS = 8192


class Rooms:
    """A balanced tree (treap with seeded priorities) of (room, bin), with the tightest fit in O(log n)."""

    def __init__(self):
        self.root, self.draw = None, random.Random(7).random

    def add(self, key: tuple[int, int]) -> None:
        less, more = self._split(self.root, key)
        self.root = self._merge(self._merge(less, [key, self.draw(), None, None]), more)

    def remove(self, key: tuple[int, int]) -> None:
        less, rest = self._split(self.root, key)
        _, more = self._split(rest, (key[0], key[1] + 1))
        self.root = self._merge(less, more)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least (room, bin) with room >= size."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        return best

    def _split(self, node, key):
        """Nodes with keys less than `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            less, more = self._split(node[3], key)
            node[3] = less
            return node, more
        less, more = self._split(node[2], key)
        node[2] = more
        return less, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int, most: int | None = None) -> dict | None:
    """Item name to bin number, for (size, name) items; a new bin opens when none fits.

    None if an item is larger than `capacity` or `most` bins aren't enough.  Equal sizes go by name.
    """
    rooms, place, bins = Rooms(), {}, 0
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        if size > capacity:
            return None
        if fit := rooms.tightest(size):
            rooms.remove(fit)
        else:
            if bins == most:
                return None
            fit, bins = (capacity, bins), bins + 1
        rooms.add((fit[0] - size, fit[1]))
        place[name] = fit[1]
    return place


def tightest_packing(items: list[tuple[int, object]], bins: int) -> dict:
    """Best-fit-decreasing at the least capacity, found by bisection, at which `bins` bins are enough."""
    total = sum(s for s, _ in items)
    low = max([-(-total // bins), *(s for s, _ in items)])
    high, found = low, best_fit_decreasing(items, low, bins)
    while found is None:
        low, high = high, high + max(1, high // 256)
        found = best_fit_decreasing(items, high, bins)
    for _ in range(6):
        if high - low <= 1:
            break
        mid = (low + high) // 2
        if (better := best_fit_decreasing(items, mid, bins)) is None:
            low = mid
        else:
            high, found = mid, better
    return found


def _packed_in_tasks(sizes: DataFrame, capacity: int, parts: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(item, shard), written, and the number of shards: items dealt by hash into `parts`, each packed by best fit in a task."""

    def pack(items: pd.DataFrame) -> pd.DataFrame:
        place = best_fit_decreasing(list(zip(items["b"].tolist(), items["item"])), capacity)
        if place is None:
            raise ValueError(f"a lot of small groups is larger than the capacity of {capacity} bytes")
        return pd.DataFrame({"item": list(place), "part": items["part"].iloc[0], "bin": list(place.values())})

    dealt = sizes.withColumn("part", F.pmod(F.xxhash64(F.lit(13), F.col("item")), F.lit(parts)))
    put = scratch.save(dealt.groupBy("part").applyInPandas(pack, "item string, part long, bin int"))
    bins = put.groupBy("part").agg((F.max("bin") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = bins.select("part", "n", before.alias("before"))
    total = bins.agg(F.sum("n")).first()[0]
    return scratch.save(put.join(F.broadcast(offsets), "part").select("item", (F.col("bin") + F.col("before")).cast("int").alias("shard"))), total


def shard_documents(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: (doc_id, size, text_crc32, shard, slot).

    size is the text's UTF-8 bytes (null: none) plus 1.  With `shards`, all rows go to that many shards of nearly equal
    bytes; with `capacity` (shards=None), to as few shards of at most that many bytes as best fit finds.  Rows of
    equal texts share a shard, null and empty texts as one group.  A group that no shard could hold, larger than
    the capacity or than an equal share, is split by id into pieces of lot size; only such groups are.  slot
    counts from 0 without gaps in each shard.  Rows that repeat an id and text take consecutive slots in any order.  An
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = text_of(text_col)
    rows = scratch.save(
        docs.select(
            col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(F.lit(3), text).alias("key"),
        )
    )
    groups = scratch.save(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    count, total = groups.agg(F.sum("n"), F.sum("bytes")).first()
    count, total = count or 0, total or 0
    room = max(1, capacity or -(-total // shards))
    # Lots of a fixed capacity hold a 32nd of it on average, so that none comes near it.
    unit = max(1, capacity // 16 if capacity else -(-total // ITEMS))
    lots = max(1, -(-2 * total // unit)) if capacity else ITEMS

    # Rows larger than a bin would not fit even alone; a fixed capacity can't hold them.
    if capacity and (rows.agg(F.max("size")).first()[0] or 0) > capacity:
        raise ValueError(f"a row is larger than the capacity of {capacity} bytes")
    large = groups.filter(F.col("bytes") > unit).select("key", F.when(F.col("bytes") > room, F.ceil(F.col("bytes") / unit)).otherwise(F.lit(0)).cast("long").alias("pieces"))
    met = rows.join(F.broadcast(large) if not capacity or large.count() <= ITEMS else large, "key", "left")
    item = (
        F.when(F.col("pieces").isNull(), F.concat(F.lit("l"), F.pmod(F.xxhash64(F.lit(5), F.col("key")), F.lit(lots))))
        .when(F.col("pieces") == 0, F.concat(F.lit("g"), F.col("key")))
        .otherwise(F.concat(F.lit("p"), F.col("key"), F.lit("."), F.pmod(F.xxhash64(F.lit(9), F.col("id"), F.col("crc")), F.col("pieces"))))
    )
    dealt = scratch.save(met.select("id", "size", "crc", item.alias("item")))
    scratch.drop(rows)
    sizes = dealt.groupBy("item").agg(F.sum("size").alias("b"))
    if capacity:
        # Rows of a piece have one size; what the hash dealt too full is dealt on by count.
        sizes = scratch.save(sizes)
        over = sizes.filter((F.col("b") > capacity) & F.col("item").startswith("p")).select("item")
        if not over.isEmpty():
            nth = F.row_number().over(Window.partitionBy("item").orderBy("id")) - 1
            part = F.concat("item", F.lit("."), F.floor(nth / F.floor(F.lit(capacity) / F.col("size"))))
            dealt = scratch.save(dealt.join(over, "item", "left_anti").unionByName(dealt.join(over, "item").withColumn("item", part)))
            sizes = scratch.save(dealt.groupBy("item").agg(F.sum("size").alias("b")))
    many = sizes.count() if capacity else 0
    if many > 3 * ITEMS:
        shard_of, bins = _packed_in_tasks(sizes, capacity, -(-many // ITEMS), scratch)
    else:
        items = [(r["b"], r["item"]) for r in sizes.collect()]
        place = best_fit_decreasing(items, capacity) if capacity else tightest_packing(items, shards)
        if place is None:
            raise ValueError(f"a lot of small groups is larger than the capacity of {capacity} bytes")
        shard_of = F.broadcast(docs.sparkSession.createDataFrame(sorted(place.items()), "item string, shard int"))
        bins = len(set(place.values()))

    # Slots: cells of rows by a hash of the id inside each shard, numbered from the cells' running counts.
    cells = max(1, -(-count // (max(1, shards or bins) * cell_rows(count))))
    cell = F.pmod(F.xxhash64(F.lit(11), F.col("id"), F.col("crc")), F.lit(cells))
    put = scratch.save(dealt.join(shard_of, "item").select("id", "size", "crc", "shard", cell.alias("cell")))
    scratch.drop(dealt)
    run = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = put.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "cell", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "crc", "size"))
    return put.withColumn("nth", nth).join(ahead, ["shard", "cell"]).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("ahead") + F.col("nth") - 1).cast("long").alias("slot")
    )
