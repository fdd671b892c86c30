"""Best fit against a list scan, and the laws of shards."""

import random
import zlib

import pytest

from scrub.llm.sharding import Rooms, best_fit_decreasing, shard_documents, tightest_packing

SCHEMA = "doc_id long, text string, shard string, slot string, size int"


def plain_best_fit(items, capacity):
    rooms, out = [], {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        fit = min((r, b) for b, r in enumerate(rooms) if r >= size) if any(r >= size for r in rooms) else None
        if fit is None:
            rooms.append(capacity)
            fit = (capacity, len(rooms) - 1)
        rooms[fit[1]] -= size
        out[name] = fit[1]
    return out


def test_tree_places_as_a_scan_does():
    r = random.Random(1)
    for _ in range(30):
        items = [(r.randint(1, 60), f"i{k}") for k in range(r.randint(0, 200))]
        assert best_fit_decreasing(items, 100) == plain_best_fit(items, 100)


def test_rooms():
    t = Rooms()
    for k in [(5, 1), (3, 2), (9, 3), (5, 0)]:
        t.add(k)
    assert t.tightest(4) == (5, 0) and t.tightest(6) == (9, 3) and t.tightest(10) is None
    t.remove((5, 0))
    assert t.tightest(4) == (5, 1)


def test_tightest_packing_is_nearly_even():
    r = random.Random(2)
    items = [(r.randint(1, 500), f"i{k}") for k in range(5000)]
    place = tightest_packing(items, 16)
    load = [0] * 16
    for s, n in items:
        load[place[n]] += s
    assert max(load) - min(load) <= 0.01 * max(load)


def shards_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    for part in out.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return out


def test_shards_are_even_and_groups_whole(spark):
    r = random.Random(3)
    rows = [(i, f"t{i % 2500} " + "é" * (i % 2500 % 400), "x", "y", 1) for i in range(3000)] + [(4000, None, "", None, None), (4001, "", "", None, None), (None, "z", "", "", 0)]
    r.shuffle(rows)
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert len(got) == len(rows) and {r.shard for r in got} == set(range(16))
    text = {i: t or "" for i, t, *_ in rows}
    home = {}
    for o in got:
        b = text[o.doc_id].encode()
        assert o.size == len(b) + 1 and o.text_crc32 == zlib.crc32(b)
        assert home.setdefault(b, o.shard) == o.shard
    load = [sum(x.size for x in p) for p in shards_of(got).values()]
    assert max(load) - min(load) <= 0.02 * max(load)


def test_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "hot text " * 9 if i % 3 == 0 else f"cold {i}" * 8, "", "", 0) for i in range(6000)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA), 16).collect()
    load = [sum(x.size for x in p) for p in shards_of(got).values()]
    assert len(load) == 16 and max(load) - min(load) <= 0.02 * max(load)


def test_fixed_capacity(spark):
    rows = [(i, "w" * (10 + i % 90), "", "", 0) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = shards_of(shard_documents(df, shards=None, capacity=4000).collect())
    total = sum(len(t) + 1 for _, t, *_ in rows)
    assert all(sum(x.size for x in p) <= 4000 for p in got.values()) and len(got) <= -(-total // 4000) + 1
    with pytest.raises(ValueError, match="larger"):
        shard_documents(df, shards=None, capacity=50)


def test_same_on_another_layout(spark):
    df = spark.createDataFrame([(i, f"t{i}" * (i % 9), "", "", 0) for i in range(800)], SCHEMA)
    a, b = (sorted(map(tuple, shard_documents(x, 16).collect())) for x in (df.repartition(2), df.repartition(9, "text")))
    assert a == b


def test_empty_table(spark):
    assert shard_documents(spark.createDataFrame([], SCHEMA), 16).count() == 0


def test_small_capacity_needs_no_cap_on_shards(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', id, repeat('x', cast(id % 90 AS int))) AS text")
    got = shard_documents(rows, shards=None, capacity=200).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).collect()
    assert sum(r["count(doc_id)"] for r in got) == 30_000 and all(r["sum(size)"] <= 200 and r["max(slot)"] == r["count(doc_id)"] - 1 for r in got)
    assert sorted(r["shard"] for r in got) == list(range(len(got))) and len(got) > 8192
    total = sum(r["sum(size)"] for r in got)
    assert len(got) <= 1.2 * total / 200
