"""The mix against a plain queue, and its laws."""

import hashlib
import re

import pytest

from scrub.llm.mixing import CAP, SEED, SHARE, WEIGHTS, mix, mixed

SCHEMA = "doc_id long, text string, source string, size int, target string"


def rows_of(n, sources):
    return [(i, " ".join(["w"] * (1 + i * 7 % 13)), sources[i % len(sources)], 3, "x") for i in range(n)]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, SHARE * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > CAP * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            out[s] = CAP * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def brute(rows):
    """Doc to copies by one sorted stream."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    draws = {i: md5(f"{SEED}:{'' if i is None else i}:{md5(t or '')}") for i, t, *_ in rows}
    size = {r[0]: len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + size[r[0]]
    goal = targets(sizes)
    stream = []
    for s in sizes:
        sent = 0
        for k in range(CAP):
            for i in sorted((r[0] for r in rows if r[2] == s), key=lambda i: draws[i]):
                sent += size[i]
                if size[i]:
                    stream.append((sent / goal[s], size[i], i))
    total, out = 0, dict.fromkeys(size, 0)
    for f, n, i in sorted(stream):
        total += n
        if total > SHARE * sum(sizes.values()):
            break
        out[i] += 1
    return out, goal, sizes, size


@pytest.mark.parametrize("sources", [["a", "b", "c", None, "B", "é"], ["hot"] * 5 + ["tiny", None], ["one"]])
def test_matches_one_sorted_stream(spark, sources):
    rows = rows_of(900, sources) + [(1000, None, "a", 1, None), (1001, "  \n", None, 1, None)]
    want, goal, sizes, size = brute(rows)
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    at = {r[0]: r[2] for r in rows}
    assert {r.doc_id: r.copies for r in got} == want and len(got) == len(rows)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[at[r.doc_id]] and r.target == pytest.approx(goal[at[r.doc_id]])
        assert r.taken == r.copies * r.size <= 2 * r.size


def test_same_on_another_layout(spark):
    df = spark.createDataFrame(rows_of(700, ["a", "b", None]), SCHEMA)
    a, b = (sorted(map(tuple, mix(x).collect())) for x in (df.repartition(3), df.repartition(11, "text")))
    assert a == b


def test_mixed_repeats_whole_rows(spark):
    df = spark.createDataFrame(rows_of(300, ["a", "b", None]) + [(None, "p q", "a", 1, "t")], SCHEMA)
    out = mixed(df)
    assert out.columns == df.columns
    want = {(r.doc_id, r.text_md5): r.copies for r in mix(df).collect()}
    got = {}
    for r in out.collect():
        k = (r.doc_id, hashlib.md5(r.text.encode()).hexdigest())
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == 0 and mixed(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, "a", 1, "x"), (2, "", None, 1, "x")], SCHEMA)
    assert [(r.size, r.taken) for r in mix(wordless).collect()] == [(0, 0), (0, 0)]
    twice = spark.createDataFrame([(1, "a b", "s", 1, "x")] * 3, SCHEMA)
    assert sorted(r.copies for r in mix(twice).collect()) == [1, 1, 2]
