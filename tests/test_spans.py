"""Span listing, overlap choice and replacement on one value with many hits, against plain Python."""

import random
import time

from pyspark.sql import functions as F

from scrub.functions.spans import offsets_of, replace_spans, resolve_overlaps
from scrub.functions.text import SPANS_TYPE

TYPES = ("A", "B", "C")


def chosen(spans):
    """The greedy choice as its definition reads."""
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        if not any(k[1] < s[2] and s[1] < k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def span_rows(spark, lists):
    rows = [(i, [("scan", t, a, b, p, None, f"<{t}>") for t, a, b, p in spans]) for i, spans in enumerate(lists)]
    from pyspark.sql import types as T

    return spark.createDataFrame(rows, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("spans", SPANS_TYPE)]))


def resolved(spark, lists):
    out = span_rows(spark, lists).select("i", resolve_overlaps(F.col("spans")).alias("r")).orderBy("i").collect()
    return [[(s["entity_type"], s["start"], s["end"], s["score"]) for s in row["r"]] for row in out]


def test_choice_equals_its_definition_on_random_spans(spark):
    rng = random.Random(5)
    lists = []
    for _ in range(400):
        size, reach = rng.randint(0, 40), rng.choice((3, 8, 30))
        spans = []
        for _ in range(size):
            a = rng.randint(0, 60)
            spans.append((rng.choice(TYPES), a, a + rng.randint(0 if rng.random() < 0.1 else 1, reach), rng.choice((0.4, 0.85, 1.0))))
        lists.append(spans)
    assert resolved(spark, lists) == [chosen(s) for s in lists]


def test_chains_of_ever_better_spans(spark):
    rising = [("A", 9 * i, 9 * i + 10, round(0.001 * i, 3)) for i in range(300)]
    growing = [("B", i * (i + 1) // 2, i * (i + 1) // 2 + i + 2, 0.5) for i in range(1, 120)]
    assert resolved(spark, [rising, growing]) == [chosen(rising), chosen(growing)]


def test_replacement_past_one_stretch(spark):
    rng = random.Random(6)
    for n in (1, 63, 64, 65, 128, 300):
        text, spans, at = "", [], 0
        for _ in range(n):
            gap = "é𝄞x"[: rng.randint(0, 3)]
            hit = "secret"[: rng.randint(1, 6)]
            spans.append(("A", at + len(gap), at + len(gap) + len(hit), 1.0))
            text += gap + hit
            at = len(text)
        text += "tail"
        want, end = "", 0
        for _, a, b, _ in spans:
            want += text[end:a] + "<A>"
            end = b
        want += text[end:]
        got = span_rows(spark, [spans]).select(replace_spans(F.lit(text), F.col("spans")).alias("t")).first()["t"]
        assert got == want


def _many(n):
    return "".join(f"word {i} ab{i}@x.org " for i in range(n))


def test_twenty_thousand_hits_in_one_value(spark):
    """Four times the hits cost at most five times the time, and nothing of a value is left out."""
    from scrub.operators.redact import scored_stage

    def run(n):
        # Overlapping hits of two rules on the same value, next to the listing of one.
        text = _many(n)
        df = spark.createDataFrame([(text,)], "t string")
        out = scored_stage(F.col("t"))
        began = time.time()
        row = df.select(F.size(offsets_of(F.col("t"), "[0-9]+@")).alias("n"), out.alias("o")).first()
        took = time.time() - began
        assert row["n"] == n and len(row["o"]["spans"]) == n
        assert row["o"]["text"].count("[EMAIL_ADDRESS]") == n
        return took

    run(100)
    small, large = min(run(5_000) for _ in range(2)), min(run(20_000) for _ in range(2))
    assert large < 5 * small + 0.5, (small, large)


def test_overlaps_of_twenty_thousand_hits(spark):
    """Two rules that overlap all along the value."""

    def run(n):
        spans = [("A", 10 * i, 10 * i + 8, 0.85) for i in range(n // 2)] + [("B", 10 * i + 5, 10 * i + 12, 0.4) for i in range(n // 2)]
        df = span_rows(spark, [spans])
        began = time.time()
        got = df.select(F.size(resolve_overlaps(F.col("spans"))).alias("n")).first()["n"]
        assert got == n // 2
        return time.time() - began

    run(100)
    small, large = min(run(5_000) for _ in range(2)), min(run(20_000) for _ in range(2))
    assert large < 5 * small + 0.5, (small, large)
