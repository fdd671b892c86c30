"""Long values: rules find what their plain patterns find, in time that grows with the value."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scrub.functions import rules as R
from scrub.operators.redact import redact, redact_text
from conftest import many, one

FASTER = [r for r in R.BUILTIN_RULES if r.java]


@pytest.mark.parametrize("rule", FASTER, ids=lambda r: r.entity_type)
def test_the_same_matches_as_the_plain_pattern(spark, rule):
    r = random.Random(rule.entity_type)
    pieces = ["a", "b1", ".", "..", "@", "-", "_", "+", " ", "é", "www.", "http://", "x.co", "q@w.org", "com", "/", "/p", ":80", "?", ",", "\n", "1"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(6000)]
    got, plain = (many(spark, texts, lambda c: F.regexp_extract_all(c, F.lit(p), F.lit(0))) for p in (rule.spark_pattern, rule.pattern))
    assert got == plain
    assert sum(map(len, got)) > 300
    assert many(spark, texts, lambda c: F.split(c, rule.spark_pattern, -1)) == many(spark, texts, lambda c: F.split(c, rule.pattern, -1))


def test_a_million_characters_beside_an_address(spark):
    one(spark, "a@b.io", redact)  # builds the pipeline
    text = "a" * 1_000_000 + " x@y.com " + "b." * 500_000
    start = time.perf_counter()
    assert one(spark, text, redact_text) == text.replace("x@y.com", "[EMAIL_ADDRESS]")
    assert time.perf_counter() - start < 20


def test_a_match_may_start_where_the_last_one_ended(spark):
    assert one(spark, "x@y.comz_q@w.org a@b.co@c.de", lambda c: F.regexp_extract_all(c, F.lit(R.EMAIL_JAVA_RE), F.lit(0))) == [
        "x@y.comz", "_q@w.org", "a@b.co",
    ]


def test_hosts_of_very_many_labels(spark):
    text = "see www." + "a." * 200_000 + "org/x now"
    assert one(spark, text, redact_text) == "see [URL] now"
