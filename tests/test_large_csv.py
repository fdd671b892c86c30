"""Large CSV files are read in splits when their line ends all lie between records."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scrub.functions.mask import financial_mask, financial_types
from scrub.operators.redact import redact_text
from scrub.operators.runs import redact_csv_files
from scrub.plans import q_io
from scrub.policy import CustomPattern, FinancialRules, NumberRule, Policy
from scrub.sources import files
from scrub.sources.files import large_files, quoted_line_ends, read_csv_strings

PLAIN = 'a,b\n1,"x, ""y"""\n\n,\n"",é\n'
ODD = {
    "end.csv": 'a,b\n1,"x\ny"\n',
    "open.csv": 'a,b\n1"2,"c\nd",e"\n',
    "return.csv": "a,b\r\n1,2\r\n",
    "blank.csv": "a,b\n  \n1,2\n",
    "after.csv": 'a,b\n"x"y,2\n',
}


def _folder(texts):
    d = tempfile.mkdtemp()
    for name, text in texts.items():
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(text)
    return d


def test_only_files_of_whole_lines_can_be_cut(spark):
    d = _folder({"plain.csv": PLAIN, **ODD})
    assert {os.path.basename(p) for p in quoted_line_ends(spark, d)} == set(ODD)
    assert large_files(spark, d) == []


def test_large_file_is_read_by_several_tasks(spark, monkeypatch):
    d = _folder({"x.csv": "a,b\n" + "".join(f'{i},"p, ""{i}"""\n' for i in range(20_000))})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 10))
    try:
        monkeypatch.setattr(files, "LARGE", 1 << 10)
        df = read_csv_strings(spark, d)
        assert df.rdd.getNumPartitions() > 1
        assert df.where(F.col("b") == F.concat(F.lit('p, "'), "a", F.lit('"'))).count() == df.count() == 20_000
        run = redact_csv_files(spark, d, d + "-out", apply=True)
        assert [(r.success, r.rows_or_pages) for r in run.files.collect()] == [(True, 20_000)]
        with open(d + "-out/x.csv") as f:
            assert [line.split(",")[0] for line in f][1:] == [str(i) for i in range(20_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_large_file_with_line_ends_in_quotes_is_read_whole(spark, monkeypatch):
    monkeypatch.setattr(files, "LARGE", 0)
    d = _folder({"x.csv": 'a,b\n1,"x\ny"\n', "y.csv": "a,b\n2,z\n"})
    assert sorted(map(tuple, read_csv_strings(spark, d).collect())) == [("1", "x\ny"), ("2", "z")]
    run = redact_csv_files(spark, d)
    assert sorted((os.path.basename(r.input_path), r.rows_or_pages) for r in run.files.collect()) == [("x.csv", 1), ("y.csv", 1)]


def test_input_files_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(q_io, "TASK_ROWS", 10)
    d = tempfile.mkdtemp()
    q_io._put_csv(spark.range(95).select(F.col("id").cast("string").alias("k"), F.lit(' "q" ').alias("v")), f"{d}/a.csv")
    assert os.listdir(d) == ["a.csv"]
    assert sorted(map(tuple, read_csv_strings(spark, f"{d}/a.csv").collect())) == sorted((str(i), ' "q" ') for i in range(95))


TEXTS = ["4111 1111 1111 1234 123456 12345", "a 3782 822463 10005, 4111111111111111", "12345678 123456789 1234567890 12345678901234567 123456789012345678",
         "12345678-1234567890", "x12345678", "4111-1111-1111-1234 Jan 5", "", None]


@pytest.mark.parametrize("n,mark", [(4, "X"), (6, "$"), (1, "*"), (12, "X"), (17, "\\")])
def test_masking_without_spans_is_masking_with_them(spark, n, mark):
    rules = FinancialRules(NumberRule(n, mark), NumberRule(n, mark))
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(financial_mask(F.col("t"), rules).alias("s"), financial_mask(F.col("t"), rules, False).alias("m"), financial_types(F.col("t"), rules).alias("y")).collect()
    for r in got:
        assert (r.s is None) == (r.m is None) == (r.y is None)
        if r.s is not None:
            assert r.s.text == r.m.text == r.y.text
            assert sorted(x.entity_type for x in r.s.spans) == sorted(r.y.types)


def test_hits_of_no_characters_and_marks_in_the_text(spark):
    p = Policy(custom_patterns=(CustomPattern("b", "(?=b)", "replace", "<"), CustomPattern("c", "c+", "replace", "$1")))
    df = spark.createDataFrame([("abcb",), ("c",), ("bc",)], "t string")
    assert [r[0] for r in df.select(redact_text(F.col("t"), p)).collect()] == ["a<b$1<b", "$1", "b$1<"]
