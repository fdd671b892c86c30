"""Single output files of given names, their lines in order."""

import csv
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scrub.operators.runs import redact_csv_files, redact_folder
from scrub.sources.mirrored import write_mirrored


def _files(d):
    return {os.path.relpath(f"{at}/{n}", d): open(f"{at}/{n}", newline="").read() for at, _, names in os.walk(d) for n in names if not n.startswith(".")}


def _rows(spark, n):
    """Rows in no order; file a/x.csv holds nine in ten."""
    k = F.col("id")
    name = F.when(k % 10 != 0, "a/x.csv").when(k % 20 == 0, "b c/é+%41=.csv").otherwise("top")
    return spark.range(n, numPartitions=7).select(
        name.alias("file"), (k % 3).alias("block"), k.alias("row"), F.concat(k.cast("string"), F.when(k % 50 == 1, F.lit("\n!")).otherwise("")).alias("line")
    ).orderBy(F.xxhash64("row"))


def test_lines_are_in_order_in_one_file_each(spark):
    d = tempfile.mkdtemp(prefix="scrub-mirror-") + "/out"
    write_mirrored(_rows(spark, 20_000), d)
    want: dict = {}
    for k in sorted(range(20_000), key=lambda k: (k % 3, k)):
        name = "a/x.csv" if k % 10 else "b c/é+%41=.csv" if k % 20 == 0 else "top"
        want.setdefault(name, []).append(f"{k}\n!\n" if k % 50 == 1 else f"{k}\n")
    assert _files(d) == {n: "".join(v) for n, v in want.items()}


def test_modes_are_about_the_folder(spark):
    d = tempfile.mkdtemp(prefix="scrub-mirror-")
    one = spark.createDataFrame([("n", 0, 0, "new")], "file string, block long, row long, line string")
    for mode, want in [("append", {"n": "new\n", "old": "x"}), ("overwrite", {"n": "new\n"}), ("ignore", {"n": "kept"})]:
        with open(f"{d}/{'n' if mode == 'ignore' else 'old'}", "w") as f:
            f.write("kept" if mode == "ignore" else "x")
        write_mirrored(one, d, mode)
        assert _files(d) == want
    with pytest.raises(FileExistsError):
        write_mirrored(one, d)
    write_mirrored(one.limit(0), d + "/none")
    assert _files(d + "/none") == {}


def test_a_failed_job_leaves_no_file(spark):
    d = tempfile.mkdtemp(prefix="scrub-mirror-") + "/out"
    bad = _rows(spark, 100).withColumn("line", F.when(F.col("row") == 57, F.raise_error(F.lit("broken row"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken row"):
        write_mirrored(bad, d)
    assert not os.path.exists(d) or _files(d) == {}


def test_a_run_keeps_rows_in_order_and_reads_odd_headers(spark):
    d = tempfile.mkdtemp(prefix="scrub-mirror-")
    os.makedirs(d + "/in/deep")
    rows = [[str(k), f"u{k}@shop.test" if k % 3 else "", 'a "b"\nc, ' if k % 5 == 0 else "plain"] for k in range(3000)]
    with open(d + "/in/deep/big.csv", "w", newline="") as f:
        f.write("\n\n")  # leading blank lines are passed over
        csv.writer(f, lineterminator="\n").writerows([["id", "e\nmail", "n,ote"], *rows])
    with open(d + "/in/one.csv", "w") as f:
        f.write('only\nx@y.io\n""\nz\n')
    _, run = redact_folder(spark, d + "/in", d + "/out", recursive=True, apply=True, hashes=True)
    got = {os.path.basename(r.input_path): (r.success, r.rows_or_pages, r.fields_changed) for r in run.files.collect()}
    assert got == {"big.csv": (True, 3000, 2000), "one.csv": (True, 3, 1)}
    assert run.observed["rows"] == 3003 and run.observed["fields_changed"] == run.observed["EMAIL_ADDRESS"] == 2001
    out = _files(d + "/out")
    assert set(out) == {"deep/big.csv", "one.csv"} and out["one.csv"] == 'only\n[EMAIL_ADDRESS]\n""\nz\n'
    back = list(csv.reader(out["deep/big.csv"].splitlines(keepends=True)))
    assert back == [["id", "e\nmail", "n,ote"], *[[a, "[EMAIL_ADDRESS]" if b else "", c] for a, b, c in rows]]


def test_two_inputs_of_one_output_are_refused(spark):
    d = tempfile.mkdtemp(prefix="scrub-mirror-")
    for n in ("a", "b"):
        os.makedirs(f"{d}/{n}")
        with open(f"{d}/{n}/x.csv", "w") as f:
            f.write("h\n1\n")
    with pytest.raises(ValueError, match="2 inputs"):
        redact_csv_files(spark, [d + "/a/x.csv", d + "/b/x.csv"], d + "/out", apply=True, input_base="/elsewhere")
