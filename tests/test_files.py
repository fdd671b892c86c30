"""Folders, globs, output paths, CSV round trip, write guard, streaming."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from scrub.sources.files import (OverwriteError, glob_regex, guard_output, inventory, is_supported, output_path,
                                 read_csv_strings, write_csv)
from scrub.streaming.folder import redact_folder_stream


def _tree():
    root = tempfile.mkdtemp(prefix="scrub-tree-")
    for name, body in [("a.csv", "name\nJohn\n"), ("b.pdf", "%PDF"), ("c.txt", "text"), ("data.xlsx", "x"),
                       ("ignore.csv", "name\nJane\n"), ("X.PDF", "%PDF")]:
        with open(os.path.join(root, name), "w") as f:
            f.write(body)
    os.makedirs(os.path.join(root, "sub"))
    with open(os.path.join(root, "sub", "nested.csv"), "w") as f:
        f.write("name\nJane\n")
    return root


def test_inventory_flat_recursive_and_excludes(spark):
    root = _tree()
    flat = {r.name: r.status for r in inventory(spark, root).collect()}
    assert flat["a.csv"] == "supported" and flat["b.pdf"] == "supported"
    assert flat["c.txt"] == "skipped" and flat["data.xlsx"] == "skipped"
    assert flat["X.PDF"] == "skipped"  # supported type, but the default globs are case-sensitive
    assert "nested.csv" not in flat
    rec = {r.name: r.status for r in inventory(spark, root, recursive=True).collect()}
    assert rec["nested.csv"] == "supported"
    ex = {r.name: r.status for r in inventory(spark, root, exclude_globs=("ignore.csv",)).collect()}
    assert ex["ignore.csv"] == "skipped" and ex["a.csv"] == "supported"


def test_supported_and_globs(spark):
    df = spark.createDataFrame([("file.csv",), ("file.PDF",), ("file.txt",), ("file.xlsx",)], "p string")
    assert [r[0] for r in df.select(is_supported(F.col("p"))).collect()] == [True, True, False, False]
    import re
    assert re.match(glob_regex("statement_*.csv"), "statement_01.csv")
    assert not re.match(glob_regex("statement_*.csv"), "archive_01.csv")
    assert re.match(glob_regex("f[!a-c]?.txt"), "fx1.txt") and not re.match(glob_regex("f[!a-c]?.txt"), "fa1.txt")


def test_output_path_mirrors(spark):
    df = spark.createDataFrame([("/data/input/subdir/file.csv",), ("/elsewhere/x.csv",), ("/data/inputs/y.csv",)],
                               "p string")
    got = [r[0] for r in df.select(output_path(F.col("p"), "/data/input", "/data/output")).collect()]
    assert got == ["/data/output/subdir/file.csv", "/data/output/x.csv", "/data/output/y.csv"]


def test_csv_round_trip_keeps_strings(spark):
    d = tempfile.mkdtemp(prefix="scrub-csv-")
    src = spark.createDataFrame([("0001", "a,b", None), ("0002", 'say "hi"\nthere', "")], "id string, t string, u string")
    write_csv(src, d + "/x")
    back = read_csv_strings(spark, d + "/x").orderBy("id").collect()
    # Quoted commas, quotes and newlines survive; an empty cell reads back as missing
    # (the pandas reader of the mirrored tool does the same).
    assert [tuple(r) for r in back] == [("0001", "a,b", None), ("0002", 'say "hi"\nthere', None)]


def test_write_guard():
    with pytest.raises(OverwriteError):
        guard_output("/tmp/a.csv", "/tmp/../tmp/a.csv")
    guard_output("/tmp/a.csv", "/tmp/../tmp/a.csv", force=True)


def test_stream_redacts_each_file_once(spark):
    base = tempfile.mkdtemp(prefix="scrub-stream-")
    src, out, ck = base + "/in", base + "/out", base + "/ck"
    os.makedirs(src)
    with open(src + "/1.csv", "w") as f:
        f.write("k,card\n1,4111111111111234\n")
    redact_folder_stream(spark, src, out, ck, ["k", "card"], keep=["k"]).awaitTermination()
    with open(src + "/2.csv", "w") as f:
        f.write("k,card\n2,5555555555554444\n")
    redact_folder_stream(spark, src, out, ck, ["k", "card"], keep=["k"]).awaitTermination()
    rows = sorted(tuple(r) for r in spark.read.parquet(out).select("k", "card").collect())
    assert rows == [("1", "XXXXXXXXXXXX1234"), ("2", "XXXXXXXXXXXX4444")]


def test_null_tokens_and_case_insensitive_globs(spark):
    from scrub.sources.files import PANDAS_NULL_TOKENS

    d = tempfile.mkdtemp(prefix="scrub-csv-")
    with open(d + "/a.csv", "w") as f:
        f.write("k,v\n1,NA\n2,null\n3,kept\n")
    kept = [r.v for r in read_csv_strings(spark, d + "/a.csv").orderBy("k").collect()]
    assert kept == ["NA", "null", "kept"]
    pandas_like = [r.v for r in read_csv_strings(spark, d + "/a.csv", null_tokens=PANDAS_NULL_TOKENS).orderBy("k").collect()]
    assert pandas_like == [None, None, "kept"]
    root = _tree()
    st = {r.name: r.status for r in inventory(spark, root, ignore_case=True).collect()}
    assert st["X.PDF"] == "supported"


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab.*?[]!-")), min_size=1, max_size=8),
       st.text(st.sampled_from(list("ab.-!")), min_size=0, max_size=8))
def test_glob_translation_matches_fnmatch(glob_, name):
    import fnmatch
    import re

    try:
        want = fnmatch.fnmatchcase(name, glob_)
    except re.error:
        return
    assert bool(re.match(glob_regex(glob_), name)) == want, (glob_, name, glob_regex(glob_))


def test_tricky_globs_on_spark_match_fnmatch(spark):
    import fnmatch

    globs = ["[]a]*", "[!]]x", "a[-b]", "*[!.]", "[!a-b]*", "a[", "[[]a", "x[!-]y", "[^a]", "[a&&b]", "[\\]", "[]"]
    names = ["]x", "a", "-", "b", ".", "]", "ax", "x-y", "xay", "[a", "^", "&", "\\", "[]", "file.csv"]
    rows = [(g, n) for g in globs for n in names]
    df = spark.createDataFrame(rows, "g string, n string")
    checks = [F.when(F.col("g") == g, F.col("n").rlike(glob_regex(g))) for g in globs]
    got = df.select("g", "n", F.coalesce(*checks).alias("m")).collect()
    assert [r.m for r in got] == [fnmatch.fnmatchcase(r.n, r.g) for r in got]


def test_inventory_accepts_file_uris(spark):
    root = _tree()
    a = sorted((r.rel_path, r.status) for r in inventory(spark, root).collect())
    b = sorted((r.rel_path, r.status) for r in inventory(spark, "file://" + root).collect())
    assert a == b and ("a.csv", "supported") in a


def test_inventory_lists_empty_files(spark):
    root = _tree()
    open(os.path.join(root, "zero.csv"), "w").close()
    got = {r.name: (r.length, r.status) for r in inventory(spark, root).collect()}
    assert got["zero.csv"] == (0, "supported") and got["a.csv"][1] == "supported"
