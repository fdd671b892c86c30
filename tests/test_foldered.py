"""Renders as a folder a document: pages evaluated once, Spark's layout, read back by tasks."""

import os
import tempfile

from pyspark.sql import functions as F

from scrub.operators.documents import redact_pages, write_renders
from scrub.sources.foldered import read_foldered, write_foldered


def _out():
    return tempfile.mkdtemp(prefix="scrub-foldered-") + "/out"


def test_pages_are_evaluated_once_for_all_formats(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"page {i}"

    pages = spark.range(0, 40, 1, 4).select(F.expr("id div 5").alias("doc_id"), (F.col("id") % 5).alias("page_number"),
                                            text.asNondeterministic()("id").alias("text"))
    out = _out()
    write_renders(redact_pages(pages), out)
    assert seen.value == 40
    assert sorted(os.listdir(out)) == ["json", "md", "txt"]
    assert read_foldered(spark, f"{out}/json", "doc_id").count() == 40


def test_layout_is_that_of_sparks_writer(spark):
    keys = ["a/b=1%", "x y", "é[", "__HIVE_DEFAULT_PARTITION__", "", None, 'q"?*:\\', "{}^#'"]
    docs = spark.createDataFrame([(k, 1, "t") for k in keys], "doc_id string, page_number int, text string")
    out = _out()
    write_renders(redact_pages(docs), out, formats=("txt",))
    docs.select("doc_id", "text").write.partitionBy("doc_id").text(f"{out}/spark")
    folders = [{n for n in os.listdir(f"{out}/{d}") if n.startswith("doc_id=")} for d in ("txt", "spark")]
    assert folders[0] == folders[1]
    back = read_foldered(spark, f"{out}/txt", "doc_id", whole=True).collect()
    assert {r.doc_id for r in back} == {k or None for k in keys} - {"__HIVE_DEFAULT_PARTITION__"}


def test_a_document_cut_among_tasks_is_read_in_order(spark):
    rows = spark.range(0, 3000, 1, 3).select(F.when(F.col("id") < 2990, "big").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("key"),
                                             (3000 - F.col("id")).alias("order"), F.col("id").cast("string").alias("value"))
    out, before = _out(), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_foldered(rows, out, "doc")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = sorted(os.listdir(f"{out}/doc=big"))
    lines = "".join(open(f"{out}/doc=big/{p}").read() for p in parts).split("\n")[:-1]
    assert len(parts) > 1 and lines == [str(i) for i in range(2989, -1, -1)]
    got = read_foldered(spark, out, "doc")
    assert got.count() == 3000 and got.select("doc").distinct().count() == 11
    assert sorted(os.listdir(out))[0] == "_SUCCESS" and not any(n.startswith("_work") for n in os.listdir(out))


def test_no_rows_give_an_empty_render(spark):
    docs = spark.createDataFrame([], "doc_id string, page_number int, text string")
    out = _out()
    write_renders(redact_pages(docs), out)
    assert [read_foldered(spark, f"{out}/{f}", "doc_id").count() for f in ("txt", "md", "json")] == [0, 0, 0]
