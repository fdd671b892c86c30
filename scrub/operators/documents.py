"""Documents as rows of pages: paging, in-page tables, renders and the redaction map.

A document is any DataFrame of ``(doc, page_number, text)``.  Redaction is
row-local (one projection); rendering a document gathers only its own pages'
pre-rendered strings with one ``groupBy(doc)`` (a single shuffle, partial
aggregation map-side), then sorts them by page inside the group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrub.functions.arrays import explode_kept
from scrub.operators.redact import redact
from scrub.policy import DEFAULT_POLICY, Policy
from scrub.sources.foldered import folder_key, write_foldered

# Fixed layout values of the renders.
MD_NOTICE = "> **Note:** This document has been processed by scrub. All detected PII has been redacted.\n\n"
PAGE_END = "\n\n"
PREVIEW_CHARS = 200


def pages_from_lines(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Page a text column by line: ``(doc, page_number, text)``, pages numbered from 1."""
    return explode_kept(df, [doc], F.split(F.col(text), "\n", -1), "text", pos="pos").select(
        doc, (F.col("pos") + 1).cast("int").alias("page_number"), "text"
    )


def flatten_tables(tables: Column) -> Column:
    """Text of in-page tables: every non-empty row as ``\\n`` + tab-joined cells, null cells empty.

    ``tables`` is ``array<array<array<string>>>`` (tables, rows, cells).  Cells
    are joined with ``array_join(transform(coalesce))``: ``concat_ws`` would
    drop nulls and shift the columns.
    """
    rows = F.flatten(tables)
    lines = F.transform(
        F.filter(rows, lambda r: F.size(r) > 0),
        lambda r: F.concat(F.lit("\n"), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")),
    )
    return F.coalesce(F.array_join(lines, ""), F.lit(""))


def page_text(text: Column, tables: Column | None = None) -> Column:
    """Page text with its tables appended (the caller chooses; tables may repeat the text)."""
    base = F.coalesce(text, F.lit(""))
    return base if tables is None else F.concat(base, flatten_tables(tables))


def redact_pages(pages: DataFrame, policy: Policy = DEFAULT_POLICY, text: str = "text") -> DataFrame:
    """Add ``redacted``, ``entities`` and ``changed`` to every page."""
    r = redact(F.col(text), policy)
    return pages.select("*", r["redacted"].alias("redacted"), r["entities"].alias("entities"),
                        r["changed"].alias("changed"))


def render_txt(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "redacted") -> DataFrame:
    """``(doc, txt)``: ``=== Page N ===`` then the page text and a blank line, pages in order."""
    piece = F.concat(F.lit("=== Page "), F.col(page).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(text), F.lit("")),
                     F.lit(PAGE_END))
    parts = pages.select(doc, F.struct(F.col(page).alias("p"), piece.alias("s")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "")
    return parts.groupBy(doc).agg(body.alias("txt"))


def render_md(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", text: str = "redacted",
              source_name: str | None = None) -> DataFrame:
    """``(doc, md)``: title with the source name, a notice, then ``## Page N`` sections."""
    piece = F.concat(F.lit("## Page "), F.col(page).cast("string"), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")),
                     F.lit(PAGE_END))
    name = F.col(source_name) if source_name else F.col(doc).cast("string")
    parts = pages.select(doc, name.alias("_name"), F.struct(F.col(page).alias("p"), piece.alias("s")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "")
    g = parts.groupBy(doc).agg(F.min("_name").alias("_name"), body.alias("_body"))
    title = F.concat(F.lit("# Sanitized: "), F.col("_name"), F.lit("\n\n"), F.lit(MD_NOTICE))
    return g.select(doc, F.concat(title, F.col("_body")).alias("md"))


def redaction_map_rows(pages: DataFrame, doc: str = "doc_id", page: str = "page_number") -> DataFrame:
    """Flat redaction map: one row per page with its finding count and a 200-character preview."""
    return pages.select(
        doc,
        page,
        F.size("entities").cast("int").alias("n_entities"),
        F.substring("redacted", 1, PREVIEW_CHARS).alias("redacted_text_preview"),
    )


def redaction_map_json(pages: DataFrame, doc: str = "doc_id", page: str = "page_number", source: str | None = None) -> DataFrame:
    """``(doc, json)``: the nested map per document (pages sorted, entities included)."""
    entry = F.struct(
        F.col(page).alias("page_number"),
        F.col("entities").alias("entities_detected"),
        F.substring("redacted", 1, PREVIEW_CHARS).alias("redacted_text_preview"),
    )
    src = F.col(source) if source else F.col(doc).cast("string")
    g = pages.groupBy(doc).agg(F.min(src).alias("source"), F.array_sort(F.collect_list(entry)).alias("pages"))
    return g.select(doc, F.to_json(F.struct("source", "pages")).alias("json"))


def preview_lines(df: DataFrame, doc: str, before: str, after: str, n: int = 20) -> DataFrame:
    """Lines that differ among the first ``n`` lines, zipped by position: ``(doc, line_no, before, after)``."""
    z = F.arrays_zip(F.slice(F.split(F.col(before), "\n", -1), 1, n).alias("b"),
                     F.slice(F.split(F.col(after), "\n", -1), 1, n).alias("a"))
    return (
        explode_kept(df, [doc], z, "x", pos="pos")
        .where(~F.col("x.b").eqNullSafe(F.col("x.a")))
        .select(doc, (F.col("pos") + 1).cast("int").alias("line_no"), F.col("x.b").alias("before"),
                F.col("x.a").alias("after"))
    )


def _txt_piece(page: str, text: str) -> Column:
    return F.concat(F.lit("=== Page "), F.col(page).cast("string"), F.lit(" ===\n"), F.coalesce(F.col(text), F.lit("")),
                    F.lit(PAGE_END))


def preview_pages(pages: DataFrame, policy: Policy = DEFAULT_POLICY, doc: str = "doc_id", page: str = "page_number",
                  text: str = "text", n_pages: int = 3, n_lines: int = 20) -> DataFrame:
    """Document preview: the first ``n_pages`` pages, their differing lines among the first ``n_lines``.

    ``(doc, page, line_no, before, after)``; the page limit is the feature (a
    preview), each previewed page is redacted whole.
    """
    head = pages.where(F.col(page) <= n_pages)
    red = redact_pages(head.select(doc, page, text), policy, text)
    diff = preview_lines(red.withColumn("_key", F.struct(F.col(doc).alias("d"), F.col(page).alias("p"))),
                         "_key", text, "redacted", n_lines)
    return diff.select(F.col("_key.d").alias(doc), F.col("_key.p").alias(page), "line_no", "before", "after")


def write_renders(pages: DataFrame, out_dir: str, formats=("txt", "md", "json"), doc: str = "doc_id",
                  page: str = "page_number", source_name: str | None = None, mode: str = "errorifexists") -> list[str]:
    """Write the chosen renders, one folder per document and format, without gathering pages.

    Pages are evaluated once, into a work table that all formats read and that goes
    with the run.  Page pieces are range-partitioned on ``(doc, page)`` and sorted,
    then written by tasks to ``<doc>=<value>/part-*``: a document's file is the
    concatenation of its part files in part order.  A very large document spans
    several tasks instead of being collected into one row.  Every piece ends with
    the newline that the writer adds, so each drops its own last one.
    """
    spark = pages.sparkSession
    written = []
    name = F.col(source_name) if source_name else F.col(doc).cast("string")
    wanted = [folder_key(F.col(doc)).alias("key"), F.col(page).alias("order"), name.alias("name")]
    if "txt" in formats or "md" in formats:
        wanted.append(F.coalesce(F.col("redacted"), F.lit("")).alias("redacted"))
    if "json" in formats:
        wanted.append(F.to_json(F.struct(name.alias("source"), F.col(page).alias("page_number"),
                                         F.col("entities").alias("entities_detected"),
                                         F.substring("redacted", 1, PREVIEW_CHARS).alias("redacted_text_preview")))
                      .alias("entry"))
    work = f"{out_dir.rstrip('/')}/_work-{uuid.uuid4().hex}"

    def emit(rows: DataFrame, sub: str):
        path = f"{out_dir}/{sub}"
        write_foldered(rows, path, doc, mode)
        written.append(path)

    try:
        pages.select(*wanted).write.parquet(work)
        keyed = spark.read.parquet(work)
        if "txt" in formats:
            piece = _txt_piece("order", "redacted")
            emit(keyed.select("key", "order", piece.substr(F.lit(1), F.length(piece) - 1).alias("value")), "txt")
        if "md" in formats:
            body = F.concat(F.lit("## Page "), F.col("order").cast("string"), F.lit("\n\n"), F.col("redacted"), F.lit("\n"))
            heads = keyed.groupBy("key").agg(F.min("name").alias("name")).select(
                "key", F.lit(-1).cast(keyed.schema["order"].dataType).alias("order"),
                F.concat(F.lit("# Sanitized: "), F.col("name"), F.lit("\n\n"), F.lit(MD_NOTICE.rstrip("\n")), F.lit("\n"))
                .alias("value"))
            emit(heads.unionByName(keyed.select("key", "order", body.alias("value"))), "md")
        if "json" in formats:
            emit(keyed.select("key", "order", F.col("entry").alias("value")), "json")
    finally:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(work)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return written
