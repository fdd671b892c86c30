"""Registered queries: documents as pages, in-page tables, renders, redaction map, previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.functions.arrays import explode_kept
from scrub.operators.documents import (flatten_tables, page_text, pages_from_lines, preview_lines, preview_pages, redact_pages,
                                       redaction_map_json, redaction_map_rows, render_md, render_txt, write_renders)
from scrub.plans import sqlgen as S
from scrub.plans import sqlpipe as SP
from scrub.plans.catalog import scratch_dir, stmt, table
from scrub.plans.registry import ORACLE_SQL, query
from scrub.policy import DEFAULT_POLICY
from scrub.sources.foldered import read_foldered

W = S.stmt_cte()
NL = "chr(10)"


@query("src_document_pages", f"""
select doc_id, cast(unnest(range(1, len(parts) + 1)) as integer) as page_number, unnest(parts) as text
from (select doc_id, string_split(text, {NL}) as parts from documents)""")
def q_src_document_pages(spark, sf):
    return pages_from_lines(table(spark, sf, "documents"), "doc_id", "text")


@query("flatten_table_rows", f"""with {W}
select o_orderkey, description || {NL} || array_to_string(list_transform([date, description, amount, card_number],
       lambda c: coalesce(c, '')), chr(9)) as page_text from stmt""")
def q_flatten_table_rows(spark, sf):
    s = stmt(spark, sf)
    tables = F.array(F.array(F.array("date", "description", "amount", "card_number")))
    return s.select("o_orderkey", page_text(F.col("description"), tables).alias("page_text"))


def _conv_pages(spark, sf):
    conv = table(spark, sf, "conversations").withColumnRenamed("turn", "page_number")
    return redact_pages(conv, DEFAULT_POLICY)


CONV_PIPE, _ = SP.pipeline_ctes("conversations", "conv_id, turn", "text", DEFAULT_POLICY, name="c")


_RENDER_TXT_SQL = f"""with {CONV_PIPE}
select conv_id, string_agg('=== Page ' || cast(turn as varchar) || ' ===' || {NL} || coalesce(tf, '') || {NL} || {NL}, ''
                           order by turn) as txt
from c group by conv_id"""


@query("render_txt", _RENDER_TXT_SQL)
def q_render_txt(spark, sf):
    return render_txt(_conv_pages(spark, sf), "conv_id", "page_number")


@query("sink_renders", _RENDER_TXT_SQL)
def q_sink_renders(spark, sf):
    """Write the txt render with the skew-safe writer, read the files back, reassemble per document."""
    out = scratch_dir(spark, "renders")
    write_renders(_conv_pages(spark, sf), out, formats=("txt",), doc="conv_id", page="page_number")
    return _reassembled(spark, f"{out}/txt", "txt")


_MD_NOTICE_SQL = S.lit("> **Note:** This document has been processed by scrub. All detected PII has been redacted.")


@query("render_md", f"""with {CONV_PIPE}
select conv_id, '# Sanitized: ' || min('conversation-' || cast(conv_id as varchar) || '.pdf') || {NL} || {NL}
       || {_MD_NOTICE_SQL} || {NL} || {NL}
       || string_agg('## Page ' || cast(turn as varchar) || {NL} || {NL} || coalesce(tf, '') || {NL} || {NL}, '' order by turn) as md
from c group by conv_id""")
def q_render_md(spark, sf):
    pages = _conv_pages(spark, sf).withColumn(
        "source_name", F.concat(F.lit("conversation-"), F.col("conv_id").cast("string"), F.lit(".pdf")))
    return render_md(pages, "conv_id", "page_number", source_name="source_name")


@query("redaction_map", f"""with {CONV_PIPE}
select conv_id, cast(turn as integer) as page_number, n_entities, substring(tf, 1, 200) as redacted_text_preview from c""")
def q_redaction_map(spark, sf):
    pages = _conv_pages(spark, sf).withColumn("page_number", F.col("page_number").cast("int"))
    return redaction_map_rows(pages, "conv_id", "page_number")


DOC_PIPE, _ = SP.pipeline_ctes("documents", "doc_id", "text", DEFAULT_POLICY, name="d")


@query("preview_lines", f"""with {DOC_PIPE},
z as (select doc_id, unnest(range(1, len(b) + 1)) as i, unnest(b) as before, unnest(a) as after
      from (select doc_id, string_split(t0, {NL})[1:20] as b, string_split(tf, {NL})[1:20] as a from d))
select doc_id, cast(i as integer) as line_no, before, after from z where before is distinct from after""")
def q_preview_lines(spark, sf):
    docs = redact_pages(table(spark, sf, "documents").select("doc_id", "text"), DEFAULT_POLICY)
    return preview_lines(docs, "doc_id", "text", "redacted", n=20)


@query("audit_pages", f"""select doc_id, cast(len(string_split(text, {NL})) as bigint) as pages from documents
where text is not null""")
def q_audit_pages(spark, sf):
    pages = pages_from_lines(table(spark, sf, "documents"), "doc_id", "text")
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


__all__ = ["flatten_tables"]


@query("sink_renders_md", ORACLE_SQL["render_md"])
def q_sink_renders_md(spark, sf):
    """The md render written with the skew-safe writer, read back and reassembled."""
    pages = _conv_pages(spark, sf).withColumn(
        "source_name", F.concat(F.lit("conversation-"), F.col("conv_id").cast("string"), F.lit(".pdf")))
    out = scratch_dir(spark, "renders-md")
    write_renders(pages, out, formats=("md",), doc="conv_id", page="page_number", source_name="source_name")
    return _reassembled(spark, f"{out}/md", "md")


def _reassembled(spark, path, name):
    """Each document's part files in part order, as one text."""
    back = read_foldered(spark, path, "conv_id", whole=True).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("file").alias("f"), F.col("value").alias("v")).alias("part"))
    parts = F.array_sort(F.collect_list("part"))
    return back.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias(name))


def _volumes(spark, sf):
    """Volumes of five documents, a page each."""
    return table(spark, sf, "documents").select(
        F.expr("doc_id div 5").alias("volume"), (F.col("doc_id") % 5 + 1).alias("page_number"), "text")


@query("preview_pages", f"""with {DOC_PIPE},
z as (select volume, page_number, unnest(range(1, len(b) + 1)) as i, unnest(b) as before, unnest(a) as after
      from (select doc_id // 5 as volume, doc_id % 5 + 1 as page_number, string_split(t0, {NL})[1:20] as b,
                   string_split(tf, {NL})[1:20] as a from d where doc_id % 5 < 3))
select volume, page_number, cast(i as integer) as line_no, before, after from z where before is distinct from after""")
def q_preview_pages(spark, sf):
    """Differing lines among the first 20 of a volume's first 3 pages."""
    return preview_pages(_volumes(spark, sf), DEFAULT_POLICY, "volume", "page_number")


_MAP_ENTITIES_SQL = f"""with {DOC_PIPE}
select doc_id // 5 as volume, doc_id % 5 + 1 as page_number, stage, entity_type, start_pos, end_pos, masked, score
from ({SP.entity_rows_sql('d', 'doc_id', DEFAULT_POLICY)})"""
_MAP_PAGE = ("page_number:bigint,redacted_text_preview:string,"
             "entities_detected:array<struct<stage:string,entity_type:string,start:int,`end`:int,score:double,masked:string>>")


def _map_entities(pages):
    """One row for each entity of (volume, p), p a page of the redaction map."""
    return explode_kept(pages, ["volume", F.col("p.page_number").alias("page_number")], F.col("p.entities_detected"), "e").select(
        "volume", "page_number", "e.stage", "e.entity_type", F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos"),
        "e.masked", "e.score")


@query("redaction_map_json", _MAP_ENTITIES_SQL)
def q_redaction_map_json(spark, sf):
    """The nested map of every document as JSON, its entities read back from that JSON."""
    maps = redaction_map_json(redact_pages(_volumes(spark, sf), DEFAULT_POLICY), "volume", "page_number")
    nested = F.from_json("json", f"struct<source:string,pages:array<struct<{_MAP_PAGE}>>>")
    pages = explode_kept(maps, ["volume"], nested["pages"], "p")
    return _map_entities(pages)


@query("sink_renders_json", _MAP_ENTITIES_SQL)
def q_sink_renders_json(spark, sf):
    """The map as written by the skew-safe writer, a line of JSON a page, its entities read back."""
    out = scratch_dir(spark, "renders-json")
    write_renders(redact_pages(_volumes(spark, sf), DEFAULT_POLICY), out, formats=("json",), doc="volume", page="page_number")
    lines = read_foldered(spark, f"{out}/json", "volume")
    return _map_entities(lines.select(F.col("volume").cast("long").alias("volume"), F.from_json("value", f"struct<{_MAP_PAGE}>").alias("p")))
