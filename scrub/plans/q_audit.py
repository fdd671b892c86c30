"""Registered queries: audit counts, per-file results and the run report.

Each ``documents.source`` stands for one input file; its documents are the
units processed.  A unit fails when its text is missing (the file then fails,
the run goes on).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.operators.audit import count_by, explode_entities, map_total, ranked, run_summary, totals, unit_results
from scrub.operators.redact import redact
from scrub.plans import sqlpipe as SP
from scrub.plans.catalog import table
from scrub.plans.registry import query
from scrub.policy import DEFAULT_POLICY

PIPE, _ = SP.pipeline_ctes("documents", "doc_id, source", "text", DEFAULT_POLICY)
ROWS = SP.entity_rows_sql("p", "doc_id, source", DEFAULT_POLICY)
COUNTS = f"counts as (select source, entity_type, count(*) as n from ({ROWS}) group by source, entity_type)"
FILES = (
    "files as (select source, count(*) as rows_or_pages, cast(sum(cast(changed as bigint)) as bigint) as fields_changed, "
    "bool_and(t0 is not null) as success from p group by source)"
)


def _redacted(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "source", "text", redact(F.col("text"), DEFAULT_POLICY).alias("r"))


def _counts(red):
    return count_by(explode_entities(red, ["source"], "r.entities"), "source", "entity_type")


def _files(red):
    return unit_results(red, "source", F.transform("r.entities", lambda e: e["entity_type"]), "pdf", F.col("text").isNull(),
                        F.coalesce(F.col("r.changed"), F.lit(False)).cast("long"))


@query("audit_rows", f"""with {PIPE}, {FILES}
select source, rows_or_pages, fields_changed from files""")
def q_audit_rows(spark, sf):
    return _files(_redacted(spark, sf)).select(
        F.col("input_path").alias("source"), "rows_or_pages", "fields_changed")


@query("run_totals", f"""with {PIPE}, {FILES}
select count(*) as total_files, count_if(success) as successful_files, count_if(not success) as failed_files from files""")
def q_run_totals(spark, sf):
    return run_summary(_files(_redacted(spark, sf))).select("total_files", "successful_files", "failed_files")


@query("run_entity_totals", f"""with {PIPE}, {COUNTS}
select entity_type, cast(sum(n) as bigint) as n from counts group by entity_type""")
def q_run_entity_totals(spark, sf):
    return totals(_counts(_redacted(spark, sf)))


@query("entities_per_source", f"""with {PIPE}, {FILES}, {COUNTS}
select f.source, cast(coalesce(sum(c.n), 0) as bigint) as total_entities
from files f left join counts c on f.source = c.source group by f.source""")
def q_entities_per_source(spark, sf):
    files = _files(_redacted(spark, sf))
    return files.select(F.col("input_path").alias("source"), map_total(F.col("entities_by_type")).alias("total_entities"))


@query("run_report", f"""with {PIPE}, {FILES}, {COUNTS}
select count(*) as total_files, count_if(success) as successful_files, count_if(not success) as failed_files,
       cast(sum(rows_or_pages) as bigint) as rows_or_pages, cast(sum(fields_changed) as bigint) as fields_changed,
       cast((select coalesce(sum(n), 0) from counts) as bigint) as total_entities
from files""")
def q_run_report(spark, sf):
    return run_summary(_files(_redacted(spark, sf)))


@query("top_entities", f"""with {PIPE}, {COUNTS},
t as (select entity_type, cast(sum(n) as bigint) as n from counts group by entity_type)
select entity_type, n, cast(row_number() over (order by n desc, entity_type asc) as integer) as rank from t""")
def q_top_entities(spark, sf):
    return ranked(totals(_counts(_redacted(spark, sf))))


_UNION_INPUTS = (
    "u as (select 'documents' as kind, doc_id as id, text from documents "
    "union all select 'pages', page_id, html from pages "
    "union all select 'conversations', conv_id * 1000 + turn, text from conversations)"
)
_UPIPE, _ = SP.pipeline_ctes("u", "kind, id", "text", DEFAULT_POLICY, name="up")


@query("union_sources", f"""with {_UNION_INPUTS}, {_UPIPE}
select kind, entity_type, count(*) as n from ({SP.entity_rows_sql('up', 'kind, id', DEFAULT_POLICY)})
group by kind, entity_type""")
def q_union_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("documents").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.lit("pages").alias("kind"), F.col("page_id").alias("id"),
                                         F.col("html").alias("text"))
    c = table(spark, sf, "conversations").select(F.lit("conversations").alias("kind"),
                                                 (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    u = d.unionByName(p).unionByName(c)
    red = u.select("kind", "id", redact(F.col("text"), DEFAULT_POLICY).alias("r"))
    return count_by(explode_entities(red, ["kind"], "r.entities"), "kind", "entity_type")
