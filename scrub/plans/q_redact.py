"""Registered queries: the full pipeline on documents, spans, overlaps, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.functions import rules as R
from scrub.functions.arrays import explode_kept
from scrub.operators.audit import count_by, explode_entities
from scrub.operators.redact import redact, redact_by_lang, scored_stage
from scrub.plans import sqlgen as S
from scrub.plans import sqlpipe as SP
from scrub.plans.catalog import table
from scrub.plans.registry import query
from scrub.policy import DEFAULT_POLICY, EntityConfig, Policy

DOC_PIPE, _ = SP.pipeline_ctes("documents", "doc_id, source", "text", DEFAULT_POLICY)


def redacted_documents(spark, sf, policy: Policy = DEFAULT_POLICY):
    docs = table(spark, sf, "documents")
    r = redact(F.col("text"), policy)
    return docs.select("doc_id", "source", "text", r.alias("r"))


@query("redact_documents", f"""with {DOC_PIPE}
select doc_id, tf as redacted, n_entities, changed from p""")
def q_redact_documents(spark, sf):
    return redacted_documents(spark, sf).select(
        "doc_id",
        F.col("r.redacted").alias("redacted"),
        F.size("r.entities").cast("int").alias("n_entities"),
        F.col("r.changed").alias("changed"),
    )


_ENT_COLS = "doc_id, stage, entity_type, start_pos, end_pos, masked, score"


@query("entity_table", f"""with {DOC_PIPE}
select {_ENT_COLS} from ({SP.entity_rows_sql('p', 'doc_id, source', DEFAULT_POLICY)})""")
def q_entity_table(spark, sf):
    return explode_entities(redacted_documents(spark, sf), ["doc_id"], "r.entities")


@query("all_entities", f"""with {DOC_PIPE}
select stage, entity_type, count(*) as n from ({SP.entity_rows_sql('p', 'doc_id, source', DEFAULT_POLICY)})
group by stage, entity_type""")
def q_all_entities(spark, sf):
    return count_by(explode_entities(redacted_documents(spark, sf), ["doc_id"], "r.entities"), "stage", "entity_type")


@query("count_by_source_type", f"""with {DOC_PIPE}
select source, entity_type, count(*) as n from ({SP.entity_rows_sql('p', 'doc_id, source', DEFAULT_POLICY)})
group by source, entity_type""")
def q_count_by_source_type(spark, sf):
    f = explode_entities(redacted_documents(spark, sf), ["source"], "r.entities")
    return count_by(f, "source", "entity_type")


@query("count_by_doc_type", f"""with {DOC_PIPE}
select doc_id, entity_type, count(*) as n from ({SP.entity_rows_sql('p', 'doc_id, source', DEFAULT_POLICY)})
group by doc_id, entity_type""")
def q_count_by_doc_type(spark, sf):
    f = explode_entities(redacted_documents(spark, sf), ["doc_id"], "r.entities")
    return count_by(f, "doc_id", "entity_type")


@query("text_preview", f"""with {DOC_PIPE}
select doc_id, substring(tf, 1, 200) as preview from p""")
def q_text_preview(spark, sf):
    return redacted_documents(spark, sf).select("doc_id", F.substring("r.redacted", 1, 200).alias("preview"))


PAGE_PIPE, _ = SP.pipeline_ctes("pages", "page_id", "html", DEFAULT_POLICY, name="c")


@query("span_offsets", f"""with {PAGE_PIPE}
select page_id, stage, entity_type, start_pos, end_pos from ({SP.entity_rows_sql('c', 'page_id', DEFAULT_POLICY)})""")
def q_span_offsets(spark, sf):
    pages = table(spark, sf, "pages")
    r = pages.select("page_id", redact(F.col("html")).alias("r"))
    return explode_entities(r, ["page_id"], "r.entities").select(
        "page_id", "stage", "entity_type", "start_pos", "end_pos")


# A2: four rules in span form on the raw text, against chained replacement.
FOUR_RULES = Policy(rules=(R.EMAIL_ADDRESS, R.PHONE_NUMBER, R.IP_ADDRESS, R.CREDIT_CARD))


@query("replace_spans", f"""select doc_id, {SP.scored_sql('text', FOUR_RULES)} as replaced from documents""")
def q_replace_spans(spark, sf):
    s = scored_stage(F.col("text"), FOUR_RULES)
    return table(spark, sf, "documents").select("doc_id", s["text"].alias("replaced"))


# A3: card (Luhn-scored) against bank-number spans on the raw text, nothing dropped by threshold.
OVERLAP = Policy(rules=(R.CREDIT_CARD, R.US_BANK_NUMBER), confidence_threshold=0.0)
_card = S.hit_rows("documents", "doc_id", "text", R.BUILTIN_BY_TYPE[R.CREDIT_CARD].pattern)
_bank = S.hit_rows("documents", "doc_id", "text", R.BUILTIN_BY_TYPE[R.US_BANK_NUMBER].pattern)
_OVERLAP_SQL = f"""
with card as (select doc_id, start_pos, cast(start_pos + length(hit) as integer) as end_pos,
                     case when {S.luhn_ok('hit')} then 1.0 else 0.3 end as score from {_card}),
bank as (select doc_id, start_pos, cast(start_pos + length(hit) as integer) as end_pos from {_bank}),
a as (select * from card where score = 1.0),
b as (select * from bank x where not exists (select 1 from a where a.doc_id = x.doc_id
        and a.start_pos < x.end_pos and x.start_pos < a.end_pos)),
c as (select * from card x where score < 1.0
        and not exists (select 1 from a where a.doc_id = x.doc_id and a.start_pos < x.end_pos and x.start_pos < a.end_pos)
        and not exists (select 1 from b where b.doc_id = x.doc_id and b.start_pos < x.end_pos and x.start_pos < b.end_pos))
select doc_id, 'CREDIT_CARD' as entity_type, start_pos, end_pos, cast(score as double) as score from a
union all select doc_id, 'US_BANK_NUMBER', start_pos, end_pos, 0.4 from b
union all select doc_id, 'CREDIT_CARD', start_pos, end_pos, cast(score as double) from c
"""


@query("overlap_resolve", _OVERLAP_SQL)
def q_overlap_resolve(spark, sf):
    s = scored_stage(F.col("text"), OVERLAP)
    d = table(spark, sf, "documents").select("doc_id", s["spans"].alias("spans"))
    return explode_kept(d, ["doc_id"], F.col("spans"), "e").select(
        "doc_id", F.col("e.entity_type").alias("entity_type"), F.col("e.start").alias("start_pos"),
        F.col("e.end").alias("end_pos"), F.col("e.score").alias("score"))


# D19: one rule set per language.
LANG_POLICIES = {
    "de": Policy(entity_types={R.DATE_TIME: EntityConfig(enabled=False)}),
    "fr": Policy(confidence_threshold=0.7),
    "es": Policy(entity_types={R.EMAIL_ADDRESS: EntityConfig(replacement="[CORREO]")}),
}


def _lang_sql():
    ctes, cases = [], []
    for code, pol in LANG_POLICIES.items():
        c, name = SP.pipeline_ctes("documents", "doc_id, lang", "text", pol, name=f"l_{code}")
        ctes.append(c)
        cases.append((code, name))
    d, _ = SP.pipeline_ctes("documents", "doc_id, lang", "text", DEFAULT_POLICY, name="l_default")
    ctes.append(d)
    sel = " union all ".join(f"select doc_id, lang, tf as redacted from {n} where lang = '{c}'" for c, n in cases)
    others = ", ".join(f"'{c}'" for c in LANG_POLICIES)
    sel += f" union all select doc_id, lang, tf from l_default where lang is null or lang not in ({others})"
    return f"with {', '.join(ctes)} {sel}"


@query("redact_by_lang", _lang_sql())
def q_redact_by_lang(spark, sf):
    d = table(spark, sf, "documents")
    r = redact_by_lang(F.col("text"), F.col("lang"), LANG_POLICIES)
    return d.select("doc_id", "lang", r["redacted"].alias("redacted"))


# H1 merged into A3: the e-mail rule is replaced by a Python detector (Arrow-batched,
# Python ``re``); its spans join the rule spans before overlap resolution, so the
# result must equal the flagship's.
NO_NATIVE_EMAIL = Policy(rules=tuple(r.entity_type for r in R.BUILTIN_RULES if r.entity_type != R.EMAIL_ADDRESS))


@query("udf_detector_merged", f"""with {DOC_PIPE}
select doc_id, tf as redacted, n_entities, changed from p""")
def q_udf_detector_merged(spark, sf):
    from scrub.functions.detector import regex_detector
    from scrub.operators.redact import redact_frame

    email = regex_detector(R.EMAIL_RE, R.EMAIL_ADDRESS, 1.0)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    r = redact_frame(docs, "text", NO_NATIVE_EMAIL, detectors=(email,))
    return r.select("doc_id", F.col("r.redacted").alias("redacted"), F.size("r.entities").cast("int").alias("n_entities"),
                    F.col("r.changed").alias("changed"))
