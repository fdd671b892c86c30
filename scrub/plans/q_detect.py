"""Registered queries: each scored detection rule on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.functions import rules as R
from scrub.functions.arrays import explode_kept
from scrub.functions.spans import rule_spans
from scrub.operators.redact import scored_stage
from scrub.plans import sqlgen as S
from scrub.plans.catalog import stmt, table
from scrub.plans.registry import query
from scrub.policy import CustomPattern, Policy

W = S.stmt_cte()


def detect(df, key: str, text_col: str, rule: R.Rule):
    """One row per hit of ``rule``: ``(key, entity_type, start_pos, end_pos, hit, score)``."""
    t = F.col(text_col)
    spans = rule_spans(t, rule.spark_pattern, R.SCORED_STAGE, rule.entity_type, rule.score_of, None, True)
    src = df.select(key, text_col)
    if rule.guard is not None:
        src = src.where(rule.guard(t))
    return explode_kept(src, [key], spans, "s").select(
        key,
        F.col("s.entity_type").alias("entity_type"),
        F.col("s.start").alias("start_pos"),
        F.col("s.end").alias("end_pos"),
        F.col("s.text").alias("hit"),
        F.col("s.score").alias("score"),
    )


def _sql(table_sql: str, key: str, text: str, rule: R.Rule, score_sql: str | None = None) -> str:
    score = score_sql or f"cast({rule.score} as double)"
    return f"""
select {key}, '{rule.entity_type}' as entity_type, start_pos, cast(start_pos + length(hit) as integer) as end_pos,
       hit, cast({score.replace("HIT", "hit")} as double) as score
from {S.hit_rows(table_sql, key, text, S.re2(rule.pattern))}"""


B = R.BUILTIN_BY_TYPE


@query("detect_email", _sql("documents", "doc_id", "text", B[R.EMAIL_ADDRESS]))
def q_detect_email(spark, sf):
    return detect(table(spark, sf, "documents"), "doc_id", "text", B[R.EMAIL_ADDRESS])


@query("detect_phone", _sql("documents", "doc_id", "text", B[R.PHONE_NUMBER]))
def q_detect_phone(spark, sf):
    return detect(table(spark, sf, "documents"), "doc_id", "text", B[R.PHONE_NUMBER])


@query("detect_ip", _sql("documents", "doc_id", "text", B[R.IP_ADDRESS]))
def q_detect_ip(spark, sf):
    return detect(table(spark, sf, "documents"), "doc_id", "text", B[R.IP_ADDRESS])


@query("detect_url", _sql("pages", "page_id", "url", B[R.URL]))
def q_detect_url(spark, sf):
    return detect(table(spark, sf, "pages"), "page_id", "url", B[R.URL])


@query("detect_ssn", f"with {W} " + _sql("stmt", "o_orderkey", "ssn", B[R.US_SSN]))
def q_detect_ssn(spark, sf):
    return detect(stmt(spark, sf), "o_orderkey", "ssn", B[R.US_SSN])


@query("detect_date", f"with {W} " + _sql("stmt", "o_orderkey", "date", B[R.DATE_TIME]))
def q_detect_date(spark, sf):
    return detect(stmt(spark, sf), "o_orderkey", "date", B[R.DATE_TIME])


_LUHN_SCORE = f"case when {S.luhn_ok('HIT')} then 1.0 else 0.3 end"


@query("detect_card_luhn", _sql("documents", "doc_id", "text", B[R.CREDIT_CARD], _LUHN_SCORE))
def q_detect_card_luhn(spark, sf):
    return detect(table(spark, sf, "documents"), "doc_id", "text", B[R.CREDIT_CARD])


@query("detect_bank", _sql("documents", "doc_id", "text", B[R.US_BANK_NUMBER]))
def q_detect_bank(spark, sf):
    return detect(table(spark, sf, "documents"), "doc_id", "text", B[R.US_BANK_NUMBER])


@query("threshold_filter", f"""
select * from ({_sql("documents", "doc_id", "text", B[R.CREDIT_CARD], _LUHN_SCORE)}) where score >= 0.5""")
def q_threshold_filter(spark, sf):
    """The scored stage itself drops what is below the threshold: numbers that fail the checksum have 0.3."""
    stage = scored_stage(F.col("text"), Policy(rules=(R.CREDIT_CARD,), include_text=True))
    d = table(spark, sf, "documents")
    return explode_kept(d, ["doc_id"], stage["spans"], "s").select(
        "doc_id", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"),
        F.col("s.text").alias("hit"), F.col("s.score").alias("score"))


# Configured identities (policy values) looked up in a table-derived text.
IDENTITY_POLICY = Policy(
    identities=("Customer#000000001", "Customer#000000007"),
    aliases=("customer#000000010",),
)


@query("detect_identity", f"with {W} " + _sql("stmt", "o_orderkey", "name", R.identity_rule(IDENTITY_POLICY)))
def q_detect_identity(spark, sf):
    return detect(stmt(spark, sf), "o_orderkey", "name", R.identity_rule(IDENTITY_POLICY))


CUSTOMER_ID = CustomPattern("customer_id", r"\bCustomer#[0-9]{9}\b", "replace", "[CUSTOMER_ID]")


@query("detect_custom", f"with {W} " + _sql("stmt", "o_orderkey", "name", R.custom_rule(CUSTOMER_ID)))
def q_detect_custom(spark, sf):
    return detect(stmt(spark, sf), "o_orderkey", "name", R.custom_rule(CUSTOMER_ID))
