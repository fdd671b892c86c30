"""Registered queries: number masking (values and inside text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.functions import patterns as P
from scrub.functions.arrays import explode_kept
from scrub.functions.mask import ACCOUNT_NUMBER, CARD_NUMBER, financial_mask, mask_account, mask_card
from scrub.plans import sqlgen as S
from scrub.plans.catalog import stmt, table
from scrub.plans.registry import query
from scrub.policy import FinancialRules

W = S.stmt_cte()


def _n_type(spans, et):
    return F.size(F.filter(spans, lambda s: s["entity_type"] == et)).cast("int")


@query("mask_card", f"""with {W}
select o_orderkey, card_number, {S.mask_value('card_number', guard=True)} as masked from stmt""")
def q_mask_card(spark, sf):
    return stmt(spark, sf).select("o_orderkey", "card_number", mask_card("card_number").alias("masked"))


@query("mask_account", f"""with {W}
select o_orderkey, account_number, {S.mask_value('account_number')} as masked from stmt""")
def q_mask_account(spark, sf):
    return stmt(spark, sf).select("o_orderkey", "account_number", mask_account("account_number").alias("masked"))


@query("mask_last_n", f"""with {W}
select o_orderkey, {S.mask_value('card_number', 6, '#', guard=True)} as masked from stmt""")
def q_mask_last_n(spark, sf):
    return stmt(spark, sf).select("o_orderkey", mask_card("card_number", 6, "#").alias("masked"))


_CARD_IN_DESC = "card (.*)$"


@query("mask_separated", f"""with {W}, c as (select o_orderkey, regexp_extract(description, {S.lit(_CARD_IN_DESC)}, 1) as card from stmt)
select o_orderkey, card, {S.mask_value('card', guard=True)} as masked from c""")
def q_mask_separated(spark, sf):
    c = stmt(spark, sf).select("o_orderkey", F.regexp_extract("description", _CARD_IN_DESC, 1).alias("card"))
    return c.select("o_orderkey", "card", mask_card("card").alias("masked"))


@query("mask_short", f"""
select c_custkey, {S.mask_value('cast(c_nationkey as varchar)')} as nation_masked,
       {S.mask_value('cast(c_custkey as varchar)')} as key_masked from customer""")
def q_mask_short(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        "c_custkey",
        mask_account(F.col("c_nationkey").cast("string")).alias("nation_masked"),
        mask_account(F.col("c_custkey").cast("string")).alias("key_masked"),
    )


@query("already_masked", f"""with {W}, m as (select o_orderkey, {S.mask_value('card_number', guard=True)} as once from stmt)
select o_orderkey, once, {S.mask_value('once', guard=True)} as twice from m""")
def q_already_masked(spark, sf):
    m = stmt(spark, sf).select("o_orderkey", mask_card("card_number").alias("once"))
    return m.select("o_orderkey", "once", mask_card("once").alias("twice"))


@query("routing_exempt", f"""
select c_custkey, {S.financial('c_name')} as masked,
       cast({S.n_card_masked('c_name')} + {S.n_account_masked(S.card_mask('c_name'))} as integer) as n_masked
from customer""")
def q_routing_exempt(spark, sf):
    f = financial_mask(F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey", f["text"].alias("masked"), F.size(f["spans"]).cast("int").alias("n_masked")
    )


@query("routing_mask", f"""
select c_custkey, {S.routing_mask(S.financial('c_name'))} as masked from customer""")
def q_routing_mask(spark, sf):
    f = financial_mask(F.col("c_name"), FinancialRules(mask_routing=True), with_spans=False)
    return table(spark, sf, "customer").select("c_custkey", f["text"].alias("masked"))


@query("card_scan", f"""
select doc_id, cast(i as integer) as i, hit, start_pos, cast(start_pos + length(hit) as integer) as end_pos
from {S.hit_rows('documents', 'doc_id', 'text', P.CARD_RE)}""")
def q_card_scan(spark, sf):
    return _scan(table(spark, sf, "documents"), P.CARD_RE)


@query("account_scan", f"""
select doc_id, cast(i as integer) as i, hit, start_pos, cast(start_pos + length(hit) as integer) as end_pos
from {S.hit_rows('documents', 'doc_id', 'text', P.ACCOUNT_RE)}""")
def q_account_scan(spark, sf):
    return _scan(table(spark, sf, "documents"), P.ACCOUNT_RE)


def _scan(docs, pattern):
    from scrub.functions.spans import offsets_of

    hits = docs.select(
        "doc_id",
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(pattern), 0).alias("hit"),
            offsets_of(F.col("text"), pattern).alias("pos"),
        ).alias("z"),
    )
    return explode_kept(hits, ["doc_id"], F.col("z"), "x", pos="i0").select(
        "doc_id",
        (F.col("i0") + 1).cast("int").alias("i"),
        F.col("x.hit").alias("hit"),
        F.col("x.pos.start").alias("start_pos"),
        F.col("x.pos.end").alias("end_pos"),
    )


@query("financial_mask", f"""
with t as (select doc_id, text as t0, {S.card_mask('text')} as t1 from documents)
select doc_id, {S.account_mask('t1')} as masked,
       cast({S.n_card_masked('t0')} as integer) as n_card,
       cast({S.n_account_masked('t1')} as integer) as n_account
from t""")
def q_financial_mask(spark, sf):
    f = financial_mask(F.col("text"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", f.alias("f"))
        .select(
            "doc_id",
            F.col("f.text").alias("masked"),
            _n_type(F.col("f.spans"), CARD_NUMBER).alias("n_card"),
            _n_type(F.col("f.spans"), ACCOUNT_NUMBER).alias("n_account"),
        )
    )
