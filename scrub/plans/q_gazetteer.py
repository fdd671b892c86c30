"""Registered queries: dictionary detection (PERSON, LOCATION, NRP) over table-derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.functions import rules as R
from scrub.operators.gazetteer import WORD_RE, gazetteer_spans, redact_gazetteers
from scrub.plans import sqlgen as S
from scrub.plans import sqlpipe as SP
from scrub.plans.catalog import table
from scrub.plans.registry import query
from scrub.policy import DEFAULT_POLICY
from scrub.session import spread


def _gaz_sql(derived: str, key: str, terms: str, entity_type: str, score: float = 0.85) -> str:
    """Same n-gram match in SQL: words with offsets, runs of n words, equi-join on the normalised run."""
    w = S.lit(WORD_RE)
    return f"""
with d as ({derived}),
dict as (select distinct array_to_string(list_transform(regexp_extract_all(name, {w}, 0), lambda x: lower(x)), ' ') as gram
         from ({terms}) where name is not null),
dict2 as (select gram, len(string_split(gram, ' ')) as n from dict where length(gram) > 0),
ns as (select distinct n from dict2),
t as (select {key}, txt, regexp_extract_all(txt, {w}, 0) as w, string_split_regex(txt, {w}) as g from d),
pos as (select {key}, txt, w, g, unnest(range(1, len(w) + 1)) as i from t where len(w) > 0),
grams as (select {key}, txt, i, n,
    array_to_string(list_transform(w[i:i + n - 1], lambda x: lower(x)), ' ') as gram,
    cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
       + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) as integer) as s,
    cast(coalesce(list_sum(list_transform(g[1:i + n - 1], lambda x: length(x))), 0)
       + coalesce(list_sum(list_transform(w[1:i + n - 1], lambda x: length(x))), 0) as integer) as e
  from pos, ns where i + n - 1 <= len(w))
select {key}, '{entity_type}' as entity_type, s as start_pos, e as end_pos, gram as term,
       cast({score} as double) as score
from grams join dict2 using (gram)
"""


_PERSON_TEXT = ("select o_orderkey, concat('Order ', cast(o_orderkey as varchar), ' placed by ', c_name, ' (', c_mktsegment, ')') "
                "as txt from orders join customer on o_custkey = c_custkey")


@query("detect_person", _gaz_sql(_PERSON_TEXT, "o_orderkey", "select c_name as name from customer", R.PERSON))
def q_detect_person(spark, sf):
    o = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    c = table(spark, sf, "customer")
    txt = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" placed by "), F.col("c_name"),
                 F.lit(" ("), F.col("c_mktsegment"), F.lit(")")).alias("txt"))
    return gazetteer_spans(txt, "o_orderkey", "txt", c.select(F.col("c_name").alias("name")), "name", R.PERSON)


_LOCATION_TEXT = ("select c_custkey, concat(c_name, ' ships to ', n_name, ', ', r_name) as txt "
                  "from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")


@query("detect_location", _gaz_sql(_LOCATION_TEXT, "c_custkey", "select r_name as name from region", R.LOCATION))
def q_detect_location(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    txt = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey", F.concat(F.col("c_name"), F.lit(" ships to "), F.col("n_name"), F.lit(", "), F.col("r_name")).alias("txt"))
    return gazetteer_spans(txt, "c_custkey", "txt", r.select(F.col("r_name").alias("name")), "name", R.LOCATION)


_NRP_TEXT = ("select s_suppkey, concat(s_name, ' is a ', n_name, ' supplier') as txt "
             "from supplier join nation on s_nationkey = n_nationkey")


@query("detect_nrp", _gaz_sql(_NRP_TEXT, "s_suppkey", "select n_name as name from nation", R.NRP))
def q_detect_nrp(spark, sf):
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    txt = s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", F.concat(F.col("s_name"), F.lit(" is a "), F.col("n_name"), F.lit(" supplier")).alias("txt"))
    return gazetteer_spans(txt, "s_suppkey", "txt", n.select(F.col("n_name").alias("name")), "name", R.NRP)


def _redacted_sql(derived: str, key: str, name: str, entity_type: str) -> str:
    """The rules' redaction, then the one name each text holds (no rule touches it)."""
    return (f"with d as ({derived}) select {key}, replace({SP.cell_sql('txt', DEFAULT_POLICY)}, name, '[{entity_type}]') as redacted from d")


def _redacted(texts, key, names, entity_type):
    terms = names.select("name").distinct()
    out = redact_gazetteers(texts, "txt", [(terms, "name", entity_type, 0.85)])
    return out.select(key, F.col("r.redacted").alias("redacted"))


_MR_TEXT = ("select s_suppkey, 'Mr ' || n_name as name, concat(s_name, ' employs mr ', lower(n_name), ' and Mr ', n_name, '; call +1 555 010 ', "
            "cast(1000 + s_suppkey % 9000 as varchar)) as txt0 from supplier join nation on s_nationkey = n_nationkey")


@query("redact_person", f"with d as (select s_suppkey, name, replace(txt0, 'mr ' || lower(name[4:]), name) as txt from ({_MR_TEXT})) "
                        f"select s_suppkey, replace({SP.cell_sql('txt', DEFAULT_POLICY)}, name, '[{R.PERSON}]') as redacted from d")
def q_redact_person(spark, sf):
    """Names in either case, beside a masked number and a phone number of the rules."""
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    txt = s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", F.concat(F.lit("Mr "), "n_name").alias("name"),
        F.concat("s_name", F.lit(" employs mr "), F.lower("n_name"), F.lit(" and Mr "), "n_name", F.lit("; call +1 555 010 "),
                 (F.lit(1000) + F.col("s_suppkey") % 9000).cast("string")).alias("txt"))
    return _redacted(txt, "s_suppkey", n.select(F.concat(F.lit("Mr "), "n_name").alias("name")), R.PERSON)


@query("redact_location", _redacted_sql(
    "select c_custkey, r_name as name, concat(c_name, ' ships to ', n_name, ', ', r_name) as txt "
    "from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey", "c_custkey", "r_name", R.LOCATION))
def q_redact_location(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    txt = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey", F.concat(F.col("c_name"), F.lit(" ships to "), F.col("n_name"), F.lit(", "), F.col("r_name")).alias("txt"))
    return _redacted(txt, "c_custkey", r.select(F.col("r_name").alias("name")), R.LOCATION)


@query("redact_nrp", _redacted_sql(
    "select s_suppkey, n_name as name, concat(s_name, ' is a ', n_name, ' supplier') as txt "
    "from supplier join nation on s_nationkey = n_nationkey", "s_suppkey", "name", R.NRP))
def q_redact_nrp(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    txt = s.join(n, s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", F.concat("s_name", F.lit(" is a "), "n_name", F.lit(" supplier")).alias("txt"))
    return _redacted(txt, "s_suppkey", n.select(F.col("n_name").alias("name")), R.NRP)


_KEYLESS = ("select case when o_orderkey % 3 = 0 then null else o_orderkey % 5 end as k, c_name as name, "
            "concat('Order of ', c_name, ', ', c_mktsegment) as txt from orders join customer on o_custkey = c_custkey")


@query("redact_person_keyless", _redacted_sql(_KEYLESS, "k", "name", R.PERSON))
def q_redact_person_keyless(spark, sf):
    """Rows without any key: most share a number with thousands of others, a third have none."""
    o, c = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), table(spark, sf, "customer")
    txt = o.join(c, o.o_custkey == c.c_custkey).select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5).alias("k"),
        F.concat(F.lit("Order of "), "c_name", F.lit(", "), "c_mktsegment").alias("txt"))
    return _redacted(txt, "k", c.select(F.col("c_name").alias("name")), R.PERSON)


@query("redact_identity_long", _redacted_sql(
    "select p_partkey, p_name || ' of lot ' || p_partkey as name, concat('item ', p_name, ' of lot ', p_partkey, ' in stock') as txt from part", "p_partkey", "p_name", R.CONFIGURED_IDENTITY))
def q_redact_identity_long(spark, sf):
    """A list that grows with the data, far over what a regex of names could hold."""
    p = table(spark, sf, "part")
    name = F.concat("p_name", F.lit(" of lot "), F.col("p_partkey").cast("string"))
    txt = p.select("p_partkey", F.concat(F.lit("item "), name, F.lit(" in stock")).alias("txt"))
    return _redacted(txt, "p_partkey", p.select(name.alias("name")), R.CONFIGURED_IDENTITY)
