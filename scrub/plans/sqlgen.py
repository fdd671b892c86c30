"""DuckDB SQL text for the oracle side of every registered query.

These helpers write the *same computation* a second way, in plain SQL over
the same parquet tables, so the driver can compare results.  They generate SQL
text only; nothing here runs on Spark.
"""

from __future__ import annotations

from scrub.functions import patterns as P
from scrub.functions import rules as R

STMT_SQL = """
select o_orderkey,
  cast(cast(o_orderdate as date) as {S}) as date,
  concat('Order ', o_orderpriority, ' for customer ', cast(o_custkey as {S}),
         ' card 4111-1111-1111-', lpad(cast(o_orderkey % 10000 as {S}),4,'0')) as description,
  cast(cast(o_totalprice as decimal(15,2)) as {S}) as amount,
  lpad(cast(o_custkey as {S}),10,'0') as account_number,
  case when o_orderkey % 3 = 0 then null
       else concat('411111111111', lpad(cast(o_orderkey % 10000 as {S}),4,'0')) end as card_number,
  concat('user', cast(o_custkey as {S}), '@example.com') as email,
  concat(lpad(cast(o_custkey % 900 + 100 as {S}),3,'0'), '-', lpad(cast(o_orderkey % 90 + 10 as {S}),2,'0'), '-',
         lpad(cast(o_orderkey % 9000 + 1000 as {S}),4,'0')) as ssn,
  concat('Customer#', lpad(cast(o_custkey as {S}),9,'0')) as name
from orders
"""
STMT_COLUMNS = ("o_orderkey", "date", "description", "amount", "account_number", "card_number", "email", "ssn", "name")
STMT_TEXT_COLUMNS = STMT_COLUMNS[1:]


def stmt_cte() -> str:
    return "stmt as (" + STMT_SQL.format(S="varchar") + ")"


def re2(pattern: str) -> str:
    """A Spark-side pattern as RE2 takes it: Java-only flags removed (RE2's classes stay ASCII/Unicode as they are)."""
    return pattern.replace("(?iu)", "(?i)").replace("(?U)", "")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mask_last4(m: str, ch: str = "X") -> str:
    """Mask all digits but the last four of a hit that ends in four digits."""
    return f"(regexp_replace(left({m}, length({m}) - 4), '[0-9]', {lit(ch)}, 'g') || right({m}, 4))"


def rebuild(t: str, pattern: str, hit) -> str:
    """Rewrite every hit of ``pattern`` in ``t`` with ``hit(var)``."""
    p = lit(pattern)
    return (
        f"(case when {t} is null then null else array_to_string(list_transform(list_zip(string_split_regex({t}, {p}), "
        f"list_transform(regexp_extract_all({t}, {p}, 0), lambda m: {hit('m')})), "
        f"lambda z: z[1] || coalesce(z[2], '')), '') end)"
    )


def replace_all(t: str, pattern: str, literal: str) -> str:
    return rebuild(t, pattern, lambda m: lit(literal))


def card_mask(t: str) -> str:
    return rebuild(t, P.CARD_RE, lambda m: mask_last4(m))


def account_mask(t: str) -> str:
    return rebuild(t, P.ACCOUNT_RE, lambda m: f"case when length({m}) = 9 then {m} else {mask_last4(m)} end")


def routing_mask(t: str) -> str:
    return rebuild(t, P.ROUTING_RE, lambda m: mask_last4(m))


def financial(t: str) -> str:
    return account_mask(card_mask(t))


def n_hits(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {lit(pattern)}, 0))"


def n_card_masked(t: str) -> str:
    return n_hits(t, P.CARD_RE)


def n_account_masked(t1: str) -> str:
    p = lit(P.ACCOUNT_RE)
    return f"len(list_filter(regexp_extract_all({t1}, {p}, 0), lambda m: length(m) <> 9))"


# Scored stage as chained replacements, in the greedy priority order (score,
# then type name).  Valid where rules never overlap; tests check that on data.
DEFAULT_SCORED = (
    (R.EMAIL_ADDRESS, R.EMAIL_RE),
    (R.US_SSN, R.SSN_RE),
    (R.DATE_TIME, R.DATE_RE),
    (R.IP_ADDRESS, R.IP_RE),
    (R.PHONE_NUMBER, R.PHONE_RE),
    (R.URL, R.URL_RE),
)


def scored_chain(t: str, rules=DEFAULT_SCORED, templates: dict | None = None) -> str:
    templates = templates or {}
    for et, pat in rules:
        t = f"regexp_replace({t}, {lit(pat)}, {lit(templates.get(et, '[' + et + ']'))}, 'g')"
    return t


def hit_rows(table_sql: str, key_cols: str, text: str, pattern: str) -> str:
    """Rows ``(key..., i, hit, start_pos, end_pos)`` for every hit, 1-based ``i``."""
    p = lit(pattern)
    return f"""
    (select {key_cols}, i, h[i] as hit,
        cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
           + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) as integer) as start_pos
     from (select {key_cols}, g, h, unnest(range(1, len(h) + 1)) as i
           from (select {key_cols}, string_split_regex({text}, {p}) as g, regexp_extract_all({text}, {p}, 0) as h
                 from {table_sql}) where len(h) > 0))
    """


def luhn_ok(m: str) -> str:
    d = f"string_split(reverse(regexp_replace({m}, '[^0-9]', '', 'g')), '')"
    return (
        f"(list_sum(list_transform({d}, lambda c, i: case when i % 2 = 0 then "
        f"(case when cast(c as integer) * 2 > 9 then cast(c as integer) * 2 - 9 else cast(c as integer) * 2 end) "
        f"else cast(c as integer) end)) % 10 = 0)"
    )


def mask_value(v: str, n: int = 4, ch: str = "X", guard: bool = False) -> str:
    """Stand-alone value masking (card when ``guard``, else account), any ``n``."""
    digits = f"regexp_replace({v}, '[^0-9]', '', 'g')"

    def keep_last(x):
        chars = f"string_split({x}, '')"
        return (
            f"array_to_string(list_transform({chars}, lambda c, i: case when regexp_matches(c, '^[0-9]$') and "
            f"len(regexp_extract_all(array_to_string({chars}[i+1:], ''), '[0-9]', 0)) >= {n} then {lit(ch)} else c end), '')"
        )

    g = f"when regexp_matches({v}, {lit(P.ALREADY_MASKED_RE)}) then {v} " if guard else ""
    return (
        f"(case when {v} is null then null {g}when length({digits}) <= {n} then {v} "
        f"when regexp_matches({v}, {lit(P.SEPARATOR_RE)}) then {keep_last(v)} else {keep_last(digits)} end)"
    )
