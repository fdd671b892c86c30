"""The redaction pipeline written as DuckDB SQL, driven by the same ``Policy``.

Stage 2 is written as chained replacements in greedy priority order; it equals
the span form wherever rules do not overlap (tests assert that on the data).
Only the default financial rules (keep four digits, mask ``X``) are supported
on the SQL side.
"""

from __future__ import annotations

from scrub.functions import patterns as P
from scrub.functions import rules as R
from scrub.plans import sqlgen as S
from scrub.policy import Policy


def _check(policy: Policy):
    f = policy.financial
    for rule in (f.card_number, f.account_number):
        if rule.preserve_last_n != 4 or rule.mask_char != "X":
            raise ValueError("SQL oracle supports only the default financial rules")


def ordered_rules(policy: Policy) -> list[R.Rule]:
    return sorted(R.active_rules(policy), key=lambda r: (-(r.score if r.score is not None else r.max_score), r.entity_type))


def _luhn_keep(policy: Policy, rule: R.Rule, m: str) -> str:
    """SQL condition: a card hit passes its threshold."""
    t = policy.threshold(rule.entity_type)
    if t <= 0.3:
        return "true"
    return S.luhn_ok(m) if t <= 1.0 else "false"


def scored_sql(t: str, policy: Policy) -> str:
    for r in ordered_rules(policy):
        rep = S.lit(policy.replacement(r.entity_type))
        if r.score is None:
            t = S.rebuild(t, r.pattern, lambda m, r=r, rep=rep: f"case when {_luhn_keep(policy, r, m)} then {rep} else {m} end")
        else:
            t = f"regexp_replace({t}, {S.lit(r.pattern)}, {rep}, 'g')"
    return t


def n_scored_sql(t: str, policy: Policy) -> str:
    parts = []
    for r in ordered_rules(policy):
        if r.score is None:
            parts.append(f"len(list_filter(regexp_extract_all({t}, {S.lit(r.pattern)}, 0), lambda m: {_luhn_keep(policy, r, 'm')}))")
        else:
            parts.append(S.n_hits(t, r.pattern))
    return " + ".join(parts) if parts else "0"


def custom_sql(t: str, p) -> str:
    out = p.output()
    return t if out is None else S.replace_all(t, p.regex, out)


def pipeline_ctes(source: str, keys: str, text: str, policy: Policy, name: str = "p") -> tuple[str, str]:
    """CTEs computing ``t0`` (input) .. ``tf`` (redacted) and ``n_entities``; returns (ctes, last cte name)."""
    _check(policy)
    ctes = [
        f"{name}_a as (select {keys}, {text} as t0, {S.card_mask(text)} as t1 from {source})",
        f"{name}_b as (select *, {S.account_mask('t1')} as t2 from {name}_a)",
        f"{name}_c as (select *, {scored_sql('t2', policy)} as t3 from {name}_b)",
    ]
    prev, cur = f"{name}_c", "t3"
    counts = [S.n_card_masked("t0"), S.n_account_masked("t1"), n_scored_sql("t2", policy)]
    for i, p in enumerate(policy.custom_patterns):
        nxt = f"u{i}"
        ctes.append(f"{name}_u{i} as (select *, {custom_sql(cur, p)} as {nxt} from {prev})")
        counts.append(S.n_hits(cur, p.regex))
        prev, cur = f"{name}_u{i}", nxt
    ctes.append(
        f"{name} as (select *, {cur} as tf, cast({' + '.join(counts)} as integer) as n_entities, "
        f"(t0 is distinct from {cur}) as changed from {prev})"
    )
    return ",\n".join(ctes), name


def entity_rows_sql(pipe: str, keys: str, policy: Policy) -> str:
    """Union of every finding of the pipeline CTE ``pipe``: keys, stage, type, offsets, masked, score."""
    parts = [
        f"select {keys}, 'financial' as stage, 'CARD_NUMBER' as entity_type, start_pos, "
        f"cast(start_pos + length(hit) as integer) as end_pos, {S.mask_last4('hit')} as masked, cast(null as double) as score "
        f"from {S.hit_rows(pipe, keys, 't0', P.CARD_RE)}",
        f"select {keys}, 'financial', 'ACCOUNT_NUMBER', start_pos, cast(start_pos + length(hit) as integer), "
        f"{S.mask_last4('hit')}, cast(null as double) from {S.hit_rows(pipe, keys, 't1', P.ACCOUNT_RE)} where length(hit) <> 9",
    ]
    for r in ordered_rules(policy):
        rep = S.lit(policy.replacement(r.entity_type))
        if r.score is None:
            score = f"(case when {S.luhn_ok('hit')} then 1.0 else 0.3 end)"
            cond = f" where {_luhn_keep(policy, r, 'hit')}"
        else:
            score, cond = str(r.score), ""
        parts.append(
            f"select {keys}, 'scored', '{r.entity_type}', start_pos, cast(start_pos + length(hit) as integer), {rep}, "
            f"cast({score} as double) from {S.hit_rows(pipe, keys, 't2', r.pattern)}{cond}"
        )
    cur = "t3"
    for i, p in enumerate(policy.custom_patterns):
        out = p.output()
        masked = S.lit(out) if out is not None else "hit"
        parts.append(
            f"select {keys}, 'custom', '{p.entity_type}', start_pos, cast(start_pos + length(hit) as integer), {masked}, "
            f"cast(null as double) from {S.hit_rows(pipe, keys, cur, p.regex)}"
        )
        cur = f"u{i}"
    return "\nunion all\n".join(parts)


def redact_expr(c: str, policy: Policy) -> str:
    """The whole pipeline as one nested scalar expression (for short cells)."""
    _check(policy)
    t = scored_sql(S.account_mask(S.card_mask(c)), policy)
    for p in policy.custom_patterns:
        t = custom_sql(t, p)
    return t


def cell_sql(c: str, policy: Policy) -> str:
    """A cell as written by table redaction: sensitive columns become ``[REDACTED]``."""
    if c in policy.sensitive_columns:
        return f"(case when {c} is not null then '[REDACTED]' end)"
    return redact_expr(c, policy)


STMT_LONG = (
    "stmt_long as (select o_orderkey, column_name, value from "
    "(unpivot (select * from stmt) on COLUMNS(* exclude o_orderkey) into name column_name value value))"
)


def cell_findings_sql(policy: Policy, carry: str = "o_orderkey, column_name") -> str:
    """CTEs + select of ``(carry, entity_type)`` per finding in a changed cell of ``stmt``."""
    ctes, pipe = pipeline_ctes("stmt_long", carry, "value", policy, name="cells")
    sens = ", ".join(S.lit(c) for c in policy.sensitive_columns) or "NULL"
    rows = entity_rows_sql(pipe, carry + ", changed", policy)
    body = (
        f"select {carry}, entity_type from ({rows}) where changed and column_name not in ({sens})\n"
        f"union all select {carry}, 'FULL_COLUMN_REDACTION' from stmt_long where column_name in ({sens})"
    )
    return f"{S.stmt_cte()}, {STMT_LONG}, {ctes}", body
