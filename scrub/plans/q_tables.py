"""Registered queries: whole-table redaction of the statement view."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrub.functions import rules as R
from scrub.operators.audit import count_by
from scrub.operators.redact import redact
from scrub.operators.tables import (RESULT_PREFIX, cell_findings, cell_results, changed_per_column, preview_cells,
                                    redact_table)
from scrub.plans import sqlgen as S
from scrub.plans import sqlpipe as SP
from scrub.plans.catalog import stmt
from scrub.plans.registry import query
from scrub.policy import DEFAULT_POLICY, CustomPattern, EntityConfig, Policy

W = S.stmt_cte()
KEY = "o_orderkey"
COLS = S.STMT_TEXT_COLUMNS
SENSITIVE = Policy(sensitive_columns=("ssn",))


def _table_sql(policy: Policy, source: str = "stmt") -> str:
    cells = ", ".join(f"{SP.cell_sql(c, policy)} as {c}" for c in COLS)
    return f"select {KEY}, {cells} from {source}"


@query("redact_table", f"with {W} {_table_sql(DEFAULT_POLICY)}")
def q_redact_table(spark, sf):
    return redact_table(stmt(spark, sf), DEFAULT_POLICY, keep=[KEY])


@query("redact_column", f"with {W} select {KEY}, {SP.cell_sql('ssn', SENSITIVE)} as ssn, "
                        f"{SP.cell_sql('name', SENSITIVE)} as name from stmt")
def q_redact_column(spark, sf):
    return redact_table(stmt(spark, sf), SENSITIVE, keep=[KEY]).select(KEY, "ssn", "name")


@query("redact_nulls", f"with {W}, r as ({_table_sql(SENSITIVE)}) " + " union all ".join(
    f"select '{c}' as column_name, (select count(*) from stmt where {c} is null) as nulls_before, "
    f"(select count(*) from r where {c} is null) as nulls_after" for c in COLS))
def q_redact_nulls(spark, sf):
    s = stmt(spark, sf)
    red = redact_table(s, SENSITIVE, keep=[KEY])
    both = s.select(*[F.struct(F.col(c).isNull().alias("b"), F.lit(False).alias("a")).alias(c) for c in COLS]) \
        .unionByName(red.select(*[F.struct(F.lit(False).alias("b"), F.col(c).isNull().alias("a")).alias(c) for c in COLS]))
    agg = both.agg(*[F.struct(F.count_if(F.col(f"{c}.b")).alias("b"), F.count_if(F.col(f"{c}.a")).alias("a")).alias(c)
                     for c in COLS])
    stack = ", ".join(f"'{c}', `{c}`.b, `{c}`.a" for c in COLS)
    return agg.selectExpr(f"stack({len(COLS)}, {stack}) as (column_name, nulls_before, nulls_after)")


_VALUES = "(" + " + ".join(f"count({c})" for c in COLS) + ")::bigint"


@query("shape_preserved", f"""with {W}, r as ({_table_sql(DEFAULT_POLICY)})
select 'input' as side, count(*) as n_rows, {_VALUES} as n_values, '{",".join((KEY,) + COLS)}' as columns from stmt
union all select 'output', count(*), {_VALUES}, '{",".join((KEY,) + COLS)}' from r""")
def q_shape_preserved(spark, sf):
    s = stmt(spark, sf)
    red = redact_table(s, DEFAULT_POLICY, keep=[KEY])
    # Counting values needs every redacted cell; counting rows alone would let the redaction be pruned away.
    values = sum((F.count(c) for c in COLS), F.lit(0).cast("long"))
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias("n_rows"), values.alias("n_values")).select(
        F.lit(name).alias("side"), "n_rows", "n_values", F.lit(",".join(df.columns)).alias("columns"))
    return side(s, "input").unionByName(side(red, "output"))


@query("changed_cells", f"with {W} select {KEY}, cast(" + " + ".join(
    f"cast(({c} is distinct from {SP.cell_sql(c, DEFAULT_POLICY)}) as integer)" for c in COLS) + " as integer) as n_changed from stmt")
def q_changed_cells(spark, sf):
    res = cell_results(stmt(spark, sf), DEFAULT_POLICY, keep=[KEY])
    n = sum(F.col(RESULT_PREFIX + c + ".changed").cast("int") for c in COLS)
    return res.select(KEY, n.cast("int").alias("n_changed"))


@query("audit_cells_changed", f"with {W} " + " union all ".join(
    f"select '{c}' as column_name, cast(count_if({c} is distinct from {SP.cell_sql(c, SENSITIVE)}) as bigint) as cells_changed from stmt"
    for c in COLS))
def q_audit_cells_changed(spark, sf):
    return changed_per_column(stmt(spark, sf), SENSITIVE, keep=[KEY])


def _head_sql(policy):
    redacted = ", ".join(f"{SP.cell_sql(c, policy)} as r_{c}" for c in COLS)
    return (f"with {W}, h as (select * from stmt order by {KEY} limit 20), "
            f"r as (select *, {redacted} from h) " + " union all ".join(
                f"select '{c}' as column_name, {KEY}, {c} as before, r_{c} as after from r "
                f"where {c} is distinct from r_{c}" for c in COLS))


@query("preview_cells", _head_sql(SENSITIVE))
def q_preview_cells(spark, sf):
    return preview_cells(stmt(spark, sf), KEY, SENSITIVE, n=20)


@query("preview_rows", f"with {W}, h as (select * from stmt order by {KEY} limit 20) {_table_sql(DEFAULT_POLICY, 'h')}")
def q_preview_rows(spark, sf):
    return redact_table(stmt(spark, sf).orderBy(KEY).limit(20), DEFAULT_POLICY, keep=[KEY])


NO_DATES = Policy(entity_types={R.DATE_TIME: EntityConfig(enabled=False)})


@query("disabled_types", f"with {W} select {KEY}, {SP.cell_sql('date', NO_DATES)} as date, "
                         f"{SP.cell_sql('description', NO_DATES)} as description from stmt")
def q_disabled_types(spark, sf):
    return redact_table(stmt(spark, sf).select(KEY, "date", "description"), NO_DATES, keep=[KEY])


ANGLE = Policy(entity_types={R.EMAIL_ADDRESS: EntityConfig(replacement="<{entity_type}>")})


@query("replacement_template", f"with {W} select {KEY}, {SP.cell_sql('email', ANGLE)} as email from stmt")
def q_replacement_template(spark, sf):
    return redact_table(stmt(spark, sf).select(KEY, "email"), ANGLE, keep=[KEY])


_PRIORITY = r"\b[1-5]-(?:URGENT|HIGH|MEDIUM|NOT SPECIFIED|LOW)\b"
CUSTOM_POLICIES = {
    "custom_replace": Policy(custom_patterns=(CustomPattern("priority", _PRIORITY, "replace", "[PRIORITY $1 \\0]"),)),
    "custom_redact": Policy(custom_patterns=(CustomPattern("priority", _PRIORITY, "redact"),)),
    "custom_detect_only": Policy(custom_patterns=(CustomPattern("priority", _PRIORITY, "detect"),)),
}


def _custom_query(name, policy):
    ctes, pipe = SP.pipeline_ctes("stmt", KEY, "description", policy)

    @query(name, f"with {W}, {ctes} select {KEY}, tf as redacted, n_entities from {pipe}")
    def q(spark, sf):
        r = redact(F.col("description"), policy)
        return stmt(spark, sf).select(KEY, r["redacted"].alias("redacted"), F.size(r["entities"]).cast("int").alias("n_entities"))

    return q


for _n, _p in CUSTOM_POLICIES.items():
    _custom_query(_n, _p)


_CF_CTES, _CF_BODY = SP.cell_findings_sql(SENSITIVE)


@query("dry_run_counts", f"with {_CF_CTES} select entity_type, count(*) as n from ({_CF_BODY}) group by entity_type")
def q_dry_run_counts(spark, sf):
    return count_by(cell_findings(stmt(spark, sf), SENSITIVE, keep=[KEY]), "entity_type")


# P2, long form: one pipeline over the unpivoted cells (the shape for very wide tables).
@query("redact_long", f"""with {W}, {SP.STMT_LONG}
select {KEY}, column_name, value,
       case when column_name = 'ssn' then '[REDACTED]' else {SP.redact_expr('value', SENSITIVE)} end as redacted
from stmt_long""")
def q_redact_long(spark, sf):
    from scrub.operators.tables import wide_redact

    return wide_redact(stmt(spark, sf), KEY, SENSITIVE).where(F.col("value").isNotNull())
