"""Whole-table redaction: every cell through the pipeline, shape unchanged.

One pipeline tree applied to an array of the string cells, then one ``select``
that puts every column back in place: row count, column set and column order
are kept, nulls stay null, the plan does not grow with the column count, and it
all runs in the scan's stage (no shuffle).  Columns named in
``policy.sensitive_columns`` are replaced wholesale by ``[REDACTED]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrub.functions.arrays import explode_kept
from scrub.functions.text import memo_column
from scrub.names import col
from scrub.operators.redact import redact_text, redact_types
from scrub.policy import DEFAULT_POLICY, FULL_COLUMN_REDACTION, REDACTED, Policy

RESULT_PREFIX = "__r_"


def redact_column(c: Column) -> Column:
    """Whole-cell redaction: any non-null value becomes ``[REDACTED]``."""
    return F.when(c.isNotNull(), F.lit(REDACTED))


def _targets(df: DataFrame, keep) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in set(keep)]


@memo_column
def _pipeline_over(names: tuple, policy: Policy, text_only: bool = False) -> Column:
    """One pipeline tree applied to an array of cells: plan size stays flat in the column count.

    ``text_only`` yields the redacted strings alone; else findings come as their types.
    """
    fn = redact_text if text_only else redact_types
    return F.transform(F.array(*[col(n) for n in names]), lambda v: fn(v, policy))


def cell_results(df: DataFrame, policy: Policy = DEFAULT_POLICY, keep=()) -> DataFrame:
    """Add ``__r_<col>`` = ``struct<redacted, entities, changed>`` for every redactable column.

    ``entities`` holds only the entity type here (that is all the audit needs).
    """
    sens = set(policy.sensitive_columns)
    targets = _targets(df, keep)
    plain = [n for n in targets if n not in sens]
    base = [col(n) for n in df.columns]
    staged = df.select(*base, _pipeline_over(tuple(plain), policy).alias("__cells")) if plain else df
    extra = []
    for name in targets:
        c = col(name)
        if name in sens:
            r = F.struct(
                redact_column(c).alias("redacted"),
                F.when(c.isNotNull(), F.array(F.struct(F.lit(FULL_COLUMN_REDACTION).alias("entity_type"))))
                .otherwise(F.array().cast("array<struct<entity_type:string>>")).alias("entities"),
                c.isNotNull().alias("changed"),
            )
        else:
            full = F.col("__cells")[plain.index(name)]
            r = F.struct(
                full["redacted"].alias("redacted"),
                full["entities"].alias("entities"),
                full["changed"].alias("changed"),
            )
        extra.append(r.alias(RESULT_PREFIX + name))
    return staged.select(*base, *extra)


def redact_table(df: DataFrame, policy: Policy = DEFAULT_POLICY, keep=()) -> DataFrame:
    """Same columns, same order, same rows; string cells redacted (``keep`` columns untouched)."""
    sens = set(policy.sensitive_columns)
    targets = _targets(df, keep)
    plain = [n for n in targets if n not in sens]
    staged = df.select("*", _pipeline_over(tuple(plain), policy, True).alias("__cells")) if plain else df
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name not in targets:
            out.append(c)
        elif f.name in sens:
            out.append(redact_column(c).alias(f.name))
        else:
            out.append(F.col("__cells")[plain.index(f.name)].alias(f.name))
    return staged.select(*out)


def cell_findings(df: DataFrame, policy: Policy = DEFAULT_POLICY, keep=(), carry=()) -> DataFrame:
    """Long audit form: one row per finding in a *changed* cell (``carry`` columns kept).

    A finding is counted only when its cell changed; a sensitive column counts
    one ``FULL_COLUMN_REDACTION`` per non-null cell.
    """
    targets = _targets(df, list(keep) + list(carry))
    res = cell_results(df.select(*map(col, [*carry, *targets])), policy, keep=carry)
    # All findings of a row in one array, so one generator makes the rows.
    of_cell = [F.when(col(RESULT_PREFIX + n)["changed"], F.transform(
        col(RESULT_PREFIX + n)["entities"], _named(n))).otherwise(F.array().cast("array<struct<column_name:string,entity_type:string>>"))
        for n in targets]
    found = explode_kept(res, carry, F.flatten(F.array(*of_cell)), "e")
    return found.select(*map(col, carry), F.col("e.column_name").alias("column_name"), F.col("e.entity_type").alias("entity_type"))


def _named(name: str):
    return lambda e: F.struct(F.lit(name).alias("column_name"), e["entity_type"].alias("entity_type"))


def changed_per_column(df: DataFrame, policy: Policy = DEFAULT_POLICY, keep=()) -> DataFrame:
    """``(column_name, cells_changed)`` with one partial+final aggregate over the table."""
    targets = _targets(df, keep)
    res = cell_results(df.select(*map(col, targets)), policy)
    # Aliases by place: a header can be any text.
    sums = res.agg(*[F.sum(col(RESULT_PREFIX + n)["changed"].cast("long")).alias(f"n{i}") for i, n in enumerate(targets)])
    each = F.array(*[F.struct(F.lit(n).alias("column_name"), F.coalesce(F.col(f"n{i}"), F.lit(0).cast("long")).alias("cells_changed"))
                     for i, n in enumerate(targets)])
    return sums.select(F.explode(each).alias("c")).select("c.column_name", "c.cells_changed")


def preview_cells(df: DataFrame, key: str, policy: Policy = DEFAULT_POLICY, n: int = 20) -> DataFrame:
    """Cell diff of the first ``n`` rows by ``key``: ``(column_name, key, before, after)``, changed cells only.

    Sensitive columns are included, so the preview equals what applying writes.
    """
    head = df.orderBy(col(key)).limit(n)
    targets = _targets(df, [key])
    res = cell_results(head.select(col(key), *map(col, targets)), policy, keep=[key])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), col(c).alias("before"), col(RESULT_PREFIX + c).alias("r"))
        for c in targets
    ])
    return (
        explode_kept(res, [key], cells, "x")
        .where(F.col("x.r.changed"))
        .select(F.col("x.column_name").alias("column_name"), col(key), F.col("x.before").alias("before"),
                F.col("x.r.redacted").alias("after"))
    )


def wide_redact(df: DataFrame, key: str, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Long form for very wide tables: ``(key, column_name, value, redacted)`` from one unpivot.

    One expression instead of one per column; pivot back only if the caller
    needs the wide shape (that costs a shuffle on ``key``).
    """
    targets = _targets(df, [key])
    long = df.select(col(key), *map(col, targets)).unpivot([col(key)], [col(t) for t in targets], "column_name", "value")
    sens = set(policy.sensitive_columns)
    r = F.when(F.col("column_name").isin(list(sens)) if sens else F.lit(False), redact_column(F.col("value"))) \
        .otherwise(redact_text(F.col("value"), policy))
    return long.select(col(key), "column_name", "value", r.alias("redacted"))
