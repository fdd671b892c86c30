"""Audit aggregations over findings: counts, per-file results and the run report.

Findings are kept in long form ``(source, ..., entity_type)``; every count is a
``groupBy().agg()`` that Spark runs as partial (map-side) plus final hash
aggregation, so a hot source or type costs one pre-aggregated row per task,
never a skewed shuffle of raw findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrub.functions.arrays import explode_kept

FILE_RESULT_TYPE = T.StructType([
    T.StructField("input_path", T.StringType()),
    T.StructField("output_paths", T.ArrayType(T.StringType())),
    T.StructField("file_type", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("rows_or_pages", T.LongType()),
    T.StructField("fields_changed", T.LongType()),
    T.StructField("entities_by_type", T.MapType(T.StringType(), T.LongType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("input_hash", T.StringType()),
    T.StructField("output_hash", T.StringType()),
])
SUMMARY_TYPE = T.StructType([
    T.StructField("total_files", T.LongType()),
    T.StructField("successful_files", T.LongType()),
    T.StructField("failed_files", T.LongType()),
    T.StructField("aggregate_entities", T.MapType(T.StringType(), T.LongType())),
    T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("dry_run", T.BooleanType()),
])


def explode_entities(df: DataFrame, keys, entities: str = "entities") -> DataFrame:
    """One row per finding: keys plus the span fields."""
    keys = list(keys)
    return explode_kept(df, keys, F.col(entities), "e").select(
        *keys,
        F.col("e.stage").alias("stage"),
        F.col("e.entity_type").alias("entity_type"),
        F.col("e.start").alias("start_pos"),
        F.col("e.end").alias("end_pos"),
        F.col("e.masked").alias("masked"),
        F.col("e.score").alias("score"),
    )


def count_by(findings: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def totals(counts: DataFrame, key: str = "entity_type", value: str = "n") -> DataFrame:
    """Merge per-source counts into run counts."""
    return counts.groupBy(key).agg(F.sum(value).cast("long").alias(value))


def ranked(totals_df: DataFrame, key: str = "entity_type", value: str = "n") -> DataFrame:
    """Totals ranked by count (ties by name).  Input is one row per type: tiny by construction."""
    w = Window.orderBy(F.desc(value), F.asc(key))
    return totals_df.select(key, value, F.row_number().over(w).cast("int").alias("rank"))


def map_total(m: Column) -> Column:
    """Sum of a ``map<string,long>`` of counts."""
    return F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda acc, x: acc + x)


def file_results(rows: DataFrame, source: str, counts: DataFrame | None, file_type: Column | str = "csv",
                 failed: Column | None = None, changed: Column | None = None) -> DataFrame:
    """One result row per source: rows processed, fields changed, counts map, success flag.

    ``rows`` holds the processed units (rows or pages) with ``source``;
    ``failed`` marks units that failed (the file then fails, the run goes on).
    """
    ft = F.lit(file_type) if isinstance(file_type, str) else file_type
    per = rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("rows_or_pages"),
        (F.sum(changed.cast("long")) if changed is not None else F.lit(0).cast("long")).alias("fields_changed"),
        (F.max(failed.cast("int")) if failed is not None else F.lit(0)).alias("_failed"),
        F.min(ft).alias("file_type"),
    )
    if counts is not None:
        maps = counts.groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct("entity_type", "n"))).alias("entities_by_type"))
        per = per.join(maps, source, "left")
    else:
        per = per.withColumn("entities_by_type", F.create_map().cast("map<string,bigint>"))
    return per.select(
        F.col(source).alias("input_path"),
        "file_type",
        (F.col("_failed") == 0).alias("success"),
        F.col("rows_or_pages").cast("long").alias("rows_or_pages"),
        F.coalesce(F.col("fields_changed"), F.lit(0)).cast("long").alias("fields_changed"),
        F.coalesce(F.col("entities_by_type"), F.create_map().cast("map<string,bigint>")).alias("entities_by_type"),
    )


def tallies(rows: DataFrame, source: str, types: Column, changed: Column, failed: Column) -> DataFrame:
    """``(source, key, n)``: units, changes, failed units and findings by type, from one array a row.

    One partial and final aggregate counts everything, so what ``types`` costs
    (the redaction) is paid once.
    """
    def pair(k, n):
        return F.struct(k.alias("key"), n.cast("long").alias("n"))

    fixed = F.array(pair(F.lit("#units"), F.lit(1)), pair(F.lit("#changed"), changed), pair(F.lit("#failed"), failed.cast("int")))
    each = F.concat(fixed, F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: pair(t, F.lit(1))))
    return explode_kept(rows, [source], each, "e").groupBy(source, F.col("e.key").alias("key")).agg(F.sum("e.n").alias("n"))


def tally_maps(counted: DataFrame, source: str) -> DataFrame:
    """One row per source: its tallies as a map ``m``.  A map has one entry per entity type at most."""
    return counted.groupBy(source).agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("m"))


def types_in(m: Column) -> Column:
    """The findings by type in a map of tallies."""
    return F.map_filter(m, lambda k, n: ~k.startswith("#"))


def unit_results(rows: DataFrame, source: str, types: Column, file_type: str, failed: Column, changed: Column) -> DataFrame:
    """``file_results`` from one pass over the units: ``types`` holds a unit's entity types."""
    maps = tally_maps(tallies(rows, source, types, changed, failed), source)
    return maps.select(
        F.col(source).alias("input_path"), F.lit(file_type).alias("file_type"), (F.col("m")["#failed"] == 0).alias("success"),
        F.col("m")["#units"].alias("rows_or_pages"), F.col("m")["#changed"].alias("fields_changed"), types_in(F.col("m")).alias("entities_by_type"),
    )


def run_summary(files: DataFrame) -> DataFrame:
    """One row: files total / succeeded / failed, units, fields changed, findings."""
    return files.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("success")).alias("successful_files"),
        F.count_if(~F.col("success")).alias("failed_files"),
        F.sum("rows_or_pages").cast("long").alias("rows_or_pages"),
        F.sum("fields_changed").cast("long").alias("fields_changed"),
        F.sum(map_total(F.col("entities_by_type"))).cast("long").alias("total_entities"),
    )
