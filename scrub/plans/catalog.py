"""Table access for the registered queries: parquet tables and derived views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from scrub.plans.sqlgen import STMT_SQL
from scrub.session import ensure_checkpoint_dir, read_table, spread

# Tables whose rows carry long free text: redaction is CPU-bound per row, so an
# under-split scan is spread over the available cores (no-op at scale).
# Text tables and their unique row keys.
TEXT_TABLES = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn"),
               "benchmark": ("item_id",)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = read_table(spark, sf_dir, name)
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def stmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement-shaped, all-string view over ``orders`` (one row per order)."""
    view = f"orders_{uuid.uuid4().hex[:8]}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spread(spark.sql(STMT_SQL.format(S="string").replace("from orders", f"from {view}")), "o_orderkey")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never machine-local on a cluster)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/scrub-{name}-{uuid.uuid4().hex[:12]}"
