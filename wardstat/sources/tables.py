"""Reading the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# DataFrame handles per (application, path): a DataFrame is an immutable
# plan, so reusing it skips re-listing files and re-reading parquet footers
# on every query.  Scoped by application id, so a new SparkContext starts
# afresh.
_handles: dict[tuple[str, str], object] = {}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def _app_id(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan; column pruning and filter pushdown reach it from
    whatever plan is built on top."""
    key = (_app_id(spark), table_path(sf_dir, name))
    if key not in _handles:
        _handles[key] = spark.read.parquet(key[1])
    return _handles[key]


def remember(spark: SparkSession, key: str, build):
    """Application-scoped memo for derived inputs (a DataFrame handle or
    the path of a table written under the checkpoint folder); ``build()``
    runs once per application."""
    k = (_app_id(spark), key)
    if k not in _handles:
        _handles[k] = build()
    return _handles[k]


def forget(spark: SparkSession, key: str) -> None:
    _handles.pop((_app_id(spark), key), None)
