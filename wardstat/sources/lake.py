"""The partitioned admissions lake: ``part_year=/part_region=`` folders.

Partition folders are named after the table's partition columns, so
partition discovery and ``MSCK REPAIR TABLE`` agree on the layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ADMISSIONS, DATABASE, DIMENSION_TABLE, FACT_TABLE, LAKE_PARTITIONS

LAKE_SCHEMA = T.StructType(ADMISSIONS.fields + [T.StructField(c, T.StringType()) for c in LAKE_PARTITIONS])


def with_partition_columns(df: DataFrame) -> DataFrame:
    return (df.withColumn("part_year", F.col("year").cast("string"))
            .withColumn("part_region", F.col("region")))


def rebalance_for_write(df: DataFrame, part_cols: list[str]) -> DataFrame:
    """Hash rows to tasks by the partition columns with a REBALANCE hint.

    AQE then sizes the write tasks from the real shuffle sizes: a folder
    holding a third of the data is split over many tasks (skewed
    partitions are cut at map-output boundaries, so a re-run task sees the
    same rows), small folders are packed together, and every task writes
    few, large files instead of one small file per folder.
    """
    return df.hint("rebalance", *part_cols)


#: Folders that a write task keeps open at once; rows of further ones are sorted.
OPEN_FOLDERS = 64
OPEN_FOLDERS_SETTING = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def open_folders(spark: SparkSession, folders: int = OPEN_FOLDERS) -> Iterator[None]:
    """Writes inside keep up to ``folders`` files of a task open and so need
    no sort of its rows by folder, which may spill."""
    before = spark.conf.get(OPEN_FOLDERS_SETTING)
    spark.conf.set(OPEN_FOLDERS_SETTING, str(folders))
    try:
        yield
    finally:
        spark.conf.set(OPEN_FOLDERS_SETTING, before)


def write_lake(df: DataFrame, path: str, fmt: str = "parquet",
               max_records_per_file: int = 5_000_000, by_folder: bool = False) -> str:
    """Write admissions partitioned by ``part_year``/``part_region``
    (replacing the target), the layout of the external table.

    ``by_folder``: ``df`` is read from a table of the same folders, as the
    admissions fact is.  A task that reads it has rows of few folders already,
    so they are written where they are read, without a shuffle."""
    named = with_partition_columns(df)
    staged = named if by_folder else rebalance_for_write(named, LAKE_PARTITIONS)
    with open_folders(df.sparkSession):
        (staged.write.mode("overwrite")
         .option("maxRecordsPerFile", max_records_per_file)
         .partitionBy(*LAKE_PARTITIONS)
         .format(fmt)
         .options(**({"header": "false"} if fmt == "csv" else {}))
         .save(path))
    return path


def read_lake(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read the lake with partition discovery.  The schema is given, so the
    partition columns stay strings (as declared) and nothing is inferred;
    filters on ``part_year``/``part_region`` prune folders."""
    reader = spark.read.schema(LAKE_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "false").option("dateFormat", "yyyy-MM-dd")
    return reader.load(path)


def register_tables(spark: SparkSession, lake_path: str, database: str = DATABASE,
                    db_location: str | None = None, fmt: str = "parquet",
                    hospitals: DataFrame | None = None) -> str:
    """Create the database, the partitioned external fact table over the
    lake (``fmt="csv"``: headerless text) and, if given, the hospital
    dimension as a table, then discover the partitions.  Idempotent; tables
    that exist stay as they are, so take another ``database`` for another lake."""
    loc = f" LOCATION '{db_location}'" if db_location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{loc}")
    cols = ", ".join(f"{f.name} {f.dataType.simpleString().upper()}" for f in LAKE_SCHEMA.fields)
    options = " OPTIONS (header 'false', dateFormat 'yyyy-MM-dd')" if fmt == "csv" else ""
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {database}.{FACT_TABLE} ({cols})
                  USING {fmt}{options} PARTITIONED BY ({', '.join(LAKE_PARTITIONS)})
                  LOCATION '{lake_path}'""")
    repair_partitions(spark, f"{database}.{FACT_TABLE}")
    if hospitals is not None and not spark.catalog.tableExists(f"{database}.{DIMENSION_TABLE}"):
        hospitals.write.saveAsTable(f"{database}.{DIMENSION_TABLE}")
    return f"{database}.{FACT_TABLE}"


def repair_partitions(spark: SparkSession, table: str) -> None:
    """Register partition folders written since the table was created."""
    spark.sql(f"MSCK REPAIR TABLE {table}")
