"""Gold tables: JSON files written by the batch side and read for serving."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..session import scratch_path

GOLD_TABLES = ("gold_kpis", "gold_trends", "gold_regional", "gold_readmissions")


class GoldTableNotFound(FileNotFoundError):
    """A gold table was requested before any dataset was processed."""


def gold_path(base_dir: str, name: str) -> str:
    return f"{base_dir.rstrip('/')}/{name}"


def _schema_path(base_dir: str, name: str) -> str:
    return f"{gold_path(base_dir, name)}.schema"


def write_gold(df: DataFrame, name: str, base_dir: str, partitions: int | None = None) -> str:
    """Write one gold table as JSON lines, replacing the previous version,
    and its schema beside it.

    Records are text made by ``to_json``: NULL fields stay in them, and
    columns may differ in case only.  By default the table keeps the
    partitioning of the aggregation that produced it (AQE packs a small
    result into few files), so a large gold table -- e.g. one row per
    hospital of a big upload -- is still written by many tasks.
    ``partitions=n`` asks for ``n`` files; it uses ``repartition`` (not
    ``coalesce``) so the aggregation above keeps its parallelism.  Nothing
    passes through the driver.
    """
    out = df.repartition(partitions) if partitions else df
    path = gold_path(base_dir, name)
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string")
    schema.coalesce(1).write.mode("overwrite").text(_schema_path(base_dir, name))
    out.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return path


def read_gold(spark: SparkSession, name: str, base_dir: str,
              schema: T.StructType | None = None) -> DataFrame:
    """Read a gold table with the schema it was written with (or the given
    one); ``gold_kpis`` yields its first record only.

    Raises ``GoldTableNotFound`` when the table was never written.
    """
    try:
        lines = spark.read.text(gold_path(base_dir, name))
        if schema is None:
            schema = T.StructType.fromJson(json.loads(spark.read.text(_schema_path(base_dir, name)).first()["value"]))
    except AnalysisException as e:
        if _missing(e):
            raise GoldTableNotFound(f"{name}: data not found, process a dataset first") from e
        raise
    df = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    return df.limit(1) if name == "gold_kpis" else df


class Checked(NamedTuple):
    """Rows of a JSON table, and how many of its records could not be read."""

    rows: DataFrame
    records: int
    bad: int


#: Column for the text of a record that cannot be read.
BAD_RECORD = "_bad_record"


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in (e.getCondition() or "") or "Path does not exist" in str(e)


def read_checked(spark: SparkSession, path: str, schema: T.StructType) -> Checked:
    """A JSON table parsed once: its good rows, kept under the checkpoint
    folder, and the numbers of its records and of those that are no JSON
    or do not fit ``schema``.

    Raises ``GoldTableNotFound`` when nothing is at ``path``.  Any other
    failure (a lost executor, no memory, no permission, a bad file system) is
    raised as it is.
    """
    wide = T.StructType([*schema.fields, T.StructField(BAD_RECORD, T.StringType())])
    try:
        parsed = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD).json(path)
    except AnalysisException as e:
        if _missing(e):
            raise GoldTableNotFound(f"{path}: data not found") from e
        raise
    path = scratch_path(spark, "gold-parsed")
    parsed.write.parquet(path)
    kept = spark.read.schema(wide).parquet(path)
    seen = kept.agg(F.count(F.lit(1)).alias("records"), F.count(BAD_RECORD).alias("bad")).first()  # one column of what was parsed
    return Checked(kept.where(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD), seen["records"], seen["bad"])


def read_or_default(spark: SparkSession, path: str, default: DataFrame,
                    schema: T.StructType | None = None) -> DataFrame:
    """The JSON table at ``path``, or ``default`` when it is missing or holds
    a record that cannot be read (the schema of ``default`` is used for
    reading).  Every other failure is raised: a job that lost an executor or
    its memory has not seen a bad table."""
    try:
        found = read_checked(spark, path, schema or default.schema)
    except GoldTableNotFound:
        return default
    return default if found.bad else found.rows
