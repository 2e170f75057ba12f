"""Delimited-text sources and sinks: admissions CSV, raw text lines and
``key<TAB>value`` result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..schemas import ADMISSIONS, ADMISSIONS_TEXT, HOSPITALS_DIM

HEADER_FIRST_FIELD = "patient_id"


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> str:
    """CSV with a header, one row per record, written in parallel (one part
    file per task).  Dates are written as ``yyyy-MM-dd``."""
    df.write.mode(mode).option("header", header).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


def read_admissions(spark: SparkSession, path: str, schema: T.StructType = ADMISSIONS,
                    header: bool = True, mode: str = "PERMISSIVE") -> DataFrame:
    """Admissions CSV with an explicit schema (no inference pass).

    ``mode``: ``PERMISSIVE`` keeps a row and nulls its unparsable fields,
    ``DROPMALFORMED`` drops such rows, ``FAILFAST`` stops the job.  Rows
    are only checked for the columns a query reads (CSV column pruning):
    a bare ``count()`` parses nothing and so drops nothing.
    """
    return (spark.read.schema(schema)
            .option("header", header).option("mode", mode)
            .option("dateFormat", "yyyy-MM-dd")
            .csv(path))


def read_hospitals(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """The hospital dimension from delimited text (``schemas.HOSPITALS_DIM``;
    headerless by default, as the table's text format is)."""
    return (spark.read.schema(HOSPITALS_DIM).option("header", header)
            .option("mode", "PERMISSIVE").csv(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw text lines (one ``value`` column), nested directories included."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def read_data_lines(spark: SparkSession, path: str, mark: str = HEADER_FIRST_FIELD) -> DataFrame:
    """Raw text lines without the files' headers (one ``value`` column),
    nested directories included.

    A header is a file's first line (byte offset 0), and only if it contains
    ``mark``; a line that contains it anywhere else is data, and so is a first
    line without it.  An empty first line is a first line.

    Lines without the mark stream through untouched.  Of the others a file
    has few: they are grouped by file and text in one more scan, together with
    the place of the file's first line, and the one that stands there loses one
    of its copies.  The place is the row's running number inside the scan of
    the file's first block, and is compared within that scan only.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    marked = F.contains(F.col("value"), F.lit(mark))
    first_block = F.col("_metadata.file_block_start") == 0
    place = F.monotonically_increasing_id()
    groups = (lines.select(F.col("_metadata.file_path").alias("file"), F.when(marked, F.col("value")).alias("line"),
                           F.when(first_block, place).alias("place"))
              .groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")))
    firsts = groups.groupBy("file").agg(F.min("place").alias("first"))
    is_first = F.coalesce(F.col("place") == F.col("first"), F.lit(False))
    copies = F.when(F.col("line").isNull(), 0).otherwise(F.col("n") - is_first.cast("long"))
    kept = (groups.join(firsts, "file").withColumn("copies", copies).where("copies > 0")
            .select(F.col("line").alias("value"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("i")))
    return lines.select("value").where(~marked).unionByName(kept.select("value"))


def parse_lines(lines: DataFrame, min_fields: int = 9, schema: T.StructType = ADMISSIONS_TEXT, sep: str = ",",
                headers: bool = True) -> DataFrame:
    """Split raw lines into the named text columns of ``schema``.

    * lines may hold headers whose place in a file is not known: a line whose
      first field is ``patient_id``, quoted or not, with or without a
      byte-order mark, is dropped.  ``headers=False`` for lines of
      ``read_data_lines``, where such a line is data;
    * trailing empty fields do not count (``...,Yes,`` has 9 fields,
      ``...,,`` with empty readmitted and cost has 8);
    * lines with fewer than ``min_fields`` fields are dropped (the
      frequency job needs 6, the trend job 8, the rate jobs 9);
    * absent fields are NULL; nothing is cast here.

    Splitting is not quote-aware, like the line-oriented jobs; use
    ``read_admissions`` for real CSV.
    """
    arr = S.split_fields("value", sep)
    parsed = lines.select(S.once(arr).alias("_f"))
    kept = parsed.where(F.size("_f") >= min_fields)
    if headers:
        kept = kept.where(F.btrim(S.field("_f", 0), F.lit("\ufeff\" ")) != F.lit(HEADER_FIRST_FIELD))
    return kept.select(*[S.field("_f", i).alias(f.name) for i, f in enumerate(schema.fields)])


def typed_admissions(text_df: DataFrame) -> DataFrame:
    """Cast parsed text columns to ``schemas.ADMISSIONS`` types without
    failing on bad values (they become NULL)."""
    out = []
    for f in ADMISSIONS.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DateType):
            out.append(S.parse_date(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(c.alias(f.name))
        else:
            out.append(c.try_cast(f.dataType).alias(f.name))
    return text_df.select(*out)


def kv_lines(df: DataFrame, keys: Sequence[str], value: Column, sep: str = "|") -> DataFrame:
    """(key, value) text pairs: key = ``a|b|c`` of ``keys``, value text."""
    return df.select(S.concat_key(*keys, sep=sep).alias("key"), value.alias("value"))


def write_kv(kv: DataFrame, path: str, mode: str = "overwrite") -> str:
    """``key<TAB>value`` text, globally sorted by key across part files
    (range-partitioned sort, so no single task holds all rows)."""
    (kv.orderBy("key")
     .select(F.concat_ws("\t", "key", "value").alias("value"))
     .write.mode(mode).text(path))
    return path


def read_kv(spark: SparkSession, path: str) -> DataFrame:
    """Read ``key<TAB>value`` text back into (key, value)."""
    parts = F.split(F.col("value"), "\t", 2)
    return spark.read.text(path).select(S.field(parts, 0).alias("key"), S.field(parts, 1).alias("value"))
