"""Vital-sign stream: decode JSON messages, flag anomalies, push results.

The same ``flag_anomaly`` runs on batch and streaming frames.  The source
is pluggable: Kafka (``icu_vitals`` topic, starting at the latest offset)
when the Kafka connector is on the classpath, or a folder of JSON files,
which is also how the tests drive the stream.  Every streaming query is
checkpointed under the shared checkpoint folder, so a restarted query
resumes from its last committed micro-batch.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions import scalars as S
from ..operators.windows import latest_n
from ..schemas import VITALS, VITALS_MESSAGE, VITALS_TOPIC

TOPIC = VITALS_TOPIC
# Messages built from vitals rows: the time-of-day text plus every column.
VITALS_STREAM = T.StructType([T.StructField("timestamp", T.StringType())] + VITALS.fields)
# Readings, which messages carry with one decimal.
READINGS = ("heart_rate", "blood_pressure_systolic", "oxygen_level")
# Microsecond timestamps in messages (the JSON default keeps milliseconds).
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# --- codec ------------------------------------------------------------------

def encode_vitals(df: DataFrame, time_col: str | None = "ts") -> DataFrame:
    """One JSON text ``value`` per row, as every sink publishes it: all
    columns, readings rounded to one decimal, and the message's
    ``timestamp`` as ``HH:mm:ss`` text of ``time_col`` (unless the rows have
    one already)."""
    cols = [F.round(c, 1).alias(c) if c in READINGS else F.col(c) for c in df.columns]
    if time_col and time_col in df.columns and "timestamp" not in df.columns:
        cols = [S.format_date(time_col, "HH:mm:ss").alias("timestamp")] + cols
    return df.select(F.to_json(F.struct(*cols), JSON_OPTIONS).alias("value"))


def decode_vitals(sdf: DataFrame, schema: T.StructType = VITALS_MESSAGE,
                  value_col: str = "value", source_time_col: str | None = None) -> DataFrame:
    """Parse the JSON ``value`` with an explicit schema.  A message that is
    not valid JSON yields NULL fields (it is kept, and is not an anomaly).
    ``source_time_col`` (e.g. Kafka's ``timestamp``) is kept as
    ``source_time``: the messages carry a time of day only."""
    parsed = sdf.select(F.from_json(F.col(value_col).cast("string"), schema, JSON_OPTIONS).alias("_m"),
                        *([F.col(source_time_col).alias("source_time")] if source_time_col else []))
    return parsed.select("_m.*", *(["source_time"] if source_time_col else []))


def flag_anomaly(df: DataFrame) -> DataFrame:
    """Adds ``anomaly_detected``: heart rate above 120 or oxygen below 90
    (missing readings default to 0 and 100).  Stateless: works on batch
    and streaming frames alike."""
    return df.withColumn("anomaly_detected", S.anomaly("heart_rate", "oxygen_level"))


# --- sources --------------------------------------------------------------------

def read_vitals(spark: SparkSession, kind: str = "kafka", schema: T.StructType = VITALS_MESSAGE,
                path: str | None = None, bootstrap_servers: str | None = None,
                topic: str = TOPIC, starting_offsets: str = "latest",
                max_files_per_trigger: int | None = None,
                max_offsets_per_trigger: int | None = None,
                after: dt.datetime | None = None) -> DataFrame:
    """Streaming frame of decoded vitals.

    ``kind="kafka"`` needs the Kafka connector on the classpath; it starts at
    ``starting_offsets``.  ``kind="files"`` reads JSON-lines files (one message
    per line) from ``path`` with the same schema, from the first file on, or,
    with ``after`` (see ``start_position``), only files newer than that: the
    backlog of the start is left out, as a consumer that starts at the latest
    message leaves it.  ``max_offsets_per_trigger`` /
    ``max_files_per_trigger`` bound each micro-batch, so a backlog is
    worked off in steady batches instead of one huge one.
    """
    if kind == "kafka":
        reader = (spark.readStream.format("kafka")
                  .option("kafka.bootstrap.servers", bootstrap_servers)
                  .option("subscribe", topic)
                  .option("startingOffsets", starting_offsets))
        if max_offsets_per_trigger:
            reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
        raw = reader.load()
        return decode_vitals(raw, schema, source_time_col="timestamp")
    if kind == "files":
        reader = spark.readStream.schema(T.StructType([T.StructField("value", T.StringType())]))
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        raw = reader.text(path)
        if after is not None:
            raw = raw.where(F.col("_metadata.file_modification_time") > F.lit(after))
        return decode_vitals(raw, schema)
    raise ValueError(f"unknown vitals source {kind!r}")


# --- sinks ----------------------------------------------------------------------

def write_vitals_files(df: DataFrame, path: str) -> str:
    """Batch-publish records as JSON lines (the file stand-in for the topic)."""
    encode_vitals(df).write.mode("append").text(path)
    return path


def write_vitals_kafka(sdf: DataFrame, checkpoint: str, bootstrap_servers: str,
                       topic: str = TOPIC) -> StreamingQuery:
    """Publish each record as a JSON message (needs the Kafka connector)."""
    return (encode_vitals(sdf).writeStream.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("topic", topic)
            .option("checkpointLocation", checkpoint)
            .start())


def push(sdf: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
         available_now: bool = False) -> StreamingQuery:
    """Hand every micro-batch to ``fn(batch_df, batch_id)`` (append mode).
    ``fn`` must be idempotent per ``batch_id``: a batch re-run after a
    failure gets the same id."""
    w = sdf.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def write_stream_files(sdf: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                       available_now: bool = False) -> StreamingQuery:
    """Append every record to a file sink (exactly-once through the sink's
    commit log and the checkpoint)."""
    w = (sdf.writeStream.format(fmt).outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


#: Columns of the writer's own log, in every kept row: the generation, and the
#: query and batch that wrote it.
_LOG = "_generation long, _query string, _batch long"


def _slot(path: str, generation: int) -> str:
    return f"{path}/gen_{generation % 2}"


def _kept(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A slot's rows with their log; None if it was never written.  The schema
    is given, so nothing but the rows themselves is read."""
    wide = T.StructType([*schema.fields, *T.StructType.fromDDL(_LOG).fields])
    try:
        return spark.read.schema(wide).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise


def _last(slots: list[DataFrame | None]) -> list[tuple[int, str, int]]:
    """(generation, query, batch) of the slots that hold rows, oldest first."""
    heads = [s.select("_generation", "_query", "_batch").first() for s in slots if s is not None]
    return sorted(tuple(h) for h in heads if h is not None)


def latest_n_writer(path: str, n: int = 20, ts: str = "ts", keys: Sequence[str] = (),
                    tie_breakers: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function keeping the ``n`` most recent records
    (overall, or per key) under ``path``.

    Generations take turns in two slots, and every row carries its own commit
    log: the generation, the query and the batch that wrote it.  A batch reads the
    last generation, cuts its rows and its own to the top ``n``, and overwrites
    the other slot through Spark's commit protocol, so until that write has
    committed the last generation is whole and is what readers see.  A batch
    that runs again (killed before the stream committed it) finds its own
    generation and replaces it from the one before, still in the other slot; a
    query restarted on a new checkpoint goes on from what is kept.  Nothing
    is listed, renamed or deleted.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        done = _last([_kept(spark, _slot(path, g), batch.schema) for g in (0, 1)])
        if done and done[-1][1:] == (query, batch_id):
            number, done = done[-1][0], done[:-1]
        else:
            number = done[-1][0] + 1 if done else 0
        rows = batch
        if done:
            rows = batch.unionByName(_kept(spark, _slot(path, done[-1][0]), batch.schema).select(*batch.columns))
        top = latest_n(rows, ts, n, keys, tie_breakers)
        top = top.select("*", F.lit(number).cast("long").alias("_generation"), F.lit(query).alias("_query"),
                         F.lit(batch_id).cast("long").alias("_batch"))
        top.write.mode("overwrite").parquet(_slot(path, number))
    return fn


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows last kept by ``latest_n_writer``; None if nothing was kept
    yet.  A slot that is there but cannot be read raises."""
    slots = []
    for g in (0, 1):
        try:
            slots.append(spark.read.parquet(_slot(path, g)))
        except AnalysisException as e:
            # Not there, or no file committed there yet.
            if (e.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    done = [(head[0], s) for s in slots if (head := s.select("_generation").first()) is not None]
    if not done and not slots:
        return None
    _, rows = max(done, key=lambda d: d[0]) if done else (None, slots[0])
    return rows.drop(*T.StructType.fromDDL(_LOG).fieldNames())


def newest_message(spark: SparkSession, path: str) -> dt.datetime | None:
    """The position behind everything that is in the topic folder ``path``
    now: the time of its newest file, as the file system tells it; None if
    there is none.  Only the files' listing is read."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise
    return files.agg(F.max("modificationTime")).first()[0]


def start_position(spark: SparkSession, path: str, log: str) -> dt.datetime | None:
    """The position that a stream over ``path`` started at: ``newest_message``
    on the first call, written to ``log`` (one row, beside the stream's
    checkpoint); what is written there on every later one.  So a restarted
    query leaves out what the first start left out, and reads what was
    published while it was down."""
    schema = T.StructType([T.StructField("position", T.TimestampType())])
    try:
        return spark.read.schema(schema).parquet(log).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
    position = newest_message(spark, path)
    spark.createDataFrame([(position,)], schema).coalesce(1).write.parquet(log)
    return position
