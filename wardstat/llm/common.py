"""Helpers shared by the corpus operators.

Every operator selects the columns it needs by name before it does
anything else, so extra columns of the input, whatever they are called,
never meet an operator's own columns.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstat.session import ensure_checkpoint_dir, scratch_path

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows above which a set of ids is joined by a shuffle and not broadcast
#: (a broadcast row of two longs takes about 40 bytes: at most 40 MB).
BROADCAST_ROWS = 1_000_000
#: Rows of a batch that a Python step sees at once.
SLICE_ROWS = 512
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, everything else as it is.  Text of ASCII only takes
    the byte-wise ``lower``; other text must not, since it would also map
    letters outside A-Z."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, AZ, AZ.lower()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside a lambda a plain
    expression would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same values from different seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame under the shared checkpoint folder and read it back: the
    lineage ends there, and losing an executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Count a stored frame against a bound (parquet footers only)."""
    return df.count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the stored frame is within the bound; beyond it
    the frame as it is, which Spark joins by a shuffle."""
    return F.broadcast(df) if has_at_most(df, rows) else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``SLICE_ROWS``
    rows (a smaller setting stays): the buffers of a batch lie outside an
    executor's heap, once for each direction and task."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= SLICE_ROWS:
        conf.set(BATCH_SETTING, str(SLICE_ROWS))
    return df


def in_arrow(df: DataFrame, task: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]],
             schema: str) -> DataFrame:
    """``mapInArrow`` where ``task()`` runs once per task and returns the
    function of one batch; batches come in slices, so that what a step makes
    of them stays small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = task()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield from step(batch.slice(at, SLICE_ROWS))
        del step, batches
        give_back()
    return small_batches(df).mapInArrow(run, schema)


def give_back() -> None:
    """Return what a task has freed to the system: workers live on, and the
    next stage's need not come on top of this one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of a column as UTF-8 bytes (null: empty) without decoding."""
    column = batch.column(name)
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py() or b""


class Memory:
    """Values of words, computed once and kept by the worker: two
    generations, so that what is used stays and the size is bounded."""

    def __init__(self, size: int):
        self.half, self.new, self.old = max(1, size // 2), {}, {}

    def ready(self, words: Iterable, one: Callable | None = None, many: Callable | None = None) -> Callable:
        """The lookup of a word's value, once all of ``words`` (without
        repeats) are known, by ``one(word)`` or ``many(words)``."""
        if len(self.new) > self.half:
            self.old, self.new = self.new, {}
        known, old = self.new, self.old
        # One look into the large memory for each word; the caller's many
        # lookups then go to a small one.
        local = {w: known.get(w) for w in words}
        missing = [w for w, v in local.items() if v is None]
        if missing:
            fresh = [w for w in missing if w not in old]
            found = {w: old[w] for w in missing if w in old}
            found.update(zip(fresh, many(fresh) if many else map(one, fresh), strict=True))
            known.update(found)
            local.update(found)
        return local.__getitem__


def with_columns(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of a frame with columns added."""
    return T.StructType([*df.schema.fields, *(T.StructField(k, T.DoubleType() if v == "double" else T.StringType())
                                              for k, v in kinds.items())])


def crc_fold(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4


def attempt() -> str:
    """A name for what this attempt of a task writes."""
    ctx = TaskContext.get()
    return f"{ctx.partitionId():06d}-{ctx.attemptNumber()}-{uuid.uuid4().hex[:8]}"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


__all__ = ["AZ", "BROADCAST_ROWS", "Memory", "ascii_lower", "attempt", "crc_fold", "documents", "ensure_checkpoint_dir", "give_back",
           "has_at_most", "in_arrow", "let", "scratch_path", "small", "small_batches", "stored", "table", "utf8", "wide_hash", "with_columns"]
