"""Line dedup over levelled sorted runs of line hashes (DataFrame only).

A *run* is a table of line hashes, bucketed by hash and sorted inside its
buckets: one row per line key with the number of documents known to hold it
and the id that keeps it.  Documents come in batches, newest (largest ids)
first.  A batch is reduced to one row per key and merge-anti-joined with the
runs: a key that ``min_docs`` documents hold already is decided, its keeper (the
largest id of its first batch) cannot change any more, and it is not written
again.  What is left, keys nobody has seen and keys with too few documents so
far, is added as a run of level 0, with the counts so far carried on by a merge
join.  When a level holds ``fanout`` runs they are compacted into one run of the
next level, so a key is rewritten once per level and a batch meets few runs.
Runs and batches are bucketed alike, so these joins and merges move no run over
the network.

Only hashes are ever shuffled by key (partial sums first, so a line that a
third of the documents hold is one row per task).  Texts move once, by
document, to meet the positions of their dropped lines.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
A-Z lower-cased, held as two 64-bit hashes.  Keys of at least ``min_chars``
code points found in at least ``min_docs`` documents lose all their lines
except in the largest doc_id that holds them.

Defined results:

* null or empty text is one empty line, which is too short to be dropped;
* rows that repeat a doc_id are one document when documents are counted, and
  each row is cut by its own lines; equal rows have equal results;
* a null doc_id counts for nothing and its row stays as it is;
* a key repeated inside one document counts once, and all its lines go or stay;
* a document that loses every line has the empty text; no row ever goes;
* an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, stored, wide_hash

BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Batches in which a whole table is taken in, and runs of a level before it is compacted.
BATCHES = 4
FANOUT = 2

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text hash, line position and key hash of every line that is
    long enough; the only pass that looks at line texts."""
    lines = (docs.filter("doc_id IS NOT NULL")
             .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .select("doc_id", "th", "pos", line_key(F.col("line")).alias("k"))
             .filter(F.char_length("k") >= min_chars))
    h1, h2 = wide_hash(F.col("k"))
    return lines.select("doc_id", "th", "pos", h1.alias("h1"), h2.alias("h2"))


class LineRuns:
    """The levelled runs of one corpus.

    ``levels[i]`` lists the table names of level i.  Tables live in the
    session's warehouse folder, which a cluster shares.  ``buckets`` holds
    for all runs; by default it is the session's shuffle partitions, so that the
    task that dealt a bucket's rows writes its file.

    With ``newest_first``, every batch has smaller ids than the ones before, and
    keys with ``min_docs`` documents are decided.  Without, a later batch may
    bring a larger id, so every key of a batch is written."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None,
                 min_docs: int = MIN_DOCS, newest_first: bool = False):
        self.spark, self.fanout, self.min_docs, self.newest_first = spark, fanout, min_docs, newest_first
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        table = f"{self.name}_{self._made}"
        self._made += 1
        # One exchange that deals rows as the buckets do: one file per bucket.
        (rows.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
         .format("parquet").saveAsTable(table))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def add(self, lines: DataFrame) -> None:
        """Take in one batch: rows (doc_id, h1, h2) of documents in no earlier batch."""
        rows = (lines.groupBy(*KEY)
                .agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")))
        if self.newest_first:
            for run in self.runs():
                rows = rows.join(run.filter(F.col("n_docs") >= self.min_docs).select(*KEY).hint("merge"), KEY, "left_anti")
        # Counts in a run are those up to its batch, so the largest one is the last.
        rows = rows.withColumns({"before": F.lit(0).cast("long"), "kept_by": F.col("keeper")})
        for run in self.runs():
            known = run.select(*KEY, F.col("n_docs").alias("_n"), F.col("keeper").alias("_k")).hint("merge")
            rows = rows.join(known, KEY, "left").withColumns({
                "before": F.greatest("before", F.coalesce("_n", F.lit(0))), "kept_by": F.greatest("kept_by", "_k")}).drop("_n", "_k")
        self._write(rows.select(*KEY, (F.col("n_docs") + F.col("before")).alias("n_docs"), F.col("kept_by").alias("keeper")), 0)
        self._compact()

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Runs merged into one row per key.  Buckets and sorting agree, so
        each merge join reads both sides in order, without an exchange (a
        union would lose that)."""
        out = runs[0]
        for run in runs[1:]:
            a, b = out.alias("a"), run.alias("b").hint("merge")
            out = a.join(b, (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full").select(
                *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in KEY],
                F.greatest("a.n_docs", "b.n_docs").alias("n_docs"), F.greatest("a.keeper", "b.keeper").alias("keeper"))
        return out

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old = self.levels[level]
                self._write(self._merged([self.spark.table(t) for t in old]), level + 1)
                self.levels[level] = []
                for t in old:
                    self.spark.sql(f"DROP TABLE {t}")
            level += 1

    def shared(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """Keys held by at least ``min_docs`` documents, with their keeper."""
        if self.newest_first and min_docs > self.min_docs:
            raise ValueError(f"keys are counted up to {self.min_docs} documents only")
        return self._merged(self.runs()).filter(F.col("n_docs") >= min_docs).select(*KEY, "keeper")

    def drop(self) -> None:
        for level in self.levels:
            for t in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = [[]]


def _batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Cuts of the id range into batches of about equal row counts."""
    if batches < 2:
        return []
    cuts = docs.select("doc_id").approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)
    return sorted({int(c) for c in cuts})


def _shared_positions(src: DataFrame, min_docs: int, min_chars: int, batches: int, fanout: int,
                      buckets: int | None) -> DataFrame:
    """(doc_id, th, drop): the positions of the lines that every text loses.
    Batches go in from the largest ids to the smallest, as a growing corpus
    read newest first would."""
    cuts = _batch_bounds(src, batches)
    batch = sum((F.when(F.col("doc_id") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    lines = stored(line_hashes(src, min_chars).withColumn("batch", batch), "line-hashes")
    runs = LineRuns(src.sparkSession, fanout, buckets, min_docs, newest_first=True)
    try:
        for b in range(len(cuts), -1, -1):
            runs.add(lines.filter(F.col("batch") == b).select("doc_id", *KEY))
        # By path and not by bucket, so that a hot key's partition can be split.
        decisions = stored(runs.shared(min_docs), "line-decisions")
    finally:
        runs.drop()
    return (lines.join(decisions, KEY).filter(F.col("doc_id") != F.col("keeper"))
            .groupBy("doc_id", "th").agg(F.collect_set("pos").alias("drop")))


def drop_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
                      fanout: int = FANOUT, buckets: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the text left) of every row, and
    a struct ``row`` of the columns named in ``keep``."""
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *row)
    drops = _shared_positions(src.select("doc_id", "text"), min_docs, min_chars, batches, fanout, buckets)
    split = src.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", "\n").alias("lines"), *(["row"] if keep else []))
    # The lines are an attribute below the join, so the lambda does not split again.
    cut = split.join(drops, ["doc_id", "th"], "left")
    n = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return cut.select("doc_id", n.cast("long").alias("n_lines"),
                      F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"),
                      *(["row"] if keep else []))


def without_shared_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the shared lines cut out of ``text`` (and ``n_chars``,
    if it is there, following the text); null text stays null."""
    others = [c for c in docs.columns if c != "text"]
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("text").isNull().alias("_null_text"))
    out = drop_shared_lines(marked, keep=[*others, "_null_text"], **settings)
    text = F.when(~F.col("row._null_text"), F.col("kept"))

    def column(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            kind = docs.schema[c].dataType
            return F.when(F.col("n_dropped") > 0, F.char_length("kept").cast(kind)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col("row").getField(c).alias(c)
    return out.select(*[column(c) for c in docs.columns])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_lines, n_dropped, kept_sha256."""
    return (drop_shared_lines(documents(spark, sf_dir, "doc_id", "text"))
            .select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.*, shared.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN shared ON l.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
