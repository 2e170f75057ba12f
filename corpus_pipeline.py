"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark
decontamination, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet and reads again as
the next one's docs.  All stages but the last return the columns of
``documents``; each works on every row that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.llm import decontaminate, lines, near_dups, pieces, toxicity
from wardstat.llm.common import documents, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier learns from
    the labelled rows of ``docs`` outside the held-out fold."""
    docs = docs.select(COLUMNS)
    scored = toxicity.score(docs, toxicity.trained(spark, docs, sf_dir))
    return scored.filter(F.col("toxicity") < toxicity.THRESHOLD).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that three documents share (but for
    the one of the largest doc_id); n_chars follows the text.  Null text
    stays null."""
    return lines.without_shared_lines(docs.select(COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id.

    Groups are documents linked by at least 80 % of their five-word shingles
    (confirmed on the full sets); a pair at that similarity misses every band
    with a probability below one in a million, a likelier one less.  A copy with
    so many words changed that less is left (one in twenty words, spread evenly,
    takes about 40 % of the shingles) is no near-duplicate here."""
    docs = docs.select(COLUMNS)
    return near_dups.without(docs, near_dups.near_duplicates(docs, SHINGLE, PERCENT))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), "documents")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 of every document left."""
    return pieces.digests(pieces.encode_documents(docs, pieces.default_model()))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: The classifier, the MinHash bands and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "*")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
