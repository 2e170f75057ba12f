"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios (Wang and Manning, "Baselines and Bigrams", 2012).

Features are the character n-grams of a document's distinct words, each word
between two boundary marks, hashed to ``BUCKETS`` buckets; a feature's value is the
number of distinct words that have it, times the bucket's log-count ratio
``r = log((p + a) / |p|) - log((q + a) / |q|)`` over all toxic (p) and other
(q) training texts.  A logistic regression on the scaled features gives the
weights.  So a document's score is a sum over its distinct words, and each
word's share is computed once and remembered.

The log-count ratios come from every training row (counted in tasks, summed
per bucket).  The regression is fitted on a bounded sample of training rows:
about ``FIT_ROWS`` rows and ``FIT_BYTES`` of text, chosen by a hash of the doc_id;
all of them if there are no more.  So what the driver holds is bounded for
texts of any length.  All features of the sample enter.  A row's features are the sum of those of its distinct
words, so the driver holds the words of each row and the buckets of each word, and not
the buckets of each row.  A bucket that was counted, but is in no row of the
sample, has the mean weight of the others.

Defined results: null and empty text scores by the intercept alone; texts are
scored whole; a doc_id with several labels counts with each; null labels are
not learnt from; without training rows of both labels every
score is 0.999 if only toxic ones are known and 0.001 if not; repeated rows score alike; rows of a null doc_id
are scored (their ``held_out`` is null) and not learnt from; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memory, crc_fold, documents, give_back, in_arrow, small, small_batches, stored, table, utf8, with_columns

BUCKETS = 1 << 18
MASK = BUCKETS - 1
SIZES = (3, 4, 5)
#: Added to every count.
SMOOTH = 1.0
#: Rows the regression is fitted on, at most about.
FIT_ROWS = 20_000
#: Bytes of text that they have together, at most about.
FIT_BYTES = 40 << 20
#: Words whose buckets the fit takes at a time.
FIT_BLOCK = 100_000
THRESHOLD = 0.3
MEMORY_WORDS = 150_000
#: The same where a word's value is one number.
SCORED_WORDS = 300_000
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: bytes) -> list[str]:
    """The distinct words of a text, lower-cased."""
    return list(dict.fromkeys(_WORDS.findall(text.decode("utf-8", "replace").lower())))


def grams(word: str) -> set[int]:
    """The distinct buckets of a word's character n-grams."""
    w = f"\x02{word}\x03".encode("utf-16-le", "replace")  # two bytes a character
    return {crc32(w[i:i + 2 * n]) & MASK for n in SIZES for i in range(0, len(w) - 2 * n + 2, 2)}


def _packed(word: str) -> np.ndarray:
    got = grams(word)
    return np.fromiter(got, np.int32, len(got))


def _bucket_counts(training: DataFrame) -> DataFrame:
    """(bucket, toxic, other): summed feature values per bucket."""
    def run(batches):
        known = Memory(MEMORY_WORDS)
        sums = np.zeros((2, BUCKETS))
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for at, text in enumerate(utf8(batch, "text")):
                words = words_of(text)
                if words:
                    here = np.concatenate(list(map(known.ready(words, _packed), words)))
                    sums[int(label[at])] += np.bincount(here, minlength=BUCKETS)
        del known
        give_back()
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[1, at]), pa.array(sums[0, at])],
                                         ["bucket", "toxic", "other"])
    return (small_batches(training).mapInArrow(run, "bucket int, toxic double, other double")
            .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def _sample_words(rows: DataFrame) -> DataFrame:
    """label and the distinct words (separated by a line feed, which is in no
    word) of every row."""
    def task():
        def step(batch):
            words = ["\n".join(words_of(text)).encode("utf-8", "replace") for text in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.binary())], ["label", "words"])
        return step
    return in_arrow(rows.select("label", "text"), task, "label int, words binary")


class _Sample:
    """The rows that the regression is fitted on: the words of every row and
    the buckets of every word."""

    def __init__(self, rows):
        known: dict[bytes, int] = {}
        own, labels = [], []
        for r in rows:
            words = bytes(r["words"]).split(b"\n") if r["words"] else []
            own.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
            labels.append(r["label"])
        self.y = np.array(labels, float)
        self.row = np.repeat(np.arange(len(own), dtype=np.int32), [len(a) for a in own])
        self.word = np.concatenate(own) if own else np.zeros(0, np.int32)
        self.n_words = len(known)
        del own
        self.blocks, words = [], list(known)
        for at in range(0, len(words), FIT_BLOCK):
            parts = [_packed(w.decode()) for w in words[at:at + FIT_BLOCK]]
            self.blocks.append((at, np.array([len(a) for a in parts]), np.concatenate(parts)))

    def buckets(self) -> np.ndarray:
        """Whether a bucket is in any row."""
        there = np.zeros(BUCKETS, bool)
        for _, _, b in self.blocks:
            there[b] = True
        return there

    def loss(self, w: np.ndarray, ratio: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss with a ridge penalty, and its gradient; the last
        number of ``w`` is the intercept."""
        weight, share = w[:-1] * ratio, np.zeros(self.n_words)
        for at, lengths, b in self.blocks:
            share[at:at + len(lengths)] = np.add.reduceat(weight[b], np.cumsum(lengths) - lengths)
        z = np.bincount(self.row, share[self.word], len(self.y)) + w[-1]
        value = (np.logaddexp(0, z) - self.y * z).mean() + penalty / 2 * (w[:-1] @ w[:-1])
        d = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - self.y) / len(self.y)
        pull, g = np.bincount(self.word, d[self.row], self.n_words), np.zeros(len(w))
        for at, lengths, b in self.blocks:
            g[:-1] += np.bincount(b, np.repeat(pull[at:at + len(lengths)], lengths), BUCKETS)
        g[:-1] = g[:-1] * ratio + penalty * w[:-1]
        g[-1] = d.sum()
        return value, g


def _fit(sample: _Sample, ratio: np.ndarray, steps: int = 100, penalty: float = 1e-4, memory: int = 8) -> tuple[np.ndarray, float]:
    """Logistic regression with a ridge penalty, by limited-memory BFGS over the
    whole sample: the same rows give the same weights."""
    mean = np.clip(sample.y.mean(), 1e-6, 1 - 1e-6)
    w = np.zeros(BUCKETS + 1)
    w[-1] = np.log(mean / (1 - mean))
    value, g = sample.loss(w, ratio, penalty)
    start, past = np.linalg.norm(g), []
    for _ in range(steps):
        if np.linalg.norm(g) <= 1e-4 * start:
            break
        step, kept = -g, []
        for s, y, r in reversed(past):
            a = r * (s @ step)
            step -= a * y
            kept.append(a)
        step *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else 1 / max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            step += (a - r * (y @ step)) * s
        slope, size = g @ step, 1.0
        while True:
            new = w + size * step
            new_value, new_g = sample.loss(new, ratio, penalty)
            if new_value <= value + 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if new_value >= value:
            break
        s, y = new - w, new_g - g
        if s @ y > 1e-12:
            past = [*past[1 - memory:], (s, y, 1 / (s @ y))]
        w, value, g = new, new_value, new_g
    return w[:-1], float(w[-1])


class ToxicityModel:
    """Weight of every bucket and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept

    def sharer(self):
        """The function that gives a word's share of the score."""
        weight = self.weights.tolist().__getitem__
        return lambda word: sum(map(weight, grams(word)))


def fit_share(rows: int, size: int, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> float:
    """Share of the training rows that the regression is fitted on."""
    return min(1.0, fit_rows / max(1, rows), fit_bytes / max(1, size))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> ToxicityModel:
    """Learn from (doc_id, text) and (doc_id, toxic); the caller leaves out
    the rows that are not to be learnt from."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"))
    training = stored(docs.select("doc_id", "text").join(small(known), "doc_id").select("doc_id", "text", "label"), "toxicity-training")
    sums = training.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    found = {r["label"]: r["n"] for r in sums}
    share_of = fit_share(sum(found.values()), sum(r["bytes"] or 0 for r in sums), fit_rows, fit_bytes)
    if len(found) < 2:
        share = 0.999 if 1 in found else 0.001
        return ToxicityModel(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    counts = _bucket_counts(training).toPandas()  # at most BUCKETS rows
    p, q = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    p[counts["bucket"]] += counts["toxic"]
    q[counts["bucket"]] += counts["other"]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    kept = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 31)) < int(share_of * (1 << 31))
    sample = training.filter(kept) if share_of < 1 else training
    rows = _Sample(stored(_sample_words(sample), "toxicity-sample").toLocalIterator())  # about fit_rows rows and fit_bytes
    w, intercept = _fit(rows, ratio)
    there = rows.buckets()
    counted = np.zeros(BUCKETS, bool)
    counted[counts["bucket"]] = True
    w[counted & ~there] = w[there].mean() if there.any() else 0.0
    del rows, counts
    give_back()  # the driver lives on: what the fit has freed is not to come on top of later stages
    return ToxicityModel(w * ratio, intercept)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1; one of that name is
    replaced); no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("toxicity")
    schema = with_columns(docs, toxicity="double")

    def task():
        known, m = Memory(SCORED_WORDS), shared.value
        share = m.sharer()

        def step(batch):
            z = []
            for text in utf8(batch, "text"):
                words = words_of(text)
                z.append(m.intercept + sum(map(known.ready(words, share), words)))
            z = np.array(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))],
                                             [*batch.schema.names, "toxicity"])
        return step
    return in_arrow(docs, task, schema)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """The model of the labelled rows outside the held-out fold."""
    return train(docs.select("doc_id", "text").filter(crc_fold() != 2), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, predicted."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = score(docs, trained(spark, docs, sf_dir))
    return scored.select("doc_id", (crc_fold() == 2).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
