"""Language identification with word-first backoff (after HeLI, Jauhiainen
et al.).

Every word is scored by itself.  A word that training saw in some language
counts its log relative frequency there; where no language has it, its
longest character n-grams that any language has do, first the longest size,
then one shorter, down to single characters.  A language that lacks a word or
n-gram which another has pays a fixed penalty below the least frequency.  A
text's score in a language is the mean over its words, and the greatest wins
(ties: the language name that sorts first); ``score`` is the winner's share
after a softmax over the languages.

The model is all counts of all training texts: (word, language) pairs counted
in tasks and summed by Spark, and the n-gram counts from those sums, grouped by
word or n-gram, so every language's count stands beside the others and no task
holds a language.  It stays a table.  With at most ``BROADCAST_ENTRIES``
entries it is broadcast as sorted hashes with the languages that have each, so a
hundred languages cost what they know and not their square; beyond
that the words of the texts are joined with it by a shuffle.  Both ways add up
the same numbers.

Defined results: ``und`` with score 0 for null texts and texts without a
letter, and for every text when nothing was learnt; a text with letters whose
n-grams are all unknown gets the penalty everywhere, so the first language by
name; null lang is not learnt from; texts are read whole; repeated rows and
rows of a null doc_id are scored each (``held_out`` of a null doc_id is null); an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, documents, has_at_most, in_arrow, stored, utf8, with_columns

SIZES = (5, 4, 3, 2, 1)
#: Added to the least log frequency for what a language lacks.
PENALTY = 7.0
#: (word or n-gram, language) pairs above which the model is joined by a
#: shuffle and not broadcast (22 bytes each: at most 110 MB).
BROADCAST_ENTRIES = 5_000_000
#: Bytes of remembered word scores in a worker.
MEMORY_BYTES = 48 << 20
#: Distinct words a counting task holds before it passes them on.
FLUSH_WORDS = 300_000
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: bytes) -> list[str]:
    """Runs of word characters other than digits, lower-cased; a run without
    a letter (like a lone superscript) is no word, see ``is_word``."""
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


def is_word(run: str) -> bool:
    return any(map(str.isalpha, run))


def _grams(word: str, size: int) -> list[str]:
    """The n-grams of a word between spaces; of one character, those of the word."""
    w = f" {word} " if size > 1 else word
    return [w[i:i + size] for i in range(len(w) - size + 1)]


def _word_counts(training: DataFrame) -> DataFrame:
    """(lang, word, n), counted in tasks and summed."""
    def run(batches):
        def rows(counts):
            for lang, words in counts.items():
                keys = list(filter(is_word, words))
                for at in range(0, len(keys), 50_000):
                    part = keys[at:at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part),
                                                      pa.array([words[k] for k in part], pa.int64())], ["lang", "word", "n"])
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > FLUSH_WORDS:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)
    return (training.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _gram_counts(words: DataFrame) -> DataFrame:
    """(lang, size, gram, n) of every word, weighted by its count."""
    def run(batches):
        for batch in batches:
            counts: dict[str, Counter] = {}
            langs, words, ns = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
            for lang, word, n in zip(langs, words, ns, strict=True):
                c = counts.setdefault(lang, Counter())
                for size in SIZES:
                    for g in _grams(word, size):
                        c[g] += n
            for lang, c in counts.items():
                keys = list(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys)), pa.array([len(k) for k in keys], pa.int32()), pa.array(keys),
                     pa.array([c[k] for k in keys], pa.int64())], ["lang", "size", "gram", "n"])
    return (words.mapInArrow(run, "lang string, size int, gram string, n long")
            .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))


class LanguageModel:
    """Stored tables: ``words`` (word, lang, n) and ``grams`` (size, gram,
    lang, n), the languages by name, and the totals that make counts
    frequencies: of words, and of the n-grams of each size."""

    def __init__(self, words: DataFrame, grams: DataFrame, penalty: float):
        self.words, self.grams = words, grams
        # A row for each language (and size).
        sums = [F.sum("n").alias("total"), F.min("n").alias("least")]
        rows = words.groupBy("lang", F.lit(0).alias("size")).agg(*sums).unionByName(grams.groupBy("lang", "size").agg(*sums)).collect()
        self.totals = {(r["lang"], r["size"]): float(r["total"]) for r in rows}
        self.langs = sorted({lang for lang, _ in self.totals})
        self.missing = min((float(np.log(r["least"] / r["total"])) for r in rows), default=0.0) - penalty
        self.none = np.full(len(self.langs), self.missing)
        self._scores: SparseScores | None = None

    def word(self, word: str) -> np.ndarray:
        """Scores of one word: known, or backed off (for a model small enough to
        be looked into on the driver)."""
        if self._scores is None:
            self._scores = SparseScores(self.entries(), self.langs, self.missing)
        return self._scores.words([word])[0] + self.missing

    def entries(self) -> DataFrame:
        """key, size (0: a word), lang, above: how far the log frequency lies above what a
        language that lacks the key pays."""
        totals = self.words.sparkSession.createDataFrame(
            [(lang, size, n) for (lang, size), n in self.totals.items()], "lang string, size int, total double")
        rows = (self.words.select(F.col("word").alias("key"), F.lit(0).alias("size"), "lang", "n")
                .unionByName(self.grams.select(F.col("gram").alias("key"), "size", "lang", "n")))
        return rows.join(F.broadcast(totals), ["lang", "size"]).select(
            "key", "size", "lang", (F.log(F.col("n") / F.col("total")) - F.lit(self.missing)).alias("above"))


class SparseScores:
    """The entries as arrays: sorted hashes of the keys, and for each the
    languages that have it with their values."""

    def __init__(self, entries: DataFrame, langs: list[str], missing: float):
        place = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
        # The key's size is the seed, so a word and an n-gram of one spelling differ.
        rows = entries.select(F.xxhash64("size", "key").alias("h"), place.cast("int").alias("lang"), "above").toArrow()
        h, lang, above = (np.asarray(rows.column(c).combine_chunks()) for c in ("h", "lang", "above"))
        order = np.lexsort([lang, h])
        h = h[order]
        first = np.flatnonzero(np.diff(h, prepend=h[0] - 1 if len(h) else 0)) if len(h) else np.zeros(0, np.int64)
        self.keys, self.first = h[first], np.append(first, len(h))
        self.lang, self.above = lang[order].astype(np.uint16), above[order]
        self.langs, self.missing = langs, missing

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Add the values of the keys at ``at`` to ``out[rows]``."""
        size = self.first[at + 1] - self.first[at]
        begin = np.repeat(self.first[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        np.add.at(out, (np.repeat(rows, size), self.lang[begin]), self.above[begin])

    def words(self, words: list[str]) -> np.ndarray:
        """A row per word: above ``missing`` for every language."""
        out = np.zeros((len(words), len(self.langs)))
        at = self.find(_hashes(0, words))
        self.add(out, np.flatnonzero(at >= 0), at[at >= 0])
        open_words = np.flatnonzero(at < 0)
        for size in SIZES:
            if not len(open_words):
                break
            grams = [_grams(words[w], size) for w in open_words]
            owner = np.repeat(np.arange(len(grams)), list(map(len, grams)))
            at = self.find(_hashes(size, [g for own in grams for g in own]))
            found = np.bincount(owner[at >= 0], minlength=len(grams))
            part = np.zeros((len(grams), len(self.langs)))
            self.add(part, owner[at >= 0], at[at >= 0])
            hit = found > 0
            out[open_words[hit]] = part[hit] / found[hit, None]
            open_words = open_words[~hit]
        return out


def _hashes(size: int, keys: list[str]) -> np.ndarray:
    """Spark's ``xxhash64(size, key)``: the hash of the key seeded by that of the size."""
    seed = _size_seed(size)
    return np.fromiter((xxhash.xxh64_intdigest(k.encode(), seed) for k in keys), np.uint64, len(keys)).view(np.int64)


def _size_seed(size: int) -> int:
    """``xxhash64`` of one int column: the hash of its four bytes, seeded with 42."""
    return xxhash.xxh64_intdigest(size.to_bytes(4, "little"), 42)


class _Scores:
    """Scores of the words a worker has met, as rows of one array."""

    def __init__(self, model: SparseScores):
        self.model, self.rows = model, {}
        self.most = max(1024, MEMORY_BYTES // (8 * max(1, len(model.langs))))
        self.array = np.zeros((1024, len(model.langs)))

    def learn(self, texts: list[list[str]]) -> None:
        """Score what is new in a batch of texts, all words at once."""
        wanted = set().union(*texts)
        if len(self.rows) > self.most:
            self.rows = {}
        new = [w for w in wanted if w not in self.rows]
        real = list(filter(is_word, new))
        begin = len(self.rows)
        self.rows.update((w, -1) for w in new)
        self.rows.update(zip(real, range(begin, begin + len(real)), strict=True))
        end = begin + len(real)
        if end > len(self.array):
            self.array = np.concatenate([self.array[:begin], np.zeros((end - begin + len(self.array) // 2, self.array.shape[1]))])
        for at in range(0, len(real), 20_000):
            self.array[begin + at:begin + at + 20_000][:len(real[at:at + 20_000])] = self.model.words(real[at:at + 20_000])

    def mean(self, words: list[str]) -> np.ndarray | None:
        """The mean over the words; None if none of them has a letter."""
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        at = at[at >= 0]
        return self.array[at].mean(0) if len(at) else None


def train(training: DataFrame, penalty: float = PENALTY) -> LanguageModel:
    """Count the training rows (text, lang); rows without a lang are skipped."""
    words = stored(_word_counts(training.filter("lang IS NOT NULL").select("lang", "text")), "language-words")
    return LanguageModel(words, stored(_gram_counts(words), "language-grams"), penalty)


def identify(docs: DataFrame, model: LanguageModel, bound: int = BROADCAST_ENTRIES) -> DataFrame:
    """``docs`` with columns ``lang_pred`` and ``lang_score`` (columns of
    those names are replaced)."""
    docs = docs.drop("lang_pred", "lang_score")
    if not model.langs:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "lang_score": F.lit(0.0)})
    if has_at_most(model.words, bound) and model.words.count() + model.grams.count() <= bound:
        return _by_broadcast(docs, model)
    return _by_joins(docs, model)


def _by_broadcast(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Score in the tasks that read the texts; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(SparseScores(model.entries(), model.langs, model.missing))
    schema = with_columns(docs, lang_pred="string", lang_score="double")

    def task():
        known = _Scores(shared.value)
        langs = known.model.langs

        def step(batch):
            preds, scores = [], []
            texts = list(map(words_of, utf8(batch, "text")))
            known.learn(texts)
            for words in texts:
                mean = known.mean(words) if words else None
                if mean is None:
                    preds.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(mean))
                preds.append(langs[best])
                scores.append(float(1 / np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds), pa.array(scores)],
                                             [*batch.schema.names, "lang_pred", "lang_score"])
        return step
    return in_arrow(docs, task, schema)


def _by_joins(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The same by shuffles: the distinct words of the texts meet the words,
    the unseen ones' n-grams the n-grams, and the scored words the texts."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")

    def words_in(batches):
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), utf8(batch, "text"), strict=True):
                counts = Counter(filter(is_word, words_of(text)))
                keys = list(counts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(keys), pa.int64()), pa.array(keys, pa.string()),
                                                  pa.array([counts[k] for k in keys], pa.int64())], ["_row", "word", "times"])

    def grams_of(size):
        def run(batches):
            for batch in batches:
                pairs = [(w, g) for w in batch.column("word").to_pylist() for g in _grams(w, size)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([g for _, g in pairs], pa.string())],
                                                 ["word", "gram"])
        return run
    held = stored(rows.select("_row", "text").mapInArrow(words_in, "_row long, word string, times long"), "words-of-texts")
    entries = stored(model.entries(), "language-entries")
    seen = entries.filter("size = 0").select(F.col("key").alias("word"), "lang", "above")
    words = held.select("word").distinct()
    scored = [seen.join(words, "word")]
    left = stored(words.join(seen, "word", "left_anti"), "unseen-words")
    for size in SIZES:
        grams = left.mapInArrow(grams_of(size), "word string, gram string")
        known = entries.filter(F.col("size") == size).select(F.col("key").alias("gram"), "lang", "above")
        hits = stored(grams.join(known.select("gram").distinct(), "gram"), "grams-of-words")
        found = hits.groupBy("word").agg(F.count(F.lit(1)).alias("found"))
        means = hits.join(known, "gram").groupBy("word", "lang").agg(F.sum("above").alias("sum")).join(found, "word")
        scored.append(means.select("word", "lang", (F.col("sum") / F.col("found")).alias("above")))
        left = stored(left.join(found, "word", "left_anti"), "unseen-words")
    scores = scored[0]
    for more in scored[1:]:
        scores = scores.unionByName(more)
    sums = held.join(stored(scores, "word-scores"), "word").groupBy("_row", "lang").agg(F.sum(F.col("times") * F.col("above")).alias("sum"))
    each = F.array(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col("sum"))), F.lit(0.0)) for x in model.langs])
    totals = held.groupBy("_row").agg(F.sum("times").alias("words"))
    means = (totals.join(sums.groupBy("_row").agg(each.alias("sums")), "_row", "left")
             .withColumn("means", F.transform(F.coalesce("sums", F.array_repeat(F.lit(0.0), len(model.langs))), lambda x: x / F.col("words"))))
    best = F.array_max("means")
    share = 1 / F.aggregate("means", F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
    name = F.element_at(F.array(*[F.lit(x) for x in model.langs]), F.array_position("means", best).cast("int"))
    out = rows.join(means.select("_row", name.alias("lang_pred"), share.alias("lang_score")), "_row", "left")
    return out.select(*docs.columns, F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
                      F.coalesce("lang_score", F.lit(0.0)).alias("lang_score"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, lang_pred, score."""
    model = train(documents(spark, sf_dir, "doc_id", "text", "lang").filter(crc_fold() != 2))
    return (identify(documents(spark, sf_dir, "doc_id", "text"), model)
            .select("doc_id", (crc_fold() == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")))
