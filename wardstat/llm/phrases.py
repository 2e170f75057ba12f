"""Phrase collocations from FM-indexes over word ids.

*Shards.*  Every task deals its documents to one open shard per language; a
shard is closed at ``SHARD_WORDS`` words and indexed in the task that holds it.
Pieces of a text never meet, so a long text may lie in several shards.
*Index.*  A shard is its sequence of word ids, id 0 between pieces.  Its
suffixes, sorted by their first words as deep as phrases go, give the
Burrows-Wheeler transform; the same over the reversed sequence makes the index
bidirectional.  A phrase is an interval of rows in either; the words in the
transform over an interval are the words that stand before (in the reversed
one: behind) the phrase, with their counts.  Extending an interval by one of
them is a rank in one transform and, in the other, a shift by the number of
lesser words.  All intervals of one length are extended at once.
*Sums.*  Counts of shards are added by one aggregate per phrase.

A phrase of ``LEAST`` occurrences holds only pairs of as many.  So the first
pass adds up words, and pairs as 64-bit hashes; the hashes that reach ``LEAST``
become a bit set of a bounded size (``SIEVE_BITS``), and the second pass
extends intervals only to pairs whose bit is set.  A clash of hashes or bits
lets a pair pass that the true sum then drops, so counts are exact at any size.

Defined results: a null text has no word; a null lang is ``und``; words are
taken over the whole text; repeated rows and rows of a null doc_id count each;
ties go by score, count, phrase; languages without a phrase have no row; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, give_back, small, small_batches, stored, utf8

#: Words of a shard, and pieces that are looked at before its size is.
SHARD_WORDS = 1_000_000
PIECES_AT_ONCE = 50_000
#: Largest size of the bit set (32 MB), and bits for each surviving pair.
SIEVE_BITS = 1 << 28
BITS_EACH = 32

LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer one has this share (in percent) of its count.
COVERED = 50
#: First-round groups of a language's ranking.
RANK_SALTS = 16

_STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(_STOPS + b"\t", b"\n" * len(_STOPS) + b" ")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Phrases(NamedTuple):
    """Phrases of one length: their word ids (a row each), the first rows of
    their intervals in the index and in the reversed index, and their counts."""

    words: np.ndarray
    low: np.ndarray
    low_reversed: np.ndarray
    count: np.ndarray

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(*(x[keep] for x in self))


class Half:
    """One direction: the transform, each word's first row, and ranks."""

    def __init__(self, text: np.ndarray, size: int, depth: int):
        padded = np.concatenate([text, np.zeros(depth - 1, text.dtype)])
        n = len(text)
        if size ** depth < 1 << 63:
            key = text.copy()
            for j in range(1, depth):
                key = key * size + padded[j:j + n]
            rows = np.argsort(key, kind="stable")
        else:
            rows = np.lexsort([padded[j:j + n] for j in reversed(range(depth))])
        self.bwt = text[rows - 1]
        self.counts = np.bincount(text, minlength=size)
        self.first = np.cumsum(self.counts) - self.counts
        self._step: np.ndarray | None = None

    @property
    def step(self) -> np.ndarray:
        """Row of the suffix that is longer by one word, for every row."""
        if self._step is None:
            self._step = np.empty(len(self.bwt), np.int64)
            self._step[np.argsort(self.bwt, kind="stable")] = np.arange(len(self.bwt))
        return self._step

    def rank(self, word: int, row: int) -> int:
        return int(np.count_nonzero(self.bwt[:row] == word))


class Index:
    """Bidirectional FM-index of word ids (0 ends a piece and the text)."""

    def __init__(self, ids: np.ndarray, size: int, depth: int = LONGEST):
        text = np.asarray(ids, np.int64)
        self.size = size
        self.forward, self.reversed = Half(text, size, depth), Half(text[::-1], size, depth)

    def single(self) -> Phrases:
        half = self.forward
        words = np.flatnonzero(half.counts[1:]) + 1
        return Phrases(words[:, None], half.first[words], half.first[words], half.counts[words])

    def extended(self, phrases: Phrases, left: bool, again: bool = True) -> Phrases:
        """All extensions by one word on a side.  Without ``again`` the
        interval on that side, which only another extension there needs, is
        not worked out."""
        half = self.forward if left else self.reversed
        low, other = (phrases.low, phrases.low_reversed) if left else (phrases.low_reversed, phrases.low)
        begins = np.cumsum(phrases.count) - phrases.count
        owner = np.repeat(np.arange(len(low)), phrases.count)
        rows = np.arange(len(owner)) + np.repeat(low - begins, phrases.count)
        key = owner * self.size + half.bwt[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(at, append=len(key))
        owner, word = key[at] // self.size, key[at] % self.size
        lesser = at - begins[owner]  # rows of the interval with a lesser word (or the end of a piece) there
        inner = half.step[rows[order[at]]] if again else np.full(len(at), -1)
        outer = other[owner] + lesser
        words = phrases.words[owner]
        words = np.column_stack([word, words] if left else [words, word])
        return Phrases(words, *((inner, outer) if left else (outer, inner)), count).where(word > 0)

    def neighbours(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences with a word before them, and behind them, in their piece."""
        out = []
        for half, low in ((self.forward, phrases.low), (self.reversed, phrases.low_reversed)):
            ends = np.concatenate([[0], np.cumsum(half.bwt == 0)])
            out.append(phrases.count - (ends[low + phrases.count] - ends[low]))
        return out[0], out[1]

    def find(self, words: list[int]) -> tuple[int, int]:
        """Rows [begin, end) of a phrase, by backward search."""
        low, high = 0, len(self.forward.bwt)
        for w in reversed(words):
            low, high = (int(self.forward.first[w]) + self.forward.rank(w, x) for x in (low, high))
        return low, high


class Shard:
    """A language's open shard: words numbered in order of appearance."""

    def __init__(self, lang: str):
        self.lang, self.ids = lang, []
        self.numbers: defaultdict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.numbers[b"\n"] = 0

    def add(self, pieces: list[bytes]) -> None:
        words = []
        for piece in pieces:
            own = piece.split()
            if own:
                words += own
                words.append(b"\n")
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))

    def __len__(self) -> int:
        return sum(map(len, self.ids))

    def index(self, depth: int) -> Index:
        return Index(np.concatenate(self.ids), len(self.numbers), depth)

    def names(self) -> pa.Array:
        return pa.array(list(self.numbers), pa.binary())

    def hashes(self) -> np.ndarray:
        seed = zlib.crc32(self.lang.encode())
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.numbers), np.uint64, len(self.numbers))


def pair_hashes(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(hashes[left] * _M1 + hashes[right] * _M2)


def _spelled(names: pa.Array, words: np.ndarray) -> pa.Array:
    parts = [names.take(pa.array(words[:, j])) for j in range(words.shape[1])]
    out = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, b" ")
    return out.cast(pa.string())


def _over_shards(docs: DataFrame, emit, schema: str, shard_words: int) -> DataFrame:
    """``emit(shard)`` (record batches) of every shard of (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shards: dict[str, Shard] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text"), strict=True):
                pieces = text.lower().translate(_FOLD).split(b"\n")
                for at in range(0, len(pieces), PIECES_AT_ONCE):
                    shard = open_shards.get(lang) or open_shards.setdefault(lang, Shard(lang))
                    shard.add(pieces[at:at + PIECES_AT_ONCE])
                    if len(shard) >= shard_words:
                        yield from emit(open_shards.pop(lang))
        for shard in open_shards.values():
            if len(shard):
                yield from emit(shard)
        del open_shards
        give_back()
    langs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return small_batches(langs).mapInArrow(run, schema)


def ngrams(docs: DataFrame, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, phrase, count, lefts and rights (occurrences with a word before
    and behind them in their piece) of every phrase of up to ``longest`` words."""
    def emit(shard: Shard):
        index, names = shard.index(longest), shard.names()
        level = index.single()
        for k in range(longest):
            if k:
                level = index.extended(level, left=k % 2 == 0)
            lefts, rights = index.neighbours(level)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.lang] * len(level.count), pa.string()), _spelled(names, level.words), pa.array(level.count),
                 pa.array(lefts), pa.array(rights)], ["lang", "phrase", "count", "lefts", "rights"])
    rows = _over_shards(docs, emit, "lang string, phrase string, count long, lefts long, rights long", shard_words)
    return rows.groupBy("lang", "phrase").agg(*[F.sum(c).alias(c) for c in ("count", "lefts", "rights")])


def words_and_pairs(docs: DataFrame, least: int, shard_words: int) -> DataFrame:
    """First pass: (lang, word, null, n) of all words, and (null, null, pair,
    n) of the hashes of pairs that reach ``least``."""
    def emit(shard: Shard):
        index = shard.index(2)
        level = index.single()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard.lang] * len(level.count), pa.string()), _spelled(shard.names(), level.words),
             pa.nulls(len(level.count), pa.int64()), pa.array(level.count)], ["lang", "word", "pair", "n"])
        level = index.extended(level, left=False, again=False)
        pairs = pair_hashes(shard.hashes(), level.words[:, 0], level.words[:, 1])
        none = pa.nulls(len(pairs), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(pairs.view(np.int64)), pa.array(level.count)],
                                         ["lang", "word", "pair", "n"])
    rows = _over_shards(docs, emit, "lang string, word string, pair long, n long", shard_words)
    return rows.groupBy("lang", "word", "pair").agg(F.sum("n").alias("n")).filter(
        F.col("pair").isNull() | (F.col("n") >= least))


def sieve(pairs: DataFrame, most: int = SIEVE_BITS) -> np.ndarray:
    """A bit set of the hashes in ``pairs``, of at most ``most`` bits."""
    wanted = min(most, max(1 << 12, BITS_EACH * pairs.count()))
    bits = 1 << (wanted.bit_length() - 1)
    place = F.col("pair").bitwiseAND(F.lit(bits - 1))
    words = pairs.groupBy(F.shiftright(place, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pair & 63 AS INT))")).alias("set")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[np.asarray(words.column("at"))] = np.asarray(words.column("set")).view(np.uint64)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def phrase_counts(docs: DataFrame, bits: np.ndarray, longest: int, least: int, shard_words: int) -> DataFrame:
    """Second pass: (lang, phrase, words, a) of the phrases of 2 to
    ``longest`` words with ``least`` occurrences."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bits)

    def emit(shard: Shard):
        index, names, hashes, known = shard.index(longest), shard.names(), shard.hashes(), shared.value
        level = index.single()
        for k in range(2, longest + 1):
            # Sides alternate, so the side just taken is needed again two lengths on.
            left = k % 2 == 1
            level = index.extended(level, left, again=k + 2 <= longest)
            new = level.words[:, :2] if left else level.words[:, -2:]
            level = level.where(passes(known, pair_hashes(hashes, new[:, 0], new[:, 1])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.lang] * len(level.count), pa.string()), _spelled(names, level.words),
                 pa.array(np.full(len(level.count), k, np.int32)), pa.array(level.count)], ["lang", "phrase", "words", "n"])
    rows = _over_shards(docs, emit, "lang string, phrase string, words int, n long", shard_words)
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


#: Exact up to counts of 15 digits: 38 digits hold 1000000 * a * a, and
#: ``div`` of whole decimals drops the fraction.
SCORE = ("CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))"
         " div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS BIGINT)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED,
                 shard_words: int = SHARD_WORDS, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top``
    phrases of 2 to ``longest`` words."""
    docs = docs.select("lang", "text")
    first = stored(words_and_pairs(docs, least, shard_words), "words-and-pairs")
    words = first.filter("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    bits = sieve(first.filter("pair IS NOT NULL").select("pair"), sieve_bits)
    found = stored(phrase_counts(docs, bits, longest, least, shard_words), "phrases")
    # Every way to cut a candidate in two, and the counts of the parts: words, or
    # shorter candidates (a part has as many occurrences as the whole, or more).
    parts = F.split("phrase", " ")
    cuts = found.filter("words > 1").select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), parts.alias("w"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    needed = (cuts.select("lang", F.explode(F.array("head", "tail")).alias("phrase")).distinct())
    counts = stored(words.unionByName(found.select("lang", "phrase", "a")).join(needed, ["lang", "phrase"]), "part-counts")
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tail = counts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    scored = (cuts.join(small(head), ["lang", "head"]).join(small(tail), ["lang", "tail"])
              .withColumn("score", F.expr(SCORE)))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The shorter phrases inside each candidate, with the highest count of one that holds them.
    inside = found.filter("words > 2").select(
        "lang", "a", parts.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inside = inside.select("lang", "a", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    holders = inside.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = best.join(holders, ["lang", "phrase"], "left").filter(
        F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # Ranked in two rounds, so that no task sorts all phrases of a language.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))
    rows = (rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .filter(F.col("rank") <= top).drop("rank", "salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language its first 2000 phrases: rank, phrase, a, l, r, n, score."""
    return collocations(documents(spark, sf_dir, "lang", "text"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
runs AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
f AS MATERIALIZED (
  SELECT lang, 1 AS words, phrase, count(*) AS a FROM (SELECT lang, unnest(w) AS phrase FROM runs) GROUP BY ALL
  UNION ALL
  SELECT lang, 2, phrase, count(*) FROM (
    SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM runs) GROUP BY ALL
  UNION ALL
  SELECT lang, 3, phrase, count(*) FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase
    FROM runs) GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND a >= 10),
each AS (SELECT lang, phrase, a, w, unnest(range(1, words)) AS k FROM c),
cuts AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail FROM each),
scored AS (
  SELECT cuts.*, h.a AS l, t.a AS r, 1000000::HUGEINT * cuts.a * cuts.a // (h.a::HUGEINT * t.a) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN f t ON t.lang = cuts.lang AND t.phrase = cuts.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
holders AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE words = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE words = 3) GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank,
         best.phrase, a, l, r, n, score::BIGINT AS score
  FROM best JOIN totals ON totals.lang = best.lang
  LEFT JOIN holders ON holders.lang = best.lang AND holders.phrase = best.phrase
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT * FROM ranked WHERE rank <= 2000
"""
