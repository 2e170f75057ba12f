"""Benchmark decontamination.

The distinct windows of the benchmark (``width`` consecutive words, or a whole
item of fewer) are numbered and kept as a table.  It is cut into blocks of at
most ``block_windows``; each block, words and numbers only, is broadcast to the
tasks as a hash set and the documents' word windows are scanned against it, batch
by batch, with no shuffle.  A hash hit is verified word by word before it
counts.  With several blocks, one at a time is read, broadcast, scanned and
released, so a benchmark of any size stays exact: it only takes more passes.

Which items have a window is a table of its own, (window, item), that neither
the driver nor a broadcast ever holds: it is joined with the sets of windows that
documents hit, each different set once, however many documents share it.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z:
runs of digits, letters and anything beyond ASCII.

Defined results:

* null or empty text, or text without words: no words, no hit, kept;
* an item without words, or null: no window; a null item_id: its windows
  still mark words, but it is not listed among the items;
* repeated items, and windows that several items share, however many: every
  item counts;
* repeated rows or ids of documents: each row has its own result;
* an empty benchmark: nothing is hit; an empty documents table: no rows;
* texts are scanned whole, whatever their length; extra columns are kept by
  ``decontaminate`` and never read.
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_arrow, small, stored, table, utf8

#: Words of a window.
WIDTH = 10
#: Windows in one broadcast block (about 100 bytes each, and their words once).
BLOCK_WINDOWS = 500_000

# Bytes that are no part of a word become spaces, A-Z become a-z.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A polynomial hash of every run of ``width`` ids."""
    n = len(ids) - width + 1
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= _STEP
        h += ids[j:j + n]
    return h ^ (h >> np.uint64(31))


class WindowSet:
    """The hash set of one block of numbered windows, as it is broadcast."""

    def __init__(self, windows: Iterable[tuple[list[bytes], int]]):
        self.word_id: dict[bytes, int] = {}
        by_width: dict[int, tuple[array, array]] = {}
        for words, number in windows:
            grams, numbers = by_width.setdefault(len(words), (array("Q"), array("q")))
            grams.extend(self.word_id.setdefault(bytes(w), len(self.word_id) + 1) for w in words)
            numbers.append(number)
        self.tables = []
        for width, (grams, numbers) in sorted(by_width.items()):
            rows = np.frombuffer(grams, np.uint64).reshape(-1, width)
            hashed = np.zeros(len(rows), np.uint64)
            for j in range(width):
                hashed *= _STEP
                hashed += rows[:, j]
            hashed ^= hashed >> np.uint64(31)
            order = np.argsort(hashed, kind="stable")
            self.tables.append((width, hashed[order], rows[order], np.frombuffer(numbers, np.int64)[order]))

    def scan(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, width, number) of every occurrence of a window in a
        sequence of word ids (0: a word that no window has)."""
        for width, hashed, grams, numbers in self.tables:
            if len(ids) < width:
                continue
            # A window of the set has no word 0, so only runs without one count.
            gaps = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(gaps[width:] == gaps[:-width])
            if not len(at):
                continue
            h = _hashes(ids, width)[at]
            lo, hi = np.searchsorted(hashed, h, "left"), np.searchsorted(hashed, h, "right")
            for i in np.flatnonzero(hi > lo):
                for k in range(lo[i], hi[i]):
                    if (ids[at[i]:at[i] + width] == grams[k]).all():  # the hit is verified on the words
                        yield int(at[i]), width, int(numbers[k])


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every window of the benchmark: words (array<binary>), item (the item_id as text)."""
    def task():
        def step(batch):
            words, items = [], []
            for item, text in zip(batch.column("item"), utf8(batch, "text"), strict=True):
                w = words_of(text)
                for i in range(max(1, len(w) - width + 1) if w else 0):
                    words.append(w[i:i + width])
                    items.append(item.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.binary())), pa.array(items, pa.string())],
                                             ["words", "item"])
        return step
    src = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return in_arrow(src, task, "words array<binary>, item string")


class Windows:
    """The benchmark's windows as stored tables: ``found`` (words, item) of
    all of them and ``numbered`` (window, words) of the distinct ones."""

    def __init__(self, benchmark: DataFrame, width: int = WIDTH):
        self.found = stored(windows(benchmark, width), "windows")
        distinct = self.found.select("words").distinct().withColumn("window", F.monotonically_increasing_id())
        self.numbered = stored(distinct, "numbered-windows")
        self.count = self.numbered.count()

    def items(self) -> DataFrame:
        """(window, item) of every item that has a window."""
        return self.found.filter("item IS NOT NULL").join(self.numbered, "words").select("window", "item").distinct()

    def blocks(self, most: int) -> Iterator[WindowSet]:
        """Hash sets of a bounded size, at least one; the driver holds one at a time."""
        rows = ((r["words"], r["window"]) for r in self.numbered.toLocalIterator())
        for _ in range(max(1, -(-self.count // most))):
            yield WindowSet(itertools.islice(rows, most))


SCAN_SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, windows array<long>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan_block(docs: DataFrame, shared, schema: str = SCAN_SCHEMA) -> DataFrame:
    """doc_id, n_words, spans and the numbers of the windows that occur."""
    def task():
        found = shared.value

        def step(batch):
            get = found.word_id.get
            n_words, spans, numbers = [], [], []
            for text in utf8(batch, "text"):
                w = words_of(text)
                n_words.append(len(w))
                ids = np.fromiter((get(x, 0) for x in w), np.uint64, len(w))
                hits = list(found.scan(ids)) if ids.any() else []
                spans.append(_merged(hits))
                numbers.append(sorted({n for _, _, n in hits}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS), pa.array(numbers, pa.list_(pa.int64()))],
                ["doc_id", "n_words", "spans", "windows"])
        return step
    return in_arrow(docs.select("doc_id", "text"), task, schema)


def _merged(hits: list[tuple[int, int, list]]) -> list[dict]:
    """Overlapping and adjoining windows as spans of word positions, both
    ends included."""
    out: list[dict] = []
    for at, width, _ in sorted(hits, key=lambda h: h[:2]):
        if out and at <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], at + width - 1)
        else:
            out.append({"first": at, "last": at + width - 1})
    return out


def _union_spans(lists: F.Column) -> F.Column:
    """Merge spans of several blocks; a list of spans is sorted first."""
    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1),
                          F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))))
        return F.when((F.size(acc) > 0) & (s["first"] <= last["last"] + 1), joined).otherwise(F.concat(acc, F.array(s)))
    kind = "array<struct<first:long,last:long>>"
    return F.aggregate(F.array_sort(F.flatten(lists)), F.array().cast(kind), add)


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (hit word positions,
    merged) and items (sorted item_ids with an occurring window).

    With one block (the usual case) the texts are read once, without a shuffle.
    With more, the passes are put together by (doc_id, text hash, row copy),
    carrying only the spans and numbers."""
    known = Windows(benchmark, width)
    if known.count <= block_windows:
        found = stored(_hit_windows(docs, next(known.blocks(block_windows))), "scanned")
    else:
        found = stored(_in_passes(docs, known, block_windows), "scanned")
    # Each different set of windows is looked up once.
    sets = found.select("windows").distinct().filter(F.size("windows") > 0)
    each = sets.select("windows", F.explode("windows").alias("window"))
    items = each.join(known.items(), "window").groupBy("windows").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = stored(items, "items-of-windows")
    return found.join(small(items), "windows", "left").select(
        "doc_id", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hit_windows(docs: DataFrame, block: WindowSet) -> DataFrame:
    return _scan_block(docs, docs.sparkSession.sparkContext.broadcast(block))


def _in_passes(docs: DataFrame, known: Windows, block_windows: int) -> DataFrame:
    # Rows are told apart by their content; equal rows have equal results.
    src = docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).alias("doc_id"), "text")
    schema = SCAN_SCHEMA.replace("doc_id long", "doc_id struct<doc_id:long,h:string>")
    parts, passes = None, 0
    for block in known.blocks(block_windows):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        one = stored(_scan_block(src, shared, schema), "scanned-block")
        shared.destroy()
        parts = one if parts is None else parts.unionByName(one)
        passes += 1
    merged = (parts.groupBy("doc_id")
              .agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows"), _union_spans(F.collect_set("spans")).alias("spans"),
                   F.array_sort(F.array_distinct(F.flatten(F.collect_set("windows")))).alias("windows")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), (F.col("rows") / passes).cast("long")))
    return merged.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "spans", "windows", copies.alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", width: int = WIDTH,
                  block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without what the benchmark holds; all columns stay.

    ``action="documents"`` drops every document with a hit,
    ``action="spans"`` cuts the hit words and what stands between them out
    of the text (documents stay).  Works row by row, so a dropped row is
    exactly a hit row; no shuffle, one pass per block (with several, each is
    written before the next)."""
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    known = Windows(benchmark, width)
    if known.count <= block_windows:
        return _clean_block(docs, docs.sparkSession.sparkContext.broadcast(next(known.blocks(block_windows))), action)
    out = docs
    for block in known.blocks(block_windows):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = stored(_clean_block(out, shared, action), "cleaned")
        shared.destroy()
    return out


def _clean_block(docs: DataFrame, shared, action: str) -> DataFrame:
    def task():
        found = shared.value

        def step(batch):
            place = batch.schema.get_field_index("text")
            keep, texts = [], []
            for text, value in zip(utf8(batch, "text"), batch.column(place), strict=True):
                w = words_of(text)
                hits = list(found.scan(np.fromiter((found.word_id.get(x, 0) for x in w), np.uint64, len(w))))
                keep.append(action == "spans" or not hits)
                texts.append(_cut(text, _merged(hits)) if hits and action == "spans" else value.as_py())
            if action == "spans":
                batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))
            yield batch.filter(pa.array(keep, pa.bool_()))
        return step
    return in_arrow(docs, task, docs.schema)


def _cut(text: bytes, spans: list[dict]) -> str:
    folded = text.translate(_FOLD)
    places, at = [], 0
    for w in folded.split():
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for s in spans:
        out.append(text[last:places[s["first"]][0]])
        last = places[s["last"]][1]
    return (b"".join(out) + text[last:]).decode("utf-8", "replace")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], width: int = WIDTH) -> list[tuple]:
    """The same by plain loops, for tests: (doc_id, n_words, n_hit, items digest)."""
    out = []
    for doc_id, text in docs:
        w = words_of((text or "").encode())
        hit, names = set(), set()
        for item, t in items:
            iw = words_of((t or "").encode())
            for i in range(max(1, len(iw) - width + 1) if iw else 0):
                g = iw[i:i + width]
                for p in range(len(w) - len(g) + 1):
                    if w[p:p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        if item is not None:
                            names.add(str(item))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return out
