"""Near-duplicate documents by circulant MinHash.

*Sets.*  A document is the set of its distinct word shingles (64-bit hashes).
*Signatures.*  Two permutations make all coordinates (C-MinHash, Li and Li
2022): the first, a mixing of the shingle hash onto a circle of ``CIRCLE``
places, scatters the set once; the second, a fixed permutation of the circle, is shifted by one
place for every coordinate, and a coordinate is the least shifted value over
the set.  A shingle's values for all coordinates stand side by side in the
permutation, so a signature is one gather and one minimum.
*Classes.*  Documents with the same set are one class; only its least doc_id
goes on, so thousands of copies cost one row.
*Bands.*  ``ROWS`` coordinates make a band; documents that share a band's
bucket are candidates.  A bucket never emits its pairs: every member is
compared with one member that the bucket elects (the one with the least hash),
and what that joins is contracted by connected components.
*The rest, exactly.*  Buckets that still hold several components compare
members of different components only, by long one-byte signatures, in cells
of two blocks of at most about ``BLOCK`` 64-bit numbers, so a bucket of any size is
split over tasks.  A pair is looked at only in the first band it shares, and
only pairs whose estimate is within ``SLACK`` standard deviations of the
threshold are candidates.  A cell hands on a spanning forest of its candidates,
the likeliest pairs first: never more pairs than members.  Where one of them
fails, the cell is decided inside its task on the full sets, component by
component, and hands on a spanning forest of the links.
*Verification.*  Every link is decided on the two full sets.

There are as many bands as it takes for a link at the threshold to miss all
of them with a probability below ``MISS``.

Defined results: null or empty text, or text without words, has an empty set
and no link; a text of fewer words than a shingle is one shingle; rows of a null
doc_id have no link and no component, and are kept; rows that repeat a doc_id
are counted each by its own text, and classes with the same least doc_id are
one node, so what one of its rows is linked with, such a document is; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memory, documents, in_arrow, small, stored, utf8
from .components import components

ROWS = 5
MISS = 1e-6
#: Places of the circle, and the seed of its permutation.
CIRCLE = 1 << 20
SEED = 11
#: Coordinates of the long signature that sorts out candidates of mixed buckets.
LONG = 1024
SLACK = 4.5
#: Weight of a block: shingles and signatures, in 64-bit numbers (4 MB).
BLOCK = 1 << 19
MEMORY_WORDS = 200_000

SHINGLE = 3
#: Similarity as a whole ratio: a link has ``100 * common >= PERCENT * union``.
PERCENT = 85

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, Memory(MEMORY_WORDS)

    def __call__(self, text: bytes) -> np.ndarray:
        # bytes.lower maps A-Z only and bytes.split cuts at [\x20\x09-\x0D].
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.known.ready(set(words), xxhash.xxh64_intdigest), words), np.uint64, len(words))
        n = max(1, len(w) - self.size + 1)
        h = np.full(n, min(len(w), self.size), np.uint64)
        for j in range(min(self.size, len(w))):
            h = _mix(h * _M1 + w[j:j + n] * _M2 + _M3)
        return np.unique(h)


_circles: dict[int, np.ndarray] = {}


def _values(coordinates: int) -> np.ndarray:
    """Row p: the values of circle place p under every shift."""
    if coordinates not in _circles:
        places = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.uint32)
        wrapped = np.concatenate([places, places[:coordinates]])
        _circles[coordinates] = np.lib.stride_tricks.sliding_window_view(wrapped, coordinates)
    return _circles[coordinates]


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """The coordinates of a set, in pieces of a bounded size."""
    at = (shingles * _M3 >> np.uint64(44)).astype(np.int64)  # the first permutation: onto the circle
    values = _values(coordinates)
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(out, values[at[i:i + 4096]].min(0), out=out)
    return out


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def _bands(sig: np.ndarray, bands: int) -> list[int]:
    return [xxhash.xxh64_intdigest(sig[b * ROWS:(b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(bands)]


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"


def signatures(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest of the set, and a bucket hash per band."""
    n_bands = bands_for(percent)

    def task():
        shingles = Shingler(shingle)

        def step(batch):
            sizes, digests, bands = [], [], []
            for text in utf8(batch, "text"):
                s = shingles(text)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(_bands(signature(s, ROWS * n_bands), n_bands) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])
        return step
    return in_arrow(docs.select("doc_id", "text"), task, SIGNED)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, set (array<long>), bands and long signature of the classes in
    ``wanted`` (id, digest).  The short signature is the beginning of the long one.  A row is taken by its doc_id and, for ids that repeat, by its set."""
    rows = docs.select("doc_id", "text").join(small(wanted.select(F.col("id").alias("doc_id"), "digest")), "doc_id")
    n_bands = bands_for(percent)

    def task():
        shingles = Shingler(shingle)

        def step(batch):
            ids, sets, bands, longs = [], [], [], []
            for doc_id, digest, text in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist(),
                                            utf8(batch, "text"), strict=True):
                s = shingles(text)
                if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == digest:
                    ids.append(doc_id)
                    sets.append(s.view(np.int64))
                    sig = signature(s, LONG)
                    bands.append(_bands(sig, n_bands))
                    longs.append(sig.astype(np.uint8).tobytes())
            if ids:
                flat = pa.array(np.concatenate(sets))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat),
                                                  pa.array(bands, pa.list_(pa.int64())), pa.array(longs, pa.binary())],
                                                 ["id", "shingles", "bands", "long"])
        return step
    return in_arrow(rows, task, "id long, shingles array<long>, bands array<long>, long binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("src"), F.col("shingles").alias("s"))
    b = sets.select(F.col("id").alias("dst"), F.col("shingles").alias("d"))
    # The shorter set has to hold percent/100 of the longer one, or no overlap suffices.
    met = small(pairs).join(a, "src").join(b, "dst").filter(
        100 * F.least(F.size("s"), F.size("d")) >= percent * F.greatest(F.size("s"), F.size("d")))
    common = F.size(F.array_intersect("s", "d"))
    return met.select("src", "dst", common.alias("c"), (F.size("s") + F.size("d")).alias("both")).filter(
        100 * F.col("c") >= percent * (F.col("both") - F.col("c"))).select("src", "dst")


def _cells(members: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """bucket, i, j, odd, id, component, main: the members of buckets that
    hold several components, dealt to cells of bounded weight, so that every pair
    across components meets in one cell of each bucket that it shares."""
    named = (members.join(small(labels), members["id"] == labels["node"], "left")
             .select("bucket", "id", F.coalesce("component", "id").alias("component")).join(sizes, "id"))
    # The heaviest component of a bucket need not meet itself, nor be split against itself.
    weight = F.col("n_shingles") + F.lit(LONG // 8)
    per = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))
    mixed = (per.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.sum("weight").alias("weight"),
                                       F.max_by("component", F.struct("weight", "component")).alias("main"), F.max("weight").alias("most"))
             .filter((F.col("parts") > 1) & (F.col("n") > 2)))
    blocks = lambda w: F.greatest(F.ceil(w / BLOCK), F.lit(1)).cast("int")
    mixed = mixed.select("bucket", "main", blocks(F.col("weight") - F.col("most")).alias("across"), blocks(F.col("weight")).alias("down"))
    rows = named.select("bucket", "id", "component").join(mixed, "bucket")
    # A member outside the main component goes, as a row of the block, to every
    # block of all members, and every member to every block of such rows.
    i = F.pmod(F.xxhash64("id"), F.col("across")).cast("int")
    j = F.pmod(F.xxhash64("id"), F.col("down")).cast("int")
    left = (rows.filter(F.col("component") != F.col("main"))
            .select("*", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("j"), F.lit(True).alias("odd")))
    right = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("odd"))
    return left.unionByName(right).select("bucket", "i", "j", "odd", "id", "component", "main")


class Forest:
    """Components of a cell's members, by union."""

    def __init__(self, components: np.ndarray):
        _, at = np.unique(components, return_inverse=True)
        self.of, self.up = at.tolist(), list(range(int(at.max()) + 1 if len(at) else 0))

    def root(self, member: int) -> int:
        up, x = self.up, self.of[member]
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _candidates(cell: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (rows of the cell) whose signatures agree in ``least`` places or
    more, the best first: each pair in the first band that it shares only."""
    odd = np.asarray(cell.column("odd").combine_chunks().cast(pa.uint8())).astype(bool)
    ids, comps = np.asarray(cell.column("id")), np.asarray(cell.column("component"))
    bucket, main = cell.column("bucket")[0].as_py(), cell.column("main")[0].as_py()
    bands = np.array(cell.column("bands").to_pylist(), np.int64)
    sig = np.frombuffer(b"".join(cell.column("long").to_pylist()), np.uint8).reshape(-1, LONG)
    at = np.flatnonzero(~odd)
    band = int(np.argmax((bands == bucket).all(0)))
    src, dst, same = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in np.flatnonzero(odd):
        others = at[comps[at] != comps[k]]
        # Two members outside the main component meet twice: the lesser asks.
        others = others[~((comps[others] != main) & (ids[others] <= ids[k]))]
        if band:  # pairs that share an earlier band are looked at there
            others = others[~(bands[others, :band] == bands[k, :band]).any(1)]
        alike = (sig[others] == sig[k]).sum(1)
        near = alike >= least
        src.append(np.full(int(near.sum()), k))
        dst.append(others[near])
        same.append(alike[near])
    src, dst, same = map(np.concatenate, (src, dst, same))
    order = np.argsort(-same, kind="stable")
    return src[order], dst[order], same[order]


def _edges(cell: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
    ids = np.asarray(cell.column("id"))
    ends = ids[np.array(pairs, np.int64).reshape(-1, 2)]
    n = len(pairs)
    return pa.table({"bucket": pa.array([cell.column("bucket")[0].as_py()] * n, pa.int64()),
                     "i": pa.array([cell.column("i")[0].as_py()] * n, pa.int32()), "j": pa.array([cell.column("j")[0].as_py()] * n, pa.int32()),
                     "src": pa.array(ends.min(1) if n else [], pa.int64()), "dst": pa.array(ends.max(1) if n else [], pa.int64())})


EDGES = "bucket long, i int, j int, src long, dst long"


def _least(percent: int) -> int:
    share = percent / 100
    return int((share - SLACK * math.sqrt(share * (1 - share) / LONG)) * LONG)


def _likely_edges(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the components of every cell by its candidate
    pairs, the likeliest first: fewer edges than members."""
    least = _least(percent)

    def compare(cell: pa.Table) -> pa.Table:
        src, dst, _ = _candidates(cell, least)
        forest = Forest(np.asarray(cell.column("component")))
        return _edges(cell, [(a, b) for a, b in zip(src.tolist(), dst.tolist(), strict=True) if forest.join(a, b)])
    return cells.join(sets.select("id", "bands", "long"), "id").groupBy("bucket", "i", "j").applyInArrow(compare, EDGES)


def _exact_edges(cells: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of every cell's links, decided on the full sets, over
    the components known so far: what is connected is not compared again."""
    least = _least(percent)
    now = cells.join(small(labels), cells["id"] == labels["node"], "left").drop("node").withColumnRenamed("_now", "now")
    now = now.withColumn("now", F.coalesce("now", "id"))

    def decide(cell: pa.Table) -> pa.Table:
        src, dst, _ = _candidates(cell, least)
        column = cell.column("shingles").combine_chunks()
        flat, ends = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
        own = lambda k: flat[ends[k]:ends[k + 1]]
        forest, found = Forest(np.asarray(cell.column("now"))), []
        for a, b in zip(src.tolist(), dst.tolist(), strict=True):
            if forest.root(a) == forest.root(b):
                continue
            x, y = sorted((own(a), own(b)), key=len)
            if 100 * len(x) < percent * len(y):
                continue
            x, y = x.view(np.uint64), y.view(np.uint64)  # sorted as unsigned numbers
            place = np.searchsorted(y, x)
            common = int((y[np.minimum(place, len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                forest.join(a, b)
                found.append((a, b))
        return _edges(cell, found)
    return now.join(sets, "id").groupBy("bucket", "i", "j").applyInArrow(decide, EDGES)


def _mixed_links(members: DataFrame, links: DataFrame, sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Links that connect what is linked across the components inside
    buckets.  First the likeliest pairs are decided, as few as connect each
    cell's candidates; a cell whose pairs all hold is done.  Cells with a pair that
    failed are decided on the full sets."""
    cells = stored(_cells(members, components(links), sizes), "cells")
    likely = stored(_likely_edges(cells, sets, percent), "likely-edges")
    pairs = stored(likely.select("src", "dst").distinct().join(links, ["src", "dst"], "left_anti"), "likely-pairs")
    held = stored(_linked(pairs, sets, percent), "links")
    known = links.unionByName(held)
    failed = likely.join(known, ["src", "dst"], "left_anti").select("bucket", "i", "j").distinct()
    failed = stored(failed, "open-cells")
    labels = components(known).select("node", F.col("component").alias("_now"))
    rest = stored(_exact_edges(cells.join(small(failed), ["bucket", "i", "j"]), labels, sets, percent), "exact-edges")
    return held.unionByName(rest.select("src", "dst"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over
    links, its own if there is none) and kept (whether it is that one)."""
    docs = docs.select("doc_id", "text")
    signed = stored(signatures(docs, shingle, percent), "signatures")
    # Classes of equal sets; a class is named by its least doc_id.
    real = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(real.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"),
                                                F.first("n_shingles").alias("n_shingles")), "classes")
    entries = classes.select("id", F.explode("bands").alias("bucket"))
    elected = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"]
    buckets = (entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), elected.alias("chosen"))
               .filter("n > 1").select("bucket", "chosen"))
    members = stored(entries.join(buckets, "bucket"), "bucket-members")
    pairs = stored(members.filter("id != chosen")
                   .select(F.least("id", "chosen").alias("src"), F.greatest("id", "chosen").alias("dst")).distinct(), "pairs")
    wanted = stored(members.select("id").distinct().join(classes.select("id", "digest"), "id"), "wanted")
    found = _sets(docs, wanted, shingle, percent)
    if not real.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = found.dropDuplicates(["id"])  # only where ids repeat, as this moves the sets
    sets = stored(found, "sets")
    links = stored(_linked(pairs, sets, percent), "links")
    # Classes with the same least doc_id are one member.
    sizes = classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    rest = _mixed_links(members.select("bucket", "id").distinct(), links, sets, sizes, percent)
    labels = stored(components(links.unionByName(rest)), "components")
    named = classes.join(labels, classes["id"] == labels["node"], "left").select(
        "digest", F.coalesce("component", "id").alias("component"))
    out = signed.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each group left, by the result of
    ``near_duplicates``.  Rows of one doc_id stay or go together: they go if
    none of them is kept."""
    gone = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept")
    return docs.join(small(stored(gone.select("doc_id"), "near-duplicates")), "doc_id", "left_anti")


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_shingles, component_id, kept."""
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def brute_force(docs: list[tuple], shingle: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """All pairs by plain sets, for tests."""
    sets = {}
    for doc_id, text in docs:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), root(d), root(d) == d) for d in ids]
