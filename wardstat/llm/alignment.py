"""Alignment of two tokenizers' tokens over the same bytes.

Side A is a byte-level BPE file of the tokenizers library, side B a
SentencePiece model.  Both tokenise a text with one space before it (B's
model adds that space itself).

*Coarse cuts.*  A's tokens come with character offsets, B's with the spans of
the library's proto.  Where a token's own bytes fill its span, the span's end
is its end.
*Refinement.*  Tokens that split a multibyte character (A's partial
characters, B's byte-fallback pieces) share that character's offsets; they are
cut inside it by the length of their decoded bytes, which always decide.
*Groups.*  Byte offsets where both sides end a token cut the tokens into
groups; the two tokens that end there are a link.
*Counts.*  A pair of ids is counted over all documents by one aggregate with
partial sums; the counts go back to the documents by a join (broadcast within
``common.BROADCAST_ROWS`` pairs, else a shuffle that AQE splits where a pair is
hot), and a document's links meet in a partial sum before they are shuffled.

Where neither side can join characters across a space (A pre-tokenises with
the byte-level pattern; no piece of B has a U+2581 behind another character)
or from a letter to a stop (A: the same; no piece of B has the two side by
side), the stretches between are aligned on their own and remembered: exact, and
several times faster.  Other tokenizers are run text by text.

Defined results: a text that is null, empty, or whose bytes either side does
not give back (U+2581 in the text, a normalising model) has no tokens: zeros
and an empty groups column; special tokens' strings are plain text; texts are
taken whole; repeated rows and rows of a null doc_id are counted each; ties for
a B id's highest count are all best; an empty table gives no rows; other
columns are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memory, documents, in_arrow, small, stored, utf8
from .pieces import SPACE, PieceModel

#: Stretches remembered by a worker, and the longest one that is.
MEMORY_STRETCHES = 1_400_000
MEMORY_BYTES = 48
LETTERS, STOPS = "A-Za-z", ".,;:!?"
#: Every cut is behind a character that is no white space and before a space,
#: or behind a letter and before a stop.
_STRETCH = re.compile(f" ?[{LETTERS}]+(?=[{STOPS} ])|[{STOPS}]+(?= )|" r" *[^ ]+(?:(?<=\s) +[^ ]*)*| +")
#: What a piece may not hold if texts are to be cut there.
_JOINED = re.compile(f"[{LETTERS}][{STOPS}]|[^{SPACE}]{SPACE}")


def _alphabet() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def _without_prefix(path: str):
    """The model without the space that it would put before a text: the texts
    here bring theirs along."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2
    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    model.normalizer_spec.add_dummy_prefix = False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


class Stretch(NamedTuple):
    """What is remembered of a stretch: its groups' text, the linked pairs as
    bytes, and the numbers of A's (upper 32 bits) and B's tokens."""

    groups: str
    pairs: bytes
    tokens: int


def refine(spans: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the ends of their spans, cut by the running
    length of the decoded bytes (``own``) where a span holds more than one
    token of a character."""
    split = spans != own
    return np.where(split, own, spans) if split.any() else spans


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _alphabet()
        self.a_bytes = {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
                        for token, i in self.a.get_vocab().items()}
        model = PieceModel(path_b)
        self.b = _without_prefix(path_b)
        names = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(names)]
        self.prefixed = model.normalizer.prefix and not model.normalizer.suffix
        steps = spec.get("pre_tokenizer") or {}
        self.by_stretch = (model.by_word and not any(map(_JOINED.search, names)) and spec.get("normalizer") is None and steps.get("type") == "ByteLevel"
                           and steps.get("use_regex", True) and not steps.get("add_prefix_space")
                           and not spec["model"].get("dropout") and all(t["special"] for t in spec["added_tokens"]))
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.known = Memory(MEMORY_STRETCHES)

    def ends(self, texts: list[str]) -> tuple[list[int], np.ndarray, list[int], np.ndarray, np.ndarray] | None:
        """A's ids and their byte ends, B's, and the ends of the texts, all
        over the joined texts, or None if a side does not give the bytes of
        one of them back."""
        data = "".join(texts).encode()
        a_side = self.a.encode_batch(texts, add_special_tokens=False)
        b_side = [p.pieces for p in self.b.encode(texts, return_type="proto", num_threads=1)]
        a_ids, b_ids = [i for e in a_side for i in e.ids], [p.id for pieces in b_side for p in pieces]
        a_own, b_own = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        text_ends = np.cumsum([len(t) for t in texts] if len(data) == sum(map(len, texts)) else [len(t.encode()) for t in texts])
        begins = text_ends - np.diff(text_ends, prepend=0)
        # Every text has to end where its tokens do, with the same bytes.
        for ids, own, side, name in ((a_ids, a_own, [e.ids for e in a_side], self.a_bytes), (b_ids, b_own, b_side, self.b_bytes)):
            last = np.cumsum([len(x) for x in side]) - 1
            if not ids or (last < 0).any() or not np.array_equal(own[last], text_ends) or b"".join(map(name.__getitem__, ids)) != data:
                return None
        chars = np.array([end for e in a_side for _, end in e.offsets])
        first = np.repeat(begins, [len(e) for e in a_side])
        if all(map(str.isascii, texts)):
            a_spans = first + chars
        else:
            starts = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
            a_spans = starts[np.searchsorted(starts, first) + chars]
        b_spans = np.repeat(begins, list(map(len, b_side))) + np.array([p.end for pieces in b_side for p in pieces])
        return a_ids, refine(a_spans, a_own), b_ids, refine(b_spans, b_own), text_ends

    def _many(self, texts: list[str]) -> list[Stretch | bool]:
        if not texts:
            return []
        found = self.ends(texts) if self.prefixed else None
        if found is None:
            half = len(texts) // 2
            return self._many(texts[:half]) + self._many(texts[half:]) if half else [False]
        a_ids, a_ends, b_ids, b_ends, text_ends = found
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        k, m = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        pairs = np.array(a_ids)[k - 1] << 32 | np.array(b_ids)[m - 1]
        last = np.searchsorted(cuts, text_ends) + 1
        tokens = np.diff(k[last - 1], prepend=0) << 32 | np.diff(m[last - 1], prepend=0)
        a_names, b_names = list(map(str, a_ids)), list(map(str, b_ids))
        groups, i, j = [], 0, 0
        for k_, m_ in zip(k.tolist(), m.tolist(), strict=True):
            groups.append(f"{','.join(a_names[i:k_])}|{','.join(b_names[j:m_])}")
            i, j = k_, m_
        out, g = [], 0
        for end, n in zip(last.tolist(), tokens.tolist(), strict=True):
            out.append(Stretch(";".join(groups[g:end]), pairs[g:end].astype("<i8").tobytes(), n))
            g = end
        return out

    def stretches(self, texts: list[str]) -> list[list[Stretch] | None]:
        """The aligned stretches of every text, None for one without tokens."""
        split = _STRETCH.findall if self.by_stretch else lambda text: [text]
        parts = [split(" " + text) if text and SPACE not in text else [] for text in texts]
        wanted = {p for own in parts for p in own}
        rare = [p for p in wanted if not self.by_stretch or len(p) > MEMORY_BYTES]
        wanted.difference_update(rare)
        get = self.known.ready(wanted, many=self._many)
        if rare:
            long = {}
            for p in rare:  # one by one: each may be a whole long text
                long[p] = self._many([p])[0]
            known = get
            get = lambda p: long[p] if p in long else known(p)
        found = [list(map(get, own)) for own in parts]
        return [own if own and all(own) else None for own in found]

    def cuts(self, groups: str) -> bytes:
        """Byte ends of the groups, from A's ids."""
        sizes = [sum(len(self.a_bytes[int(i)]) for i in g.partition("|")[0].split(",")) for g in groups.split(";")]
        return np.cumsum(sizes).astype("<u8").tobytes()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, kept by the worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
GROUPS = "groups string, cuts binary"


def align_documents(docs: DataFrame, path_a: str, path_b: str, full: bool = True) -> DataFrame:
    """Per row: the numbers of tokens and groups, the digest of the groups,
    the distinct linked pairs (A's id shifted left by 32, or B's id) and how
    often each is linked there; with ``full`` also the groups' text and
    ``cuts``, their ends as little-endian unsigned 64-bit byte offsets of
    space + text.  No shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
                        *([("groups", pa.string()), ("cuts", pa.binary())] if full else [])])

    def task():
        both = aligner(path_a, path_b)

        def row(doc_id, parts):
            if parts is None:
                return (doc_id, 0, 0, 0, "", [], []) + ("", b"") * full
            groups = ";".join([p.groups for p in parts])
            links = np.frombuffer(b"".join([p.pairs for p in parts]), "<i8")
            pairs, times = np.unique(links, return_counts=True)
            tokens = sum([p.tokens for p in parts])
            out = (doc_id, tokens >> 32, tokens & 0xFFFFFFFF, len(links),
                   hashlib.sha256(groups.encode()).hexdigest(), pairs, times.astype(np.int32))
            return out + (groups, both.cuts(groups)) if full else out

        def step(batch):
            texts = [t.decode("utf-8", "replace") for t in utf8(batch, "text")]
            rows = [row(*x) for x in zip(batch.column("doc_id").to_pylist(), both.stretches(texts), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                                 schema=schema)
        return step
    return in_arrow(docs.select("doc_id", "text"), task, f"{ALIGNED}, {GROUPS}" if full else ALIGNED)


def pair_links(aligned: DataFrame) -> DataFrame:
    """pair, links (all over the corpus) and best (whether no other pair of
    that B id has more) from stored rows of ``align_documents``."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    links = stored(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("links")), "pair-links")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    most = links.groupBy(b).agg(F.max("links").alias("most"))
    return links.withColumn("b", b).join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, links: DataFrame, bound: int | None = None) -> DataFrame:
    """Per row of ``aligned`` (stored) its numbers and n_links, n_best, count_sum."""
    keep = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    each = aligned.select("row", *keep, F.explode_outer(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", *keep, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    met = each.join(small(links) if bound is None else small(links, bound), "pair", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return met.groupBy("row", *keep).agg(
        total("times").alias("n_links"), total(F.when(F.col("best"), F.col("times"))).alias("n_best"),
        total(F.col("times") * F.col("links")).alias("count_sum")).drop("row")


def aligned_counts(docs: DataFrame, path_a: str, path_b: str, bound: int | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    rows = stored(align_documents(docs, path_a, path_b, full=False)
                  .withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = stored(pair_links(rows), "links")
    return with_counts(rows, links, bound).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def default_files() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return aligned_counts(documents(spark, sf_dir, "doc_id", "text"), *default_files())


def brute_force(docs: list[tuple], path_a: str, path_b: str) -> list[tuple]:
    """Whole texts through both libraries, decoded bytes only, for tests."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    letters = _alphabet()
    rows, links = [], {}
    for doc_id, text in docs:
        a_all = [(i, bytes(letters[c] for c in a.id_to_token(i)))
                 for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        b_all = [(i, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) and b.is_byte(i) else p.replace(SPACE, " ").encode())
                 for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        source = (" " + (text or "")).encode()
        if not text or any(b"".join(t for _, t in side) != source for side in (a_all, b_all)):
            rows.append((doc_id, 0, 0, [], []))
            continue
        ends = [dict(zip(np.cumsum([len(t) for _, t in side]).tolist(), range(1, len(side) + 1), strict=True)) for side in (a_all, b_all)]
        groups, own, i, j = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][end], ends[1][end]
            groups.append(",".join(str(x) for x, _ in a_all[i:k]) + "|" + ",".join(str(x) for x, _ in b_all[j:m]))
            own.append((a_all[k - 1][0], b_all[m - 1][0]))
            i, j = k, m
        for p in own:
            links[p] = links.get(p, 0) + 1
        rows.append((doc_id, len(a_all), len(b_all), groups, own))
    most = {}
    for (_, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    return [(d, n_a, n_b, len(groups), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for d, n_a, n_b, groups, own in rows]
