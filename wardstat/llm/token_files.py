"""Token ids as flat binary files.

Documents are range-partitioned and sorted by doc_id; every partition is
encoded and written by one task as three flat files:

* ``<part>.ids``  unsigned ids, 16 bits where the vocabulary allows, else 32;
* ``<part>.off``  unsigned 64-bit offsets of the documents in it, one more
  than documents;
* ``<part>.doc``  signed 64-bit doc_ids.

A small manifest (one row per partition) gets each partition's base, the
prefix sum of the ids before it, so every document has a global 64-bit offset
although no task has seen another partition.  Files carry the attempt in
their name and only those of the attempt that succeeded are in the manifest, so a
repeated or speculative task never mixes with another.  Files are read back
through a memory map where the folder is mounted, else through the file
system's own reader.

Where the tokenizer's own steps show that no token reaches across ASCII white
space (white space is normalised to a space, and its pattern, ``WORD_PATTERN``,
matches none), words are encoded once and remembered (bounded), and a text's
ids are its words' ids one after the other.  With any other tokenizer, texts are
encoded whole.

Defined results: null text is empty and has the end id only; rows of equal
doc_id follow each other by text hash; rows with a null doc_id come first; texts are
taken whole; an empty table gives no files and no rows; other columns are
never read.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, Memory, attempt, documents, in_arrow, scratch_path, stored, utf8

END_ID = 1
#: Words remembered by a worker (two generations of half of it).
MEMORY_WORDS = 1_200_000
_NO_ID = -(1 << 63)


# Characters that the byte-level vocabulary writes for the 256 bytes: the
# visible ones of Latin-1 for themselves, the others as U+0100 and up in order.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARS = dict(zip([*_VISIBLE, *(b for b in range(256) if b not in _VISIBLE)],
                       [*map(chr, _VISIBLE), *(chr(0x100 + i) for i in range(256 - len(_VISIBLE)))], strict=True))


#: Fixed value: a tokenizer's pattern whose matches hold no white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_CUTS = [{"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]


class WordEncoder:
    """A tokenizer file; by words where its steps allow it, else by texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model
        self.known = Memory(MEMORY_WORDS)
        # Where the steps before the model do no more than these, a word of
        # normalised small letters goes to the model as its bytes.
        config = json.loads(self.tokenizer.to_str())
        steps = (config["normalizer"] or {}).get("normalizers", [])
        cuts = [{k: v for k, v in x.items() if k != "trim_offsets"} for x in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.bare = (steps == _WORD_STEPS and cuts == _WORD_CUTS and not config["model"].get("dropout")
                     and not any(any(map(str.isspace, t["content"])) for t in config["added_tokens"]))

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, packed.  Words are what stands between ASCII
        white space; A-Z are lower-cased here, as the tokenizer would, unless
        that could make a special token."""
        if not self.bare:
            whole = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [array(self.code, e.ids).tobytes() for e in whole]
        runs = [(t if b"<|" in t else t.lower()).split() for t in texts]
        value = self.known.ready(set().union(*runs), self._word)
        return [b"".join(map(value, words)) for words in runs]

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        # ASCII marks after letters are one run, a token of their own.
        head = text.rstrip(string.punctuation)
        if head.isalpha() and (head.isascii() or unicodedata.is_normalized("NFC", head)) and head == head.lower():
            tail = text[len(head):]
            if not head.isascii():
                head = head.encode().decode("latin-1").translate(_BYTE_CHARS)
            return self._model(head) + (self._model(tail) if tail else b"")
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, text: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


MANIFEST = "part int, file string, n_docs long, n_ids long, width int"


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write the files under ``path`` and return the manifest with bases."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select("doc_id", "text").repartitionByRange(parts, "doc_id")
            .sortWithinPartitions("doc_id", F.xxhash64("text")))

    def run(batches):
        codec = encoder(tokenizer)
        end = np.array([end_id], codec.dtype).tobytes()
        store, folder = pafs.FileSystem.from_uri(path)
        out, name, offsets, n_docs = None, None, [0], 0
        streams = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                if out is None and piece.num_rows:
                    name = f"part-{attempt()}"
                    store.create_dir(folder, recursive=True)
                    streams = {k: store.open_output_stream(f"{folder}/{name}.{k}") for k in ("ids", "off", "doc")}
                    out = streams["ids"]
                    streams["off"].write(np.zeros(1, "<u8").tobytes())
                packed = [ids + end for ids in codec.ids(list(utf8(piece, "text")))]
                sizes = np.array([len(p) for p in packed], np.uint64) // np.uint64(codec.dtype.itemsize)
                out.write(b"".join(packed))
                here = np.cumsum(sizes, dtype=np.uint64) + np.uint64(offsets[-1])
                offsets = [int(here[-1])]
                n_docs += len(packed)
                streams["off"].write(here.astype("<u8").tobytes())
                ids = piece.column("doc_id").cast(pa.int64()).fill_null(_NO_ID)
                streams["doc"].write(np.asarray(ids).astype("<i8").tobytes())
        for s in streams.values():
            s.close()
        if out is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]),
                 pa.array([n_docs], pa.int64()), pa.array([offsets[-1]], pa.int64()),
                 pa.array([codec.dtype.itemsize], pa.int32())], ["part", "file", "n_docs", "n_ids", "width"])
    manifest = stored(rows.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _flat(store, place: str, dtype: str) -> np.ndarray:
    """A flat file as an array: mapped where it is a local or mounted file."""
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(place, dtype, "r")
    with store.open_input_file(place) as f:
        return np.frombuffer(f.read_buffer(), dtype)


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_files(manifest: DataFrame, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (its global offset),
    n_tokens and its ids as little-endian unsigned 32-bit integers."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task():
        store, folder = pafs.FileSystem.from_uri(path)

        def step(batch):
            for r in batch.to_pylist():
                place = f"{folder}/{r['file']}"
                offsets = _flat(store, f"{place}.off", "<u8").astype(np.int64)
                names = _flat(store, f"{place}.doc", "<i8")
                ids = _flat(store, f"{place}.ids", "<u2" if r["width"] == 2 else "<u4")
                for at in range(0, r["n_docs"], 256):
                    cut = offsets[at:at + 257]
                    doc = np.array(names[at:at + 256])
                    texts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64(), mask=doc == _NO_ID), pa.array(cut[:-1] + r["base"], pa.int64()),
                         pa.array(np.diff(cut), pa.int64()), pa.array(texts, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])
        return step
    return in_arrow(manifest.repartition(parts, "part"), task, READ)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files read back: start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "token-files")
    manifest = write_files(documents(spark, sf_dir, "doc_id", "text"), path, default_tokenizer())
    return read_files(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_force(docs: list[tuple], tokenizer: str, end_id: int = END_ID) -> list[tuple]:
    """The same with the library alone, for tests."""
    from tokenizers import Tokenizer
    t, start, out = Tokenizer.from_file(tokenizer), 0, []
    for doc_id, text in sorted(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
