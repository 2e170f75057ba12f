"""SentencePiece encoding and decoding with byte offsets.

A text is normalised through the model's compiled character map: at every
place the longest prefix that the map knows is replaced (else one character
is kept), white space becomes U+2581, and every normalised byte remembers the
byte of the original it came from.  The pieces cover the normalised text one after
the other, so the running sum of their lengths, sent back through that
alignment, gives the original byte span of every piece.

Ids come from the sentencepiece library.  Where no piece of the vocabulary
joins a character and a following U+2581, no merge can cross the start of a
run of U+2581, so the words between are encoded on their own and remembered: exact, and
several times faster.  Models without that property are encoded text by text.

Defined results: null text is empty; the empty text has no piece but the
begin and end ids; begin and end ids have empty spans; texts are taken whole;
repeated rows have equal results, and rows of a null doc_id one each; an empty
table gives no rows; other columns are never read.  The word memory is bounded.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memory, documents, in_arrow, utf8

SPACE = "▁"
_SPACE = SPACE.encode()
#: Words remembered by a worker (two generations of half of it).
MEMORY_WORDS = 200_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """The compiled character map: a double-array trie of byte strings whose
    leaves are places in a block of zero-terminated replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest known prefix at a place."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._child(units[0])
        for i in range(at, len(text)):
            b = text[i]
            node ^= b
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start:self.replacements.index(b"\0", start)]

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    """Longest-prefix normalisation that keeps the alignment."""

    def __init__(self, spec: bytes, suffix: bool = False):
        f = dict(_fields(spec))
        self.map = CharacterMap(f.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        self.suffix = suffix
        self.plain = not (self.map.units or self.squeeze or suffix) and self.escape and self.prefix

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and their end) the
        place in the original that it comes from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.plain:  # only spaces change, so the alignment is a repeat
            width = np.where(np.frombuffer(text, np.uint8) == 0x20, 3, 1)
            align = np.concatenate([np.zeros(3, np.int64), np.repeat(np.arange(len(text)), width), [len(text)]])
            return _SPACE + text.replace(b" ", _SPACE), align
        parts = list(self._parts(text))
        if self.squeeze:  # no leading, trailing or doubled spaces
            while parts and parts[0][2] == b" ":
                parts.pop(0)
        out, align = bytearray(), []
        space = _SPACE if self.escape else b" "

        def put(data: bytes, at: int) -> None:
            out.extend(data)
            align.extend([at] * len(data))
        if not parts:
            return b"", np.array([len(text)], np.int64)
        if self.prefix and not self.suffix:
            put(space, parts[0][0])
        last_space = self.squeeze
        end = 0
        for at, size, new in parts:
            end = at + size
            while last_space and new.startswith(b" "):
                new = new[1:]
            for b in new:
                put(space if b == 0x20 else bytes([b]), at)
            if new:
                last_space = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while bytes(out[-len(space):]) == space:
                end = align[-len(space)]
                del out[-len(space):], align[-len(space):]
        if self.prefix and self.suffix:
            put(space, end)
        return bytes(out), np.array([*align, end], np.int64)

    def _parts(self, text: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(text):
            found = self.map.longest(text, at)
            if found is None:
                b = text[at]
                size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                found = size, text[at:at + size]
            yield at, *found
            at += found[0]


class PieceModel:
    """A SentencePiece model file: ids, and spans through the alignment."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            proto = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in proto if k == 2), b"")))
        self.normalizer = Normalizer(next((v for k, v in proto if k == 3), b""), bool(trainer.get(24, 0)))
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        # What a piece covers of the normalised text; a byte piece covers one byte.
        self.width = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(p.encode())
                               for i, p in enumerate(names)], np.int64)
        kinds = [dict(_fields(v)).get(3, 1) for k, v in proto if k == 1]
        self.by_word = (self.normalizer.plain and 4 not in kinds and SPACE in names
                        and all(SPACE not in p.lstrip(SPACE) for p in names))
        self.unknown = self.library.unk_id()
        self.ends = self.library.bos_id(), self.library.eos_id()
        self.space_id = np.array([self.library.piece_to_id(SPACE)], "<u4").tobytes()
        self.known = Memory(MEMORY_WORDS)

    def ids(self, text: bytes) -> np.ndarray:
        """Ids without begin and end."""
        if not text:
            return np.zeros(0, "<u4")
        if not self.by_word:
            return np.array(self.library.encode(text.decode("utf-8", "replace")), "<u4")
        words = _WORDS.findall(SPACE + text.decode("utf-8", "replace").replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.known.ready(set(words), self._word), words)), "<u4")

    def _word(self, word: str) -> bytes:
        """One word with the U+2581 before it: the library puts the first of
        them back itself."""
        if word == SPACE:
            return self.space_id
        return np.array(self.library.encode(word[1:]), "<u4").tobytes()

    def spans(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """Original byte [begin, end) of every id."""
        normal, align = self.normalizer(text)
        width = self.width[ids]
        if not self.library.is_byte(3) and (ids == self.unknown).any():
            width = self._unknown_widths(text, ids, width)
        ends = np.cumsum(width)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return np.stack([align[ends - width], align[ends]], 1)

    def _unknown_widths(self, text: bytes, ids: np.ndarray, width: np.ndarray) -> np.ndarray:
        pieces = self.library.encode(text.decode("utf-8", "replace"), out_type=str)
        return np.array([len(p.encode()) for p in pieces], np.int64)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids with begin and end, and their spans."""
        ids = self.ids(text)
        spans = self.spans(text, ids)
        ids = np.concatenate([np.array([self.ends[0]], "<u4"), ids, np.array([self.ends[1]], "<u4")])
        return ids, np.concatenate([[[0, 0]], spans, [[len(text), len(text)]]])

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a path, kept by the worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


ENCODED = "doc_id long, ids binary, spans binary, decoded string"


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, with begin and end ids),
    spans (little-endian unsigned 64-bit begin and end of each id in the
    text's UTF-8 bytes) and the decoded text of every row.  No shuffle."""
    def task():
        codec = model(path)

        def step(batch):
            ids, spans, texts = [], [], []
            for text in utf8(batch, "text"):
                got, span = codec.encode(text)
                ids.append(got.astype("<u4").tobytes())
                spans.append(span.astype("<u8").tobytes())
                texts.append(codec.decode(got))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(spans, pa.binary()),
                 pa.array(texts, pa.string())], ["doc_id", "ids", "spans", "decoded"])
        return step
    return in_arrow(docs.select("doc_id", "text"), task, ENCODED)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                          F.crc32("spans").alias("spans_crc32"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256 (and the spans' crc32)."""
    return digests(encode_documents(documents(spark, sf_dir, "doc_id", "text"), default_model()))
