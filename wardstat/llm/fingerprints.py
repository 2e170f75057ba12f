"""Document fingerprints by winnowing, as column expressions.

*Tokens.*  A lower-cased text is cut into words at white space.  A letter of a
script that is written without spaces (Han, Kana, Thai, Lao, Khmer, Myanmar) is
a token by itself, and so is every character of an unbroken run of more than
``LONG_RUN`` others (encoded or minified data), so such texts have grams of
characters and a change of one leaves the others as they are.
*Rolling hash.*  Every token is hashed once; the hash of ``K`` tokens is the
cyclic polynomial of theirs, ``rot(h1, K-1) ^ ... ^ rot(hK, 0)``, the value that
rolls on by one rotation, one token out and one in.  (A text of fewer
tokens is one gram.)
*Winnowing.*  In every window of ``W`` successive grams the least hash is
chosen, the rightmost of equal ones.  So any ``K + W - 1`` tokens that two texts
share give both of them a common fingerprint, and no shared run under ``K``
tokens does; the kept positions tell where.  A fingerprint keeps
its hash (32 bits) and its position (the gram's number), in one long: the
hash above, the position counted down below, so the least long of a window
*is* the least hash and of equal ones the rightmost, and the window's minimum
needs no struct.

``next_documents`` pairs every document with the next one by descending
doc_id.  Ids are cut into blocks by quantiles; a block is sorted by itself, and
the first document of each block also goes, as a guest, to the block above
it.  Every text moves once; no block is the whole table.

Defined results: null text is empty; a text without a token has one gram (the
empty word), so all empty texts have equal fingerprints; a text of fewer than
``K`` tokens is like another only if all of them are equal; texts are taken whole; rows of equal
doc_id follow each other by text hash; rows with a null doc_id come after all
others; the only document is its own next one; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, let

K = 4
W = 4
_HASH_BITS = -(1 << 32)
_LOW = (1 << 32) - 1


#: Characters of an unbroken run that are still one word.
LONG_RUN = 32
#: Blocks of scripts written without spaces: Thai and Lao, Myanmar, Khmer, Han
#: (with radicals and the supplementary planes), Kana.  Ranges, since a script's name
#: costs a search for every character.
_UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF"
             r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D\x{20000}-\x{3134F}")
_RUN = rf"[^\s{_UNSPACED}]"
#: A letter of an unspaced script; a whole run of other characters, if it is no
#: longer than a word; a character of a longer one.
TOKENS = rf"[{_UNSPACED}]|(?<!{_RUN}){_RUN}{{1,{LONG_RUN}}}(?!{_RUN})|{_RUN}"


#: A run too long for a word.
_LONG = rf"(?<!\S)\S{{{LONG_RUN + 1}}}"
_BLANKS = " \t\n\x0b\f\r"


def tokens(text: Column) -> Column:
    """The tokens of a text.  One without letters of unspaced scripts and
    without long runs is simply split, which is the same and much cheaper."""
    def cut(low: Column) -> Column:
        ascii_only = F.octet_length(low) == F.char_length(low)
        words = (ascii_only | ~F.rlike(low, F.lit(f"[{_UNSPACED}]"))) & ~F.rlike(low, F.lit(_LONG))
        one_by_one = let(F.regexp_extract_all(low, F.lit(TOKENS), F.lit(0)),
                         lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(""))))
        return F.when(words, F.split(F.btrim(low, F.lit(_BLANKS)), r"\s+")).otherwise(one_by_one)
    return let(F.lower(text), cut)


def _rotated(h: Column, bits: int) -> Column:
    return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits)) if bits else h


def _grams(text: Column, k: int) -> Column:
    """Packed (hash, position counted down) of every run of k tokens."""
    def packed(h: Column) -> Column:
        heads = F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(1)))

        def gram(x: Column, i: Column) -> Column:
            out = _rotated(x, k - 1)
            for j in range(1, k):  # a short text lacks the last tokens
                out = out.bitwiseXOR(_rotated(F.coalesce(F.get(h, i + j), F.lit(0).cast("long")), k - 1 - j))
            return out.bitwiseAND(F.lit(_HASH_BITS)) + (F.lit(_LOW) - i)
        return F.transform(heads, gram)
    return let(F.transform(tokens(text), lambda t: F.xxhash64(t)), packed)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen grams of a text, in text order, as packed longs."""
    def chosen(g: Column) -> Column:
        heads = F.slice(g, 1, F.greatest(F.size(g) - (w - 1), F.lit(1)))
        least = F.transform(heads, lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, w))))
        return F.array_distinct(least)
    return let(_grams(text, k), chosen)


def hashes(fp: Column) -> Column:
    """The distinct hashes of a fingerprint, sorted."""
    return F.array_sort(F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 32).cast("int"))))


def positions(fp: Column) -> Column:
    """(hash, position) of every chosen gram, for telling where texts match."""
    return F.transform(fp, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("hash"),
                                              (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).alias("position")))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes (Jaccard) of two hash arrays."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def printed(hashed: Column) -> Column:
    """A fingerprint as text: its sorted hashes in hexadecimal."""
    return F.array_join(F.transform(hashed, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(_LOW))))), " ")


def next_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text, and the block and guest columns that keep
    further windows over the same blocks free of a shuffle; a guest is there
    for the last document of a block and is to be dropped at the end."""
    spark = docs.sparkSession
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = src.select("doc_id").filter("doc_id IS NOT NULL")
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.25 / blocks)})
    # Block of an id: how many cuts are at or below it; null ids are block -1.
    own = F.when(F.col("doc_id").isNull(), -1).otherwise(_rank(_longs(cuts), F.col("doc_id"), len(cuts)))
    found = src.select("doc_id").withColumn("own", own).groupBy("own").agg(F.max("doc_id").alias("top"))
    tops = {r["own"]: r["top"] for r in found.collect()}  # one row per block
    order = sorted(tops, reverse=True)
    if not order:
        return src.select("doc_id", "text", F.lit(False).alias("guest"), own.alias("block"))
    guest_of = {below: above for above, below in zip(order, order[1:], strict=False)}
    guest_of[order[0]] = order[-1]  # after the last document comes the first
    # By block number plus one: its top id, and the block that its guest goes to.
    top_of = _longs([tops.get(b) for b in range(-1, len(cuts) + 1)])
    above = _longs([guest_of.get(b) for b in range(-1, len(cuts) + 1)])
    rows = src.withColumn("own", own)
    # Rows that share the top id are all guests; the first by order is read.
    lead = F.col("doc_id").eqNullSafe(F.get(top_of, F.col("own") + 1))
    places = F.when(lead, F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("guest")),
                                  F.struct(F.get(above, F.col("own") + 1).cast("int").alias("block"), F.lit(True).alias("guest")))
                    ).otherwise(F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("guest"))))
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.guest", "p.block")


def _longs(values: list[int | None]) -> Column:
    """A constant array; made of one text, so that the plan stays small."""
    if not values:
        return F.array().cast("array<bigint>")
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _rank(cuts: Column, value: Column, n: int) -> Column:
    """How many of the sorted cuts are at or below the value, by halving."""
    steps = [1 << i for i in reversed(range(n.bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: low + F.when(
        F.coalesce(F.get(cuts, low + step - 1) <= value, F.lit(False)), step).otherwise(0))


def _order():
    """Own rows by descending id, then the guests."""
    return [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, text and winnowed fingerprint (packed longs) of every row."""
    return docs.select("doc_id", "text", winnow(F.coalesce("text", F.lit("")), k, w).alias("fp"))


def places(fp: Column) -> Column:
    """A fingerprint's positions as text, in text order."""
    return F.array_join(F.transform(fp, lambda x: (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("string")), " ")


def with_next(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """doc_id, text, its hashes and their places, and the next document's text
    and hashes."""
    rows = next_documents(docs)
    by = Window.partitionBy("block").orderBy(*_order())
    # The fingerprint is made where the sorted blocks are and read by a second
    # window over the same blocks, so neither of them moves a row.
    led = rows.withColumn("next_text", F.lead("text").over(by))
    led = led.withColumn("chosen", winnow(F.col("text"), k, w))
    led = led.withColumn("fp", hashes(F.col("chosen"))).withColumn("places", places(F.col("chosen"))).drop("chosen")
    led = led.withColumn("next_fp", F.lead("fp").over(by))
    return led.filter(~F.col("guest")).select("doc_id", "text", "fp", "places", "next_text", "next_fp")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last half
    replaced by the beginning of the next document), and the positions of the
    text's chosen grams."""
    return edited(with_next(documents(spark, sf_dir, "doc_id", "text")))


def edited(rows: DataFrame) -> DataFrame:
    """Digests and likenesses of rows of ``with_next``."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), changed.alias("edited"), "fp", "places", "next_fp")
    rows = rows.select("*", hashes(winnow(F.col("edited"))).alias("edited_fp"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       printed(F.col("fp")).alias("fingerprint"), printed(F.col("edited_fp")).alias("edited_fingerprint"),
                       likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.col("places").alias("positions"))


#: What SQL can say of ``op4_fingerprints`` (for tables whose ids are unique).
EDITS_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nexts AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM t)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2)) AS edited_sha256 FROM nexts
"""
