"""Every column of the fingerprint query against a plain winnowing, and
unspaced, long and short texts."""

import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from wardstat.llm import fingerprints as P

UNSPACED = "一-鿿ぁ-ゟァ-ヿก-๛"
MASK = (1 << 64) - 1


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, block long")


def plain_tokens(text):
    out = []
    for run in re.findall(rf"[{UNSPACED}]|[^\s{UNSPACED}]+", text.lower()):
        out += [run] if len(run) <= P.LONG_RUN else list(run)
    return out or [""]


def rotated(h, bits):
    return (h << bits | h >> (64 - bits)) & MASK if bits else h


def plain_winnow(text, k=P.K, w=P.W):
    """[(hash, position)] by a hash that rolls on token by token."""
    h = [xxhash.xxh64_intdigest(t.encode(), 42) for t in plain_tokens(text)]
    if len(h) < k:
        first = 0
        for j in range(k):
            first ^= rotated(h[j] if j < len(h) else 0, k - 1 - j)
        grams = [first]
    else:
        roll = 0
        for x in h[:k]:
            roll = rotated(roll, 1) ^ x
        grams = [roll]
        for gone, new in zip(h, h[k:], strict=False):
            roll = rotated(roll, 1) ^ rotated(gone, k) ^ new
            grams.append(roll)
    signed = [(g >> 32) - (1 << 32 if g >> 63 else 0) for g in grams]
    chosen = set()
    for i in range(max(1, len(grams) - w + 1)):
        window = range(i, min(i + w, len(grams)))
        least = min(signed[j] for j in window)
        chosen.add(max(j for j in window if signed[j] == least))
    return [(signed[j], j) for j in sorted(chosen)]


def corpus(seed=2):
    rng = random.Random(seed)
    bits = ["word", "Two", "é", "日本語", "テスト", "ภาษา", "x" * 40, "a" * 32, "b" * 33, "\n", "  ", "😀", "end."]
    rows = [(i * 2, " ".join(rng.choice(bits) + rng.choice(["", "1", "z"]) for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    return [*rows, (501, ""), (503, None), (505, "日" * 300 + "本"), (507, " lead and trail "), (509, "one"), (511, "Y" * 5000)]


def expected(rows):
    texts = sorted(((d, t or "") for d, t in rows), reverse=True)
    prints = {t: sorted({h for h, _ in plain_winnow(t)}) for _, t in texts}
    shown = lambda hashes: " ".join(f"{h & 0xFFFFFFFF:x}" for h in hashes)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    out = []
    for (d, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        e = t[:len(t) - half] + after[:half]
        own = sorted({h for h, _ in plain_winnow(e)})
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), shown(prints[t]), shown(own), like(prints[t], own), like(prints[t], prints[after]),
                    " ".join(str(p) for _, p in plain_winnow(t))))
    return sorted(out)


def test_every_column_matches_a_plain_winnowing(spark):
    rows = corpus()
    got = P.edited(P.with_next(frame(spark, rows)))
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
    assert sorted(map(tuple, got.collect())) == expected(rows)


def test_sql_says_the_same_of_edits(spark):
    rows = corpus(5)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = P.edited(P.with_next(frame(spark, rows))).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(P.EDITS_SQL).fetchall())


@pytest.mark.parametrize("letter", ["日", "の", "ก", "A"])
def test_unbroken_texts_that_differ_in_one_place_are_alike(spark, letter):
    rng = random.Random(3)
    base = "".join(chr(ord(letter) + rng.randrange(20)) for _ in range(580))
    rows = [(2, base + "!"), (1, base + "?"), (0, base[:290] + base[300:])]
    got = {r["doc_id"]: r["near_next"] for r in P.edited(P.with_next(frame(spark, rows))).collect()}
    assert got[2] > 0.9 and got[1] > 0.8


def test_half_edited_unspaced_text_keeps_half(spark):
    rng = random.Random(4)
    rows = [(i, "".join(chr(0x4e00 + rng.randrange(500)) for _ in range(400))) for i in range(6)]
    assert all(0.2 < r["near_edited"] < 0.5 and r["near_next"] < 0.1 for r in P.edited(P.with_next(frame(spark, rows))).collect())


def test_a_very_long_text(spark):
    rows = [(1, "word " * 100_000 + "tail"), (2, "z" * 30_000)]
    got = {r["doc_id"]: r for r in P.edited(P.with_next(frame(spark, rows))).collect()}
    assert got[1]["n_chars"] == 500_004 and got[2]["fingerprint"]
