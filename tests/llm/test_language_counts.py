"""Language scores against a plain re-count, over both ways of joining."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardstat.llm import language as L

SCHEMA = "doc_id long, text string, lang string, word string, sum double"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "w", 0.0) for d, t, lang in rows], SCHEMA)


def corpus(seed, docs=80, langs=4):
    rng = random.Random(seed)
    stems = [["".join(rng.choice("abcdeéüñж日") for _ in range(rng.randrange(1, 8))) for _ in range(25)] for _ in range(langs)]
    def text(k):
        return " ".join(rng.choice(stems[k]) + rng.choice(["", "", "x", "!", "1", "."]) for _ in range(rng.randrange(0, 25)))
    rows = [(d, text(k), f"l{k:03d}" if rng.random() < 0.9 else None) for d in range(docs) for k in [rng.randrange(langs)]]
    return [*rows, (None, "abc cde", "l000"), (5, None, "l001"), (6, "", "l001"), (7, "12 ² !", "l002"), (7, "12 ² !", "l002")]


def plain(training, texts):
    words, grams = {}, {}
    for _, text, lang in training:
        if lang is not None:
            for w in filter(L.is_word, L.words_of((text or "").encode())):
                words.setdefault(lang, Counter())[w] += 1
    for lang, own in words.items():
        for w, n in own.items():
            for size in L.SIZES:
                for g in L._grams(w, size):
                    grams.setdefault((lang, size), Counter())[g] += n
    langs = sorted(words)
    logs = {(lang, 0): {w: math.log(n / sum(c.values())) for w, n in c.items()} for lang, c in words.items()}
    logs |= {k: {g: math.log(n / sum(c.values())) for g, n in c.items()} for k, c in grams.items()}
    missing = min((v for own in logs.values() for v in own.values()), default=0) - L.PENALTY

    def word(w):
        if any(w in logs[lang, 0] for lang in langs):
            return [logs[lang, 0].get(w, missing) for lang in langs]
        for size in L.SIZES:
            known = [g for g in L._grams(w, size) if any(g in logs.get((lang, size), ()) for lang in langs)]
            if known:
                return [sum(logs.get((lang, size), {}).get(g, missing) for g in known) / len(known) for lang in langs]
        return [missing] * len(langs)
    out = []
    for doc_id, text, _ in texts:
        rows = [word(w) for w in L.words_of((text or "").encode()) if L.is_word(w)]
        if not rows or not langs:
            out.append((doc_id, "und", 0.0))
            continue
        mean = np.mean(rows, 0)
        best = int(np.argmax(np.round(mean, 9)))
        out.append((doc_id, langs[best], float(1 / np.exp(mean - mean[best]).sum())))
    return out


@pytest.mark.parametrize("bound", [L.BROADCAST_ENTRIES, 0])
@pytest.mark.parametrize("seed,langs", [(1, 4), (2, 2), (3, 1)])
def test_scores_match_a_plain_count(spark, bound, seed, langs):
    rows = corpus(seed, langs=langs)
    model = L.train(frame(spark, rows[:60]))
    got = L.identify(frame(spark, rows), model, bound)
    assert got.columns == ["doc_id", "text", "lang", "word", "sum", "lang_pred", "lang_score"]
    got = sorted((r["doc_id"] or -1, r["lang_pred"], round(r["lang_score"], 9)) for r in got.collect())
    assert got == sorted((d or -1, p, round(s, 9)) for d, p, s in plain(rows[:60], rows))


def test_a_hundred_languages(spark):
    rows = corpus(4, docs=600, langs=100)
    model = L.train(frame(spark, rows))
    assert len(model.langs) > 90
    both = [sorted((r["doc_id"] or -1, r["lang_pred"], round(r["lang_score"], 9)) for r in L.identify(frame(spark, rows), model, b).collect())
            for b in (L.BROADCAST_ENTRIES, 0)]
    assert both[0] == both[1] == sorted((d or -1, p, round(s, 9)) for d, p, s in plain(rows, rows))


def test_what_is_broadcast_follows_the_entries(spark):
    """Not the entries times the languages."""
    model = L.train(frame(spark, corpus(4, docs=600, langs=100)))
    scores = L.SparseScores(model.entries(), model.langs, model.missing)
    n = model.words.count() + model.grams.count()
    assert len(scores.above) == n == len(scores.lang) and len(scores.keys) <= n
    size = sum(x.nbytes for x in (scores.keys, scores.first, scores.lang, scores.above))
    assert size <= 26 * n + 8


def test_hashes_are_sparks(spark):
    keys = ["", "a", "abcdefg", "é日", "x" * 31, "y" * 32, "z" * 100]
    rows = [(size, k) for size in (0, 1, 5) for k in keys]
    want = [r[0] for r in spark.createDataFrame(rows, "size int, key string").coalesce(1).select(F.xxhash64("size", "key")).collect()]
    assert [int(L._hashes(size, [k])[0]) for size, k in rows] == want
    assert L._size_seed(0) == xxhash.xxh64_intdigest(bytes(4), 42)


def test_held_out_of_no_id_is_null(spark):
    from wardstat.llm.common import crc_fold
    assert spark.createDataFrame([(None,)], "doc_id long").select(crc_fold() == 2).first()[0] is None


def test_empty_tables(spark):
    for bound in (L.BROADCAST_ENTRIES, 0):
        model = L.train(frame(spark, corpus(1)))
        assert L.identify(frame(spark, []), model, bound).collect() == []
    none = L.train(frame(spark, []))
    assert [(r["lang_pred"], r["lang_score"]) for r in L.identify(frame(spark, [(1, "abc", "x")]), none).collect()] == [("und", 0.0)]
