"""Toxicity, language, near-duplicates and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardstat.llm import decontaminate, language, near_dups, pieces, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, component string"
SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", len(t or ""), "clash", "clash") for d, t, lang in rows], DOC)


def sentence(rng, stems, n):
    return " ".join(rng.choice(stems) + rng.choice(["", "s", "en", "tion"]) for _ in range(n))


STEMS = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["wander", "straße", "über", "garten"], "cc": ["niño", "mañana", "calle", "quien"]}


# --- toxicity

def toxic_case(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for d in range(n):
        bad = d % 4 == 1
        text = sentence(rng, STEMS["aa"], rng.randrange(5, 60))
        if bad:
            w = text.split()
            w.insert(rng.randrange(len(w)), rng.choice(["grubfox", "grubfoxes", "vilemuck"]))
            text = " ".join(w)
        rows.append((d, text, "aa"))
        labels.append((d, int(bad)))
    return rows, labels


def test_toxicity_separates_unseen_rows(spark):
    rows, labels = toxic_case()
    df = docs_of(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df.filter("doc_id < 300"), lab)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).filter("doc_id >= 300").collect()}
    assert all((s >= toxicity.THRESHOLD) == (d % 4 == 1) for d, s in got.items())


def test_toxicity_score_is_the_sum_over_distinct_words(spark):
    rows, labels = toxic_case(120)
    model = toxicity.train(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = [(0, None, None), (1, "", None), (2, "grubfox GRUBFOX, grubfox", None), (3, "grubfox", None), (4, "x " * 30_000, None), (4, "x", None)]
    got = toxicity.score(docs_of(spark, texts), model).collect()
    assert [c for c in got[0].asDict()].count("toxicity") == 1
    by = {(r["doc_id"], r["text"]): r["toxicity"] for r in got}

    def by_hand(text):
        z = model.intercept + sum(model.weights[b] for w in toxicity.words_of((text or "").encode()) for b in toxicity.grams(w))
        return 1 / (1 + np.exp(-z))
    assert all(abs(by[d, t] - by_hand(t)) < 1e-9 for d, t, _ in texts)
    assert by[0, None] == by[1, ""] and by[2, texts[2][1]] == by[3, "grubfox"]


def test_log_count_ratios_count_all_training_rows(spark):
    rows = [(1, "aab aab", None), (2, "aab b", None), (3, "b c", None)]
    lab = {1: 1, 2: 0, 3: 0}
    df = docs_of(spark, rows).select("doc_id", "text", F.when(F.col("doc_id") == 1, 1).otherwise(0).alias("label"))
    got = {r["bucket"]: (r["toxic"], r["other"]) for r in toxicity._bucket_counts(df).collect()}
    want = {}
    for d, t, _ in rows:
        for w in set(t.split()):
            for b in toxicity.grams(w):
                p = want.setdefault(b, [0, 0])
                p[1 - lab[d]] += 1
    assert got == {b: tuple(v) for b, v in want.items()}


def test_toxicity_knows_hundreds_of_distinct_toxic_words(spark):
    rng = random.Random(12)
    made = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    bad, good = [made() for _ in range(500)], [made() for _ in range(500)]
    rows, labels = [], []
    for d in range(3000):
        toxic = d % 2
        special = (bad if toxic else good)[d // 2 % 500]
        rows.append((d, f"{sentence(rng, STEMS['aa'], 8)} {special} {sentence(rng, STEMS['aa'], 8)}", "aa"))
        labels.append((d, toxic))
    df = docs_of(spark, rows)
    model = toxicity.train(df.filter("doc_id < 2000"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(df, model).filter("doc_id >= 2000").collect()}
    assert np.mean([(s >= 0.5) == (d % 2 == 1) for d, s in got.items()]) > 0.99
    assert np.mean([any(model.weights[b] for b in toxicity.grams(w)) for w in bad]) == 1.0


@pytest.mark.parametrize("labels,share", [([], 0.001), ([(1, 1), (2, 1)], 0.999), ([(1, 0), (2, None)], 0.001)])
def test_toxicity_without_both_labels(spark, labels, share):
    model = toxicity.train(docs_of(spark, [(1, "a", None), (2, "b", None)]), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs_of(spark, [(5, "whatever", None)]), model).first()["toxicity"]
    assert abs(got - share) < 1e-9
    assert toxicity.score(docs_of(spark, []), model).collect() == []


# --- language

def test_language_of_unseen_rows_and_words(spark):
    rng = random.Random(6)
    rows = [(d, sentence(rng, STEMS[lang], rng.randrange(3, 40)), lang) for d in range(300) for lang in [rng.choice(list(STEMS))]]
    df = docs_of(spark, rows)
    model = language.train(df.filter("doc_id < 200").select("text", "lang"))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).filter("doc_id >= 200").collect()}
    assert all(got[d] == lang for d, _, lang in rows[200:])
    odd = [(1, None, None), (2, "", None), (3, "12 !? _ ² ½", None), (4, "straßenüberg", None), (5, "ñññ", None), (6, "ж", None), (7, "über " * 20_000, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.identify(docs_of(spark, odd), model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "bb" and got[5][0] == "cc" and got[7][0] == "bb"
    assert got[6][0] == "aa"  # nothing known: the first language by name
    assert all(0 <= s <= 1 for _, s in got.values())


def test_backoff_goes_to_shorter_grams(spark):
    model = language.train(docs_of(spark, [(1, "abcdef", "aa"), (2, "xyz", "bb"), (3, "zz", None)]).select("text", "lang"))
    assert model.langs == ["aa", "bb"]
    none = model.none[0]
    known = model.word("abcdef")
    assert known[0] == 0 and known[1] == none
    five = model.word("abcdefg")  # " abcd", "abcde", "bcdef" are known, "cdefg", "defg " are not
    assert five[0] == pytest.approx(np.log(1 / 4)) and five[1] == none
    one = model.word("qx")
    assert one[1] == pytest.approx(np.log(1 / 3)) and one[0] == none


def test_language_with_nothing_learnt(spark):
    model = language.train(docs_of(spark, [(1, "abc", None)]).select("text", "lang"))
    assert language.identify(docs_of(spark, [(2, "abc", None)]), model).first()["lang_pred"] == "und"


def test_languages_of_the_tables(spark):
    import __spark_entry__
    got = __spark_entry__.queries()["op3_language"](spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    share = got.filter("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.95 and got.count() == 1000


# --- near-duplicates

def near_case(seed, groups=6, members=12, plain=30):
    """Groups of copies with ever more words changed, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 160))]
        for k in range(members):
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((d, " ".join(text) if k else " \n".join(base).upper(), None))
            d += 1
    for _ in range(plain):
        rows.append((d, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))), None))
        d += 1
    rng.shuffle(rows)
    return [(i, t, None) for i, (_, t, _) in enumerate(rows)]


def table_of(out):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect())


@pytest.mark.parametrize("seed,shingle,percent", [(1, 3, 85), (2, 5, 80), (3, 3, 85)])
def test_near_duplicates_match_brute_force(spark, seed, shingle, percent):
    rows = near_case(seed) + [(9000, None, None), (9001, "", None), (9002, " \t", None), (9003, "one", None), (9004, "ONE", None),
                              (9005, "one two", None), (9006, "two one", None)]
    out = near_dups.near_duplicates(docs_of(spark, rows), shingle, percent)
    assert table_of(out) == near_dups.brute_force([(d, t) for d, t, _ in rows], shingle, percent)


def test_blocks_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rows = near_case(5, groups=2, members=60, plain=5)
    out = near_dups.near_duplicates(docs_of(spark, rows))
    assert table_of(out) == near_dups.brute_force([(d, t) for d, t, _ in rows])


def test_circulant_signature_by_definition():
    rng = np.random.default_rng(0)
    s = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    sig = near_dups.signature(s, 64)
    circle = np.random.default_rng(near_dups.SEED).permutation(near_dups.CIRCLE)
    at = (s * near_dups._M3 >> np.uint64(44)).astype(int)
    assert [min(circle[(p + k) % near_dups.CIRCLE] for p in at) for k in range(64)] == sig.tolist()
    assert (near_dups.signature(s, 16) == sig[:16]).all()
    a, b = s[:45], s[5:]  # 40 of 50 in common
    x, y = near_dups.signature(a, 4096), near_dups.signature(b, 4096)
    assert abs((x == y).mean() - 0.8) < 0.05


def test_near_duplicates_of_odd_tables(spark):
    assert near_dups.near_duplicates(docs_of(spark, [])).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, None), (1, text, None), (1, text, None), (2, text + " more", None), (2, "x y z", None), (3, "word " * 30_000, None)]
    got = table_of(near_dups.near_duplicates(docs_of(spark, [r for r in rows if r[0] is not None])))
    assert got == [(1, 58, 1, True), (1, 58, 1, True), (2, 1, 1, False), (2, 59, 1, False), (3, 1, 3, True)]
    got = [r for r in near_dups.near_duplicates(docs_of(spark, rows)).collect() if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in got] == [(None, True)]


# --- pipeline

def test_pipeline_matches_brute_force_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, SF), f"test-{name}")
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = after
        rows = [(r["doc_id"], r["text"]) for r in before]
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "toxicity":
            scored = toxicity.score(spark.createDataFrame(before), toxicity.trained(spark, spark.createDataFrame(before), SF))
            assert set(after) == {r["doc_id"] for r in scored.collect() if r["toxicity"] < toxicity.THRESHOLD}
        elif name == "line_dedup":
            from .test_lines_urls import plain
            want = {d: sha for d, _, _, sha in plain(rows)}
            assert {d: hashlib.sha256(r["text"].encode()).hexdigest() for d, r in after.items()} == want
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_duplicates":
            want = {d for d, _, _, own in near_dups.brute_force(rows, corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT) if own}
            assert set(after) == want
        elif name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            grams = {}
            for _, t in bench:
                w = decontaminate.words_of(t.encode())
                for i in range(max(1, len(w) - 9) if w else 0):
                    grams.setdefault(len(w[i:i + 10]), set()).add(tuple(w[i:i + 10]))
            clean = set()
            for d, t in rows:
                w = decontaminate.words_of(t.encode())
                if not any(tuple(w[i:i + n]) in g for n, g in grams.items() for i in range(len(w) - n + 1)):
                    clean.add(d)
            assert set(after) == clean and 0 < len(clean) < len(rows)
        else:
            import sentencepiece
            lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
            for d, t in rows:
                ids = lib.encode(t, add_bos=True, add_eos=True)
                assert after[d]["n_tokens"] == len(ids)
                assert after[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert after[d]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_pipeline_handles_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "x", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 5  # nothing is learnt, so nothing is toxic
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.count() == 5, name
