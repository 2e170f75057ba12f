"""Decontamination, fingerprints, pieces, token files and license scans
against plain Python or the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from wardstat.llm import decontaminate, fingerprints, licences, pieces, token_files
from wardstat.llm.common import scratch_path

DOC = "doc_id long, text string, spans string, items string, fp string"
ODD = ["", " ", "  a  b ", "a\nb\r\n\tc", "▁x ▁", "héé ｆｕｌｌ ​😀 <s> </s> <unk>", " \n \n", "á é", "x" * 50 + " " * 40 + "y",
       "word " * 5000, "ÀÉß ŒŸ 12.5%", "<|endoftext|> it's we'll", "  　z", "ﬁ ① ㌔"]


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "a", "b", "c") for d, t in rows], DOC)


def words(rng, n):
    return [rng.choice(["the", "of", "and", "über", "Cats", "dog9", "é", "zz"]) + str(rng.randrange(30)) for _ in range(n)]


def bench_case():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([30, 10, 9, 3, 1, 25])] + [(7, None), (8, ""), (9, " -- "), (None, "null id item")]
    items.append((10, items[0][1]))  # the same text under two ids
    docs = []
    for d in range(40):
        w = words(rng, rng.randrange(0, 120))
        if d % 3 == 0:
            src = items[rng.choice([0, 1, 2, 3, 5])][1].split()
            at = rng.randrange(len(w) + 1)
            w[at:at] = src[rng.randrange(3):]
        docs.append((d, ", ".join(w).upper() if d % 5 == 0 else " ".join(w)))
    return docs + [(90, None), (91, ""), (92, "null, ID... item"), (92, "null, ID... item")], items


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontamination_matches_brute_force(spark, block):
    docs, items = bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs_of(spark, docs), bench, block_windows=block).collect()
    got = [(r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), len(r["items"]),
            hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["spans"])) for r in found]
    assert sorted(got) == sorted(decontaminate.brute_force(docs, items))


@pytest.mark.parametrize("block", [500_000, 7])
def test_decontaminate_drops_or_cuts(spark, block):
    docs, items = bench_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {r[0] for r in decontaminate.brute_force(docs, items) if r[5]}
    df = docs_of(spark, docs)
    kept = decontaminate.decontaminate(df, bench, "documents", block_windows=block)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in hit)
    cut = decontaminate.decontaminate(df, bench, "spans", block_windows=block)
    texts = [(r["doc_id"], r["text"]) for r in cut.collect()]
    before = dict(docs)
    assert all(t == before[d] for d, t in texts if d not in hit) and len(texts) == len(docs)
    for d, t in texts:
        if d in hit:
            assert len(decontaminate.words_of(t.encode())) < len(decontaminate.words_of(before[d].encode()))


def test_decontamination_of_empty_tables(spark):
    docs, items = bench_case()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs_of(spark, []), none).collect() == []
    assert not any(r["spans"] for r in decontaminate.scan(docs_of(spark, docs), none).collect())


def winnowed(text, k=fingerprints.K, w=fingerprints.W):
    """Chosen gram positions by the definition, given each gram's value."""
    import re
    t = re.split(r"\s+", text.lower())
    grams = [tuple(t[i:i + k]) for i in range(max(1, len(t) - k + 1))]
    return grams, w


def test_winnowing_keeps_its_guarantee(spark):
    rng = random.Random(5)
    shared = " ".join(words(rng, fingerprints.K + fingerprints.W - 1))
    rows = [(i, " ".join(words(rng, 50)) + " " + shared + " " + " ".join(words(rng, 40))) for i in range(20)]
    df = docs_of(spark, rows)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).select(
        "doc_id", "text", fingerprints.positions(fingerprints.F.col("fp")).alias("p")).collect()}
    common = set.intersection(*({x["hash"] for x in r["p"]} for r in got.values()))
    assert common
    for r in got.values():  # every window of W grams has a chosen one, and equal grams have equal hashes
        grams, w = winnowed(r["text"])
        at = {x["position"]: x["hash"] for x in r["p"]}
        assert all(any(p in at for p in range(i, i + w)) for i in range(len(grams) - w + 1))
        by_gram = {}
        for p, h in at.items():
            assert by_gram.setdefault(grams[p], h) == h


def test_rightmost_of_equal_grams_is_chosen(spark):
    df = docs_of(spark, [(1, " ".join(["same"] * 12))])
    got = fingerprints.fingerprints(df).select(fingerprints.positions(fingerprints.F.col("fp")).alias("p")).first()["p"]
    assert [x["position"] for x in got] == list(range(3, 9))  # 9 equal grams, windows of 4


def test_next_documents_and_edits(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(words(rng, rng.randrange(0, 60)))) for i in range(300)] + [(7, ""), (8, "é"), (10, None)]
    texts = {d: t or "" for d, t in rows}
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs_of(spark, rows)).collect()}
    assert sorted(got) == sorted(texts)
    for i, d in enumerate(order):
        assert (got[d]["text"], got[d]["next_text"]) == (texts[d], texts[order[(i + 1) % len(order)]])


@pytest.mark.parametrize("rows", [[], [(1, "only one here")], [(1, "a"), (1, "a"), (1, "b")], [(None, "x"), (2, "y"), (None, None)]])
def test_next_documents_of_odd_tables(spark, rows):
    got = fingerprints.with_next(docs_of(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) + r["text"] for r in got) == sorted(str(d) + (t or "") for d, t in rows)
    assert all(r["next_text"] is not None and r["next_fp"] is not None for r in got)


def test_pieces_equal_the_library(spark):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rows = list(enumerate([*ODD, None, ODD[2]]))
    got = {r["doc_id"]: r for r in pieces.encode_documents(docs_of(spark, rows), pieces.default_model()).collect()}
    for d, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[d]["ids"], "<u4").tolist() == ids
        assert got[d]["decoded"] == lib.decode(ids)
    assert pieces.encode_documents(docs_of(spark, []), pieces.default_model()).collect() == []


def test_spans_tile_the_text_and_agree_with_the_library():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    codec = pieces.model(pieces.default_model())
    for t in ODD:
        ids, spans = codec.encode(t.encode())
        body = spans[1:-1]
        if len(body):
            assert body[0][0] == 0 and body[-1][1] == len(t.encode()) and (body[1:, 0] == body[:-1, 1]).all()
        if "▁" in t:
            continue  # the library reads the mark itself as a space
        want = [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]
        byte = [lib.is_byte(int(i)) for i in ids[1:-1]]
        for mine, theirs, b in zip(body.tolist(), want, byte, strict=True):
            assert b or tuple(mine) == theirs


def test_compiled_character_map_equals_the_library():
    import sentencepiece
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for k, v in pieces._fields(lib.serialized_model_proto()) if k == 3)
    normalizer = pieces.Normalizer(spec)
    assert normalizer.map.units
    for t in [*ODD, "Ｈｅｌｌｏ  ｗｏｒｌｄ", "①②ﬁ ㌔", "a　b", "​z", "tab\there", "가각 ｶﾞ"]:
        got, align = normalizer(t.encode())
        assert got.decode() == lib.normalize(t)
        assert len(align) == len(got) + 1 and (np.diff(align) >= 0).all() and align[-1] <= len(t.encode())


def test_token_files_equal_the_library(spark):
    rows = [(i * 7 % 101, t) for i, t in enumerate(ODD)] + [(200, None), (201, "last one")]
    path = scratch_path(spark, "t")
    manifest = token_files.write_files(docs_of(spark, rows), path, token_files.default_tokenizer())
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_files.read_files(manifest, path).collect()]
    assert sorted(got) == token_files.brute_force(rows, token_files.default_tokenizer())


def test_words_encode_as_the_library_encodes_texts():
    import random
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(token_files.default_tokenizer())
    codec = token_files.encoder(token_files.default_tokenizer())
    rng = random.Random(9)
    letters = "abcxyzABCéÉßñŒœİıſǆǅΣσςжЖ一あ½²ªº'.,-!_0 9\u0301\u00a0\u2028’“"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["it's WE'LL don't.", "<|ENDOFTEXT|> <|endoftext|>x", "a., b.. c,. d.", "STRASSE, Ünder. ªº, ſ.", "end### don''' a's' x_y_ __z é***"]
    got = codec.ids([t.encode() for t in texts])
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, codec.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_token_files_of_odd_tables(spark):
    path = scratch_path(spark, "t")
    empty = token_files.write_files(docs_of(spark, []), path, token_files.default_tokenizer())
    assert token_files.read_files(empty, path).collect() == []
    rows = [(None, "a b"), (3, "c"), (3, "c"), (None, None)]
    path = scratch_path(spark, "t")
    got = token_files.read_files(token_files.write_files(docs_of(spark, rows), path, token_files.default_tokenizer()), path).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["3", "3", "None", "None"]
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()


def test_license_notices_are_found_with_spans(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(words(rng, n))
    rows, want = [], {}
    for d, (name, text) in enumerate(licences.TEMPLATES):
        w = text.replace(" ", "\n# " if d % 2 else " ")
        rows.append((d, f"{noise(30)} {w.upper() if d % 3 == 0 else w} {noise(20)}"))
        want[d] = (name, 30, 30 + len(decontaminate.words_of(text.encode())) - 1)
    rows += [(100, None), (101, ""), (102, noise(400)), (103, "the license of this software"), (104, rows[0][1])]
    got = {r["doc_id"]: r["finds"] for r in licences.scan(docs_of(spark, rows)).collect()}
    for d, (name, first, last) in want.items():
        assert any((f["license"], f["first"], f["last"], f["coverage"]) == (name, first, last, 1.0) for f in got[d]), d
    assert not got[100] and not got[101] and not got[102] and not got[103] and got[104] == got[0]
    assert licences.scan(docs_of(spark, [])).collect() == []


def test_banded_alignment_counts_as_the_full_one():
    rng = random.Random(8)
    template = [f"w{i}" for i in range(40)]
    index = licences.TemplateIndex([("T", " ".join(template))])
    for _ in range(60):
        text = list(template)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(text))
            text[at:at + rng.randrange(2)] = [f"x{rng.randrange(9)}"] * rng.randrange(3)
        text = [f"n{i}" for i in range(rng.randrange(30))] + text + ["end"] * 5
        ids = np.array([index.word_id.get(w.encode(), 0) for w in text], np.uint64)
        finds = index.finds(ids, 0.0)
        best = max((f["matched"] for f in finds), default=0)
        full = licences.longest_common([w.encode() for w in text], [w.encode() for w in template])
        assert best == full


def found_in(index, text):
    return index.finds(np.array([index.word_id.get(w, 0) for w in decontaminate.words_of(text.encode())], np.uint64))


def test_short_notices_are_found_with_any_word_changed_or_words_put_in():
    index = licences.TemplateIndex(licences.TEMPLATES)
    for name, text in licences.TEMPLATES:
        template = decontaminate.words_of(text.encode())
        for i in range(len(template)):
            for new in ([b"other"], [], [template[i], b"put", b"in"]):
                changed = template[:i] + new + template[i + 1:]
                full = licences.longest_common(changed, template)
                got = found_in(index, b" ".join([b"before", *changed, b"after"]).decode())
                if full >= licences.COVERAGE * len(template):
                    assert any(f["license"] == name and f["matched"] >= full for f in got), (name, i, new)


@pytest.mark.parametrize("between", ["", " ", " and ", " one two three four five six seven "])
def test_notices_that_repeat_close_together_are_all_found(between):
    index = licences.TemplateIndex(licences.TEMPLATES)
    gap = len(between.split())
    for t, (name, text) in enumerate(licences.TEMPLATES):
        n = len(decontaminate.words_of(text.encode()))
        got = found_in(index, between.join([text + "\n"] * 4))
        assert [(f["template"], f["matched"], f["first"]) for f in got] == [(t, n, i * (n + gap)) for i in range(4)], name


def test_two_changed_notices_side_by_side_are_two_finds():
    index = licences.TemplateIndex(licences.TEMPLATES)
    got = found_in(index, "Released under the MIT terms Released under an MIT License")
    assert [(f["matched"], f["first"], f["last"]) for f in got] == [(4, 0, 3), (4, 5, 9)]


def test_a_stray_run_before_the_notice_does_not_take_its_place():
    index = licences.TemplateIndex(licences.TEMPLATES)
    text = licences.TEMPLATES[5][1].split()
    put_in = [*text[:30], *["more"] * 10, *text[30:]]
    got = found_in(index, " ".join([*text[:4], *["x"] * 12, *put_in]))
    assert [(f["matched"], f["coverage"], f["first"]) for f in got] == [(len(decontaminate.words_of(" ".join(text).encode())), 1.0, 16)]
