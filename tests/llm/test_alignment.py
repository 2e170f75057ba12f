"""Token alignment against whole texts through both libraries."""

import random

import numpy as np
import pytest

from wardstat.llm import alignment as A
from wardstat.llm.common import stored

ODD = ["", " ", "  ", "  a  b ", "a\nb\r\n\tc", "▁x ▁", "héé ｆｕｌｌ ​😀 <s> </s> <unk>", " \n \n", "á é", "x" * 50 + " " * 40 + "y",
       "foo\n  ", "ÀÉß ŒŸ 12.5%", "<|endoftext|> it's we'll", "  　z", "ﬁ ① ㌔", "\x00 a\x1c b", "日本語 テキスト<0x41> ", "a  ", "\n", "'s 's",
       "foo.\n\nBar, baz!? qux:", "a.b,c ;d", "𠀋𠀋" * 30, "\U000e0041", "word, " * 4000, "z" * 20_000]
BITS = [" ", "  ", "a", "é", "日", "😀", "\n", "'s", "1", "▁", ".", "the", "\xa0", "\t", "Ω", "\x1c", " of", "ing", "\r\n", ",", "Ab", "!?"]


def cases(n=400):
    rng = random.Random(5)
    return [*ODD, *("".join(rng.choice(BITS) for _ in range(rng.randrange(1, 40))) for _ in range(n))]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, pair long, row string")


@pytest.mark.parametrize("bound", [None, 3])
def test_counts_match_brute_force(spark, bound):
    docs = [*enumerate(cases(200)), (900, None), (None, "no id, the same"), (7, "again and again"), (7, "again and again")]
    got = [tuple(r) for r in A.aligned_counts(frame(spark, docs), *A.default_files(), bound).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(A.brute_force(docs, *A.default_files()), key=key)


def test_cut_and_whole_texts_agree():
    cut, whole = A.Aligner(*A.default_files()), A.Aligner(*A.default_files())
    assert cut.by_stretch
    whole.by_stretch = False
    texts = cases(3000)
    for a, b, text in zip(cut.stretches(texts), whole.stretches(texts), texts, strict=True):
        joined = [None if x is None else (";".join(p.groups for p in x), b"".join(p.pairs for p in x), sum(p.tokens for p in x)) for x in (a, b)]
        assert joined[0] == joined[1], repr(text)


def test_a_small_memory_changes_nothing():
    full, tiny = A.Aligner(*A.default_files()), A.Aligner(*A.default_files())
    tiny.known = A.Memory(4)
    texts = cases(300)
    assert full.stretches(texts) == [tiny.stretches([t])[0] for t in texts]


def test_spans_are_refined_inside_characters():
    """Tokens of one character share its span; their decoded bytes part them."""
    assert A.refine(np.array([2, 5, 5, 5, 7]), np.array([2, 3, 4, 5, 7])).tolist() == [2, 3, 4, 5, 7]
    text = " 日\U000e0041x"
    a_ids, a_ends, b_ids, b_ends, _ = A.Aligner(*A.default_files()).ends([text])
    assert a_ends[-1] == b_ends[-1] == len(text.encode())
    assert (np.diff(a_ends, prepend=0) > 0).all() and (np.diff(b_ends, prepend=0) > 0).all()
    assert len(a_ends) == len(a_ids) and len(b_ends) == len(b_ids)


def test_groups_and_cuts(spark):
    rows = A.align_documents(frame(spark, [(1, "naïve 日本 text"), (2, "")]), *A.default_files()).collect()
    one, two = sorted(rows, key=lambda r: r["doc_id"])
    cuts = np.frombuffer(one["cuts"], "<u8")
    assert len(cuts) == one["n_groups"] == one["groups"].count(";") + 1 and cuts[-1] == len(" naïve 日本 text".encode())
    a = sum(len(g.split("|")[0].split(",")) for g in one["groups"].split(";"))
    assert a == one["n_a"] and sum(one["times"]) == one["n_groups"]
    assert (two["groups"], two["cuts"], two["n_groups"], two["pairs"]) == ("", b"", 0, [])


def test_empty_table_and_counts_follow_the_corpus(spark):
    assert A.aligned_counts(frame(spark, []), *A.default_files()).collect() == []
    rows = stored(A.align_documents(frame(spark, [(1, "the the the"), (2, "the")]), *A.default_files()), "aligned")
    links = {r["pair"]: (r["links"], r["best"]) for r in A.pair_links(rows).collect()}
    assert list(links.values()) == [(4, True)]
