"""Winnowed fingerprints of license templates: no find at the coverage is
without one, and spans are those of a plain alignment."""

import math
import random

import numpy as np
import pytest

from wardstat.llm import licences as L
from wardstat.llm.decontaminate import words_of


def template_of(m, seed=1):
    rng = random.Random(seed)
    return " ".join(f"t{rng.randrange(m)}" for _ in range(m))


def ids_of(index, words):
    return np.array([index.word_id.get(w, 0) for w in words], np.uint64)


def spread(words, missing, put_in, rng):
    """The template with so many words gone, as far from each other as can be,
    and as many put in between where it hurts."""
    m = len(words)
    gone = set(np.linspace(0, m - 1, missing + 2).astype(int)[1:-1].tolist())
    while len(gone) < missing:
        gone.add(rng.randrange(m))
    out = [w for i, w in enumerate(words) if i not in gone]
    for at in sorted(np.linspace(1, len(out) - 1, put_in).astype(int).tolist(), reverse=True):
        out.insert(at, b"other%d" % rng.randrange(5))
    return out


@pytest.mark.parametrize("m", [8, 12, 40, 68, 90, 171, 400, 1500])
def test_every_find_holds_a_fingerprint(m):
    """Words missing and put in, up to the bounds, spread so that runs are short."""
    index = L.TemplateIndex([("T", template_of(m))])
    words = words_of(template_of(m).encode())
    rng = random.Random(m)
    n = index.needed(0, L.COVERAGE)
    assert (index.run(0)[0] >= 2) == (math.ceil(n / (m - n + L.BAND + 1)) >= 2)
    for _ in range(12):
        text = spread(words, m - n, rng.choice([0, L.BAND // 2, L.BAND]), rng)
        text = [b"before"] * rng.randrange(20) + text + [b"after"] * 5
        assert index.candidates(ids_of(index, text)).get(0), m


@pytest.mark.parametrize("k,w", [(1, 1), (2, 1), (2, 3), (3, 4), (5, 2)])
def test_winnowing_takes_the_rightmost_least_of_every_window(k, w):
    rng = random.Random(k * 10 + w)
    ids = np.array([rng.randrange(4) for _ in range(200)], np.uint64)
    h = L.run_hashes(ids, k)
    rows = {}
    for i in range(len(ids) - k + 1):
        rows.setdefault(tuple(ids[i:i + k].tolist()), set()).add(int(h[i]))
    assert all(len(x) == 1 for x in rows.values()) and len({x for v in rows.values() for x in v}) == len(rows)
    want = set()
    for i in range(len(h) - w + 1):
        least = min(h[i:i + w])
        want.add(max(j for j in range(i, i + w) if h[j] == least))
    assert L.winnowed(h, w).tolist() == sorted(want)
    assert L.winnowed(h[:0], w).tolist() == [] and len(L.winnowed(h[:1], w)) == 1


def test_full_texts_take_runs_and_short_notices_words():
    index = L.TemplateIndex(L.TEMPLATES)
    lengths = [len(x) for x in index.ids]
    assert max(lengths) > 150 and {index.run(t)[0] for t, m in enumerate(lengths) if m > 150} <= set(range(2, L.RUN_WORDS + 1))
    assert all(index.run(t) == (0, 0) for t, m in enumerate(lengths) if m < 20)


def plain_span(text, template):
    """Most words in order, then the shortest span: a full table."""
    best = {(-1): (0, 0)}
    rows = [(0, None, None)] * (len(template) + 1)
    found = (0, 0, 0)
    for at, word in enumerate(text):
        new = [rows[0]]
        for j, want in enumerate(template, 1):
            options = [rows[j], new[j - 1]]
            if word == want:
                matched, first, _ = rows[j - 1]
                options.append((matched + 1, at if first is None else first, at))
            new.append(max(options, key=lambda o: (o[0], o[1] if o[1] is not None else -1, -(o[2] or 0))))
        rows = new
        matched, first, last = rows[-1]
        if matched and (matched, -(last - first)) > (found[0], -(found[2] - found[1])):
            found = matched, first, last
    return found


@pytest.mark.parametrize("seed", range(6))
def test_spans_match_a_full_table(seed):
    """Templates without a word twice, so the best alignment is the only one."""
    rng = random.Random(seed)
    template = [f"w{i}" for i in range(rng.choice([12, 45, 120]))]
    index = L.TemplateIndex([("T", " ".join(template))])
    for _ in range(25):
        text = list(template)
        for _ in range(rng.randrange(len(template) // 8 + 1)):
            at = rng.randrange(len(text))
            text[at:at + rng.randrange(2)] = [f"x{rng.randrange(9)}"] * rng.randrange(2)
        text = [f"n{i}" for i in range(rng.randrange(30))] + text + ["end"] * 5
        want = plain_span(text, template)
        got = index.finds(ids_of(index, [w.encode() for w in text]))
        if want[0] >= index.needed(0, L.COVERAGE):
            assert [(f["matched"], f["first"], f["last"]) for f in got] == [want]
        else:
            assert got == []


def test_a_very_long_text(spark):
    noise = " ".join(f"n{i % 977}" for i in range(300_000))
    full = L.TEMPLATES[-1][1]
    m = len(words_of(full.encode()))
    rows = [(1, f"{noise} {full} {noise} {L.TEMPLATES[0][1]}"), (2, f"{full} " * 200), (None, full)]
    got = {r["doc_id"]: r["finds"] for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    short = len(words_of(L.TEMPLATES[0][1].encode()))
    assert [(f["license"], f["first"], f["last"]) for f in got[1]] == [
        ("Zlib", 300_000, 300_000 + m - 1), ("MIT", 600_000 + m, 600_000 + m + short - 1)]
    assert [(f["first"], f["matched"]) for f in got[2]] == [(i * m, m) for i in range(200)]
    assert len(got[None]) == 1
