"""Large groups of copies around the threshold: links as by all pairs, and
work that follows the members and not the pairs."""

import random

import numpy as np
import pytest

from wardstat.llm import near_dups as N


def around_threshold(n, seed, words=200, edits=(2, 3, 4)):
    """Variants of one text, each with a few words of its own: similarities of
    three-word shingles lie on both sides of 0.85."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for d in range(n):
        own = list(base)
        for k in range(rng.choice(edits)):
            own[rng.randrange(words)] = f"x{d}_{k}"
        out.append((d, " ".join(own)))
    return out


def shingle_sets(docs, size=3):
    number, rows = {}, []
    for _, text in docs:
        w = text.lower().split()
        rows.append(sorted({number.setdefault(tuple(w[i:i + size]), len(number)) for i in range(len(w) - size + 1)}))
    return rows, len(number)


def all_links(docs, percent=85):
    """(i, j) of every linked pair, by one product of 0/1 matrices a block."""
    rows, width = shingle_sets(docs)
    # Shingles of one document never meet another's.
    seen = np.bincount(np.concatenate(rows), minlength=width)
    shared = np.cumsum(seen > 1) - 1
    m = np.zeros((len(rows), int((seen > 1).sum())), np.float32)
    for i, r in enumerate(rows):
        r = np.array(r)
        m[i, shared[r[seen[r] > 1]]] = 1
    size = np.array(list(map(len, rows)))
    for at in range(0, len(rows), 500):
        common = (m[at:at + 500] @ m.T).astype(np.int64)
        union = size[at:at + 500, None] + size[None, :] - common
        i, j = np.nonzero(100 * common >= percent * union)
        yield from zip((i + at)[i + at < j].tolist(), j[i + at < j].tolist(), strict=True)


def components_of(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("n,edits", [(500, (2, 3, 4)), (500, (5, 6)), (2000, (3, 4))])
def test_groups_around_the_threshold(spark, n, edits):
    docs = around_threshold(n, n, edits=edits)
    links = list(all_links(docs))
    want = components_of(n, links)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(frame(spark, docs)).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert found >= 0.99 * len(links)
    assert all(want[d] == want[c] for d, c in got.items())  # nothing is linked that is not
    assert sum(got[d] == want[d] for d in got) >= 0.99 * n


def test_edges_follow_the_members(spark, monkeypatch):
    """Twice the group, not four times the pairs that are handed on."""
    handed = {}
    real = N.stored

    def counted(df, name):
        out = real(df, name)
        if name in ("likely-edges", "exact-edges", "likely-pairs"):
            handed[name] = out.count()
        return out
    monkeypatch.setattr(N, "stored", counted)
    rows = []
    for n in (400, 800):
        N.near_duplicates(frame(spark, around_threshold(n, 5, edits=(3, 4, 5)))).count()
        rows.append(sum(handed.values()))
    assert 0 < rows[1] <= 2.6 * rows[0]


def test_small_blocks_change_nothing(spark, monkeypatch):
    docs = around_threshold(150, 3, edits=(3, 4, 5))
    want = sorted(map(tuple, N.near_duplicates(frame(spark, docs)).collect()))
    assert {r[2] for r in want} == set(components_of(150, all_links(docs)))
    monkeypatch.setattr(N, "BLOCK", 4_000)
    assert sorted(map(tuple, N.near_duplicates(frame(spark, docs)).collect())) == want
