"""Line dedup and URL filters against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardstat.llm import lines, urls
from wardstat.llm.components import components

DOC = "doc_id long, text string, lang string, h1 string, n_lines string"
LONG = "this line is surely long enough"


def plain(docs, min_docs=3, min_chars=20):
    """(doc_id, n_lines, n_dropped, sha256) for every row, in order."""
    def key(line):
        s = line.strip(" \t\n\x0b\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                holders[key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if doc_id is None or len(holders.get(key(x), ())) < min_docs or doc_id == max(holders[key(x)])]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def got(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "en", "x", "y") for d, t in docs], DOC)
    out = lines.drop_shared_lines(df, **kw).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("sha"))
    return sorted((tuple(r) for r in out.collect()), key=str)


CASES = [
    [(1, f"{LONG}\nown"), (2, f" {LONG.upper()}\t"), (3, f"a\n{LONG}\nb\n{LONG}"), (4, None), (5, ""), (6, "\n\n")],
    [(1, LONG), (2, LONG), (3, "other")],  # two documents are too few
    [(7, LONG), (7, LONG), (7, f"{LONG}\nx")],  # repeated ids are one document
    [(None, LONG), (1, LONG), (2, LONG), (3, LONG)],
    [(i, "ÄÖÜ É ist lang genug, ja sicher\nÀ") for i in range(5)] + [(9, "äöü é ist lang genug, ja sicher")],
    [(i, "\n".join([LONG] * 2000 + [f"line {i} of its own, {j}" for j in range(500)])) for i in range(4)],
]


@pytest.mark.parametrize("docs", CASES)
def test_line_dedup_matches_plain_python(spark, docs):
    assert got(spark, docs) == sorted(plain(docs), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (6, 3)])
def test_batches_and_compaction_do_not_change_the_result(spark, batches, fanout):
    docs = [(i, "\n".join(f"shared line number {i % k} of all documents" for k in (2, 3, 5, 7))) for i in range(60)]
    assert got(spark, docs, batches=batches, fanout=fanout, buckets=4) == sorted(plain(docs), key=str)


def test_runs_compact_into_levels(spark):
    runs = lines.LineRuns(spark, fanout=2, buckets=4)
    try:
        for b in range(4):
            df = spark.createDataFrame([(b, 1, 1), (b, 2, b)], "doc_id long, h1 long, h2 long")
            runs.add(df)
        assert [len(x) for x in runs.levels] == [0, 0, 1]
        assert [tuple(r) for r in runs.shared(3).collect()] == [(1, 1, 3)]
    finally:
        runs.drop()


def test_empty_documents(spark):
    assert got(spark, []) == []


def test_pipeline_form_keeps_columns_and_null_text(spark):
    df = spark.createDataFrame([(1, LONG, "en", "s", 31), (2, LONG, "en", "s", 31), (3, LONG + "\nx", None, "s", 33), (4, None, "en", "s", 0)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(map(tuple, lines.without_shared_lines(df).collect()))
    assert out == [(1, "", "en", "s", 0), (2, "", "en", "s", 0), (3, LONG + "\nx", None, "s", 33), (4, None, "en", "s", 0)]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def verdicts(spark, rows, redirects=None):
    out = urls.filter_urls(pages(spark, rows), urls.rules_frame(spark, urls.RULES), redirects)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_hosts_paths_and_rules(spark):
    got = verdicts(spark, [
        ("HTTP://A.Example.NET/en/1?q#f", None), ("http://example.net/EN/1", None), ("http://net", None), ("http://net/", ""),
        ("x://y.example.com/de/", None), ("http://notexample.com/de/", None), ("http://b.org/fr/?x", None), ("no scheme", None),
        (None, None), ("", None), ("http://a.net#x://b/c", None), ("http://a.org/fr", None)])
    assert got == {  # 2 is an alias of 3
        0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("example.net", "/EN/1", "net/", "block"),
        2: ("net", "", None, "block"), 3: ("net", "/", "net/", "block"), 4: ("y.example.com", "/de/", "example.com/de/", "block"),
        5: ("notexample.com", "/de/", None, "allow"), 6: ("b.org", "/fr/", "org/fr/", "allow"), 7: ("", "", None, "allow"),
        8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("a.net", "", None, "allow"), 11: ("a.org", "/fr", None, "allow")}


def test_block_spreads_over_aliases_and_allow_wins(spark):
    canon = '<html><link href="{}" rel="canonical"></html>'
    refresh = '<meta http-equiv="refresh" content="0; url={}">'
    got = verdicts(spark, [
        ("http://one.io/a", canon.format("http://bad.net/a")), ("http://bad.net/a", None),  # blocked alias
        ("http://two.io/b", refresh.format("http://three.io/b")), ("http://three.io/b/", canon.format("http://bad.net/a")),
        ("http://x.org/fr/", canon.format("http://bad.net/q")), ("http://bad.net/q", None),
        ("http://four.io/c", canon.format("http://bad.net/q")),  # an alias that a rule allows
        ("http://four.io/c?utm_source=f", None), ("http://alone.io/", canon.format("relative/page"))])
    assert [got[i][3] for i in range(9)] == ["block", "block", "block", "block", "allow", "block", "allow", "allow", "allow"]


def test_redirect_table_joins_components(spark):
    redirects = spark.createDataFrame([("http://s.io/1", "http://s.io/2"), ("http://s.io/2", "http://k.net/"), (None, "http://s.io/1")], "src string, dst string")
    got = verdicts(spark, [("http://s.io/1", None), ("http://s.io/9", None)], redirects)
    assert [got[i][3] for i in range(2)] == ["allow", "allow"]  # no page of the blocked host is there
    got = verdicts(spark, [("http://s.io/1", None), ("http://k.net/", None)], redirects)
    assert [got[i][3] for i in range(2)] == ["block", "block"]


def test_empty_pages(spark):
    assert verdicts(spark, []) == {}


def test_components_of_paths_cycles_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(50)}, 301: 300, 302: 300}


def test_links_of_every_form_are_resolved(spark):
    far = "https://b.org/x?" + "k" * 3000 + "=1"
    cases = [
        ('<link rel=canonical href="/page">', "http://a.org/page"),
        ("<link rel='canonical' href='//c.org/p?x=1'>", "http://c.org/p?x=1"),
        ('<link href="other" rel="canonical">', "http://a.org/d/other"),
        ('<LINK REL=canonical HREF=../up/./z>', "http://a.org/up/z"),
        ('<link rel=canonical href="?q=2">', "http://a.org/d/e?q=2"),
        ('<link rel=canonical href="https://b.org/x?a=1&amp;b=2">', "https://b.org/x?a=1&b=2"),
        (f'<link rel=canonical href="{far}">', far),
        ('<link rel=canonical title="' + "t" * 3000 + '" href="/page">', "http://a.org/page"),
        ('<meta http-equiv="refresh" content="0; url=/new">', "http://a.org/new"),
        ("<meta http-equiv=refresh content=\"3;URL='https://b.org/n'\">", "https://b.org/n"),
        ('<meta http-equiv="refresh" content="5">', None),
        ('<link rel=canonical href="javascript:x()">', None),
        ('<link rel=stylesheet href="/s.css">', None),
        ('<link rel=canonical href="">', None),
    ]
    df = spark.createDataFrame([(i, "http://a.org/d/e?y=1", h) for i, (h, _) in enumerate(cases)], "i int, url string, html string")
    got = {r["i"]: r["l"] for r in df.select("i", urls.links(F.col("html"), F.col("url")).alias("l")).collect()}
    assert got == {i: [w] if w else [] for i, (_, w) in enumerate(cases)}
    loose = spark.createDataFrame([("a.org/d", '<link rel=canonical href="/p">'), (None, '<link rel=canonical href="/p">'), ("http://a.org", None),
                                   ("http://a.org", '<link rel=canonical href="p">')], "url string, html string")
    assert [r["l"] for r in loose.select(urls.links(F.col("html"), F.col("url")).alias("l")).collect()] == [[], [], None, ["http://a.org/p"]]


def test_a_rule_reaches_an_alias_by_a_relative_link(spark):
    rows = [(1, "http://a.test/x", '<link rel=canonical href="/bad/y">'), (2, "http://a.test/bad/y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages, urls.rules_frame(spark, [("block", "a.test", "/bad/")])).collect()}
    assert got == {1: "block", 2: "block"}
