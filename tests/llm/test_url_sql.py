"""The URL query's SQL on pages with links of every form."""

import duckdb

from wardstat.llm import urls

PAGES = [
    ("http://A.org/d/e?y=1", '<link rel=canonical href="/page">'), ("http://a.org/page.html", None), ("https://www.a.org/page?utm_source=x", ""),
    ("http://b.io/p", "<link rel='canonical' href='//bad.net/p?x=1&amp;z=2'>"), ("ftp://bad.net/p/?z=2&x=1#f", None),
    ("http://c.io/d/e", '<link href="other" rel="canonical">'), ("http://c.io/d/other/", '<meta http-equiv="refresh" content="0; url=http://x.org/fr/">'),
    ("http://x.org/fr/", None), ("http://d.io/a/b/c", "<LINK REL=canonical HREF=../up/./z>"), ("http://d.io/a/up/z", '<link rel=canonical href="http://k.net/">'),
    ("http://e.io/q?a=1", '<link rel=canonical href="?q=2">'), ("http://e.io/q?q=2", "<meta http-equiv=refresh content=\"3;URL='https://bad.net/n'\">"),
    ("https://bad.net/n", None), ("http://f.io/", '<meta http-equiv="refresh" content="5">'), ("http://f.io/x", '<link rel=canonical href="javascript:x()">'),
    ("http://g.io/x", '<link rel=stylesheet href="http://bad.net/s.css">'), ("http://g.io/y", '<link rel=canonical href="">'),
    ("no scheme", '<link rel=canonical href="http://bad.net/">'), (None, '<link rel=canonical href="http://bad.net/">'), ("", None),
    ("http://h.io/1", '<p><link rel=canonical href="http://h.io/2">\n<link\nrel=canonical\nhref="http://bad.net/h#x">'), ("http://h.io/2", None),
    ("http://i.io/1", '<link rel=canonical data-href="http://bad.net/" href="#top">'), ("http://j.io/../../x", '<link rel=canonical href="../../../y">'),
    ("http://j.io/y", '<link rel=canonical href="http://bad.net/j&#38;k">'), ("http://example.net/en/1", '<link rel=canonical href="/de/2">'),
    ("http://example.net/de/2", None), ("http://www.example.com/de/1", '<meta http-equiv=refresh content="0, http://l.io/1">'), ("http://l.io/1", None),
    ("http://l.io/1", None),
]


def test_sql_follows_links_of_every_form(spark):
    rows = [(i, u, h) for i, (u, h) in enumerate(PAGES)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = sorted(con.execute(urls.ORACLE).fetchall())
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, urls.filter_urls(pages, urls.rules_frame(spark, urls.RULES)).collect()))
    assert got == want
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[i] for i in (3, 5, 8, 10, 20, 28)] == ["block", "allow", "allow", "block", "allow", "block"]
