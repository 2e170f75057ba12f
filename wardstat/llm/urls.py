"""URL filters with redirect equivalence (DataFrame only).

*Rules.*  A rule is (action, host, path).  It fits a URL whose host is the
rule's or a subdomain of it and whose path starts with the rule's; of the
rules that fit, the longest decides (of equal ones, allow).  Rules are a
table: a URL's host suffixes meet the rules' hosts in an equi-join, so the
work grows with the URLs and not with URLs times rules.

*Aliases.*  Pages are the same node if their URLs differ only in scheme,
``www.``, fragment, tracking parameters, a trailing slash or an ``.html``
ending (their canonical URL).  Further edges come from the pages: the target
of ``<link rel=canonical>`` and of ``<meta http-equiv=refresh>`` (relative
ones are resolved against the page's URL, ``&amp;`` is read as ``&``), and a
table of redirects if there is one.  Distributed connected components over these
edges put every alias in one component.

*Decisions.*  A URL that a rule fits has that rule's verdict.  Any other URL
takes its component's: allow if a rule allows any of its aliases (explicit
allow precedence), else block if a rule blocks one, else allow.  Decisions are
counted per node and then per component (partial sums first), so a component
of any size, or a host with a third of all pages, is one row per task.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and has no alias; null html has no links; repeated pages
are one node and keep a row each; no rules: everything is allowed; an empty
table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table
from .components import components

#: (action, host, path) of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Query parameters that tell nothing about the page.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid)="


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The name of a URL's node: equal for trivial variants of one page."""
    rest = _rest(url)
    host = F.regexp_replace(host_of(url), r"\Awww\.", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html?)\z", "")
    query = F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(rest.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute URL, read from the page at ``url``;
    empty if it is none (another kind of scheme, or a relative one in a page without ``://``)."""
    site = F.coalesce(F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1), F.lit(""))
    scheme = F.coalesce(F.regexp_extract(url, r"(?s)\A(.*?:)//", 1), F.lit(""))
    way = F.regexp_extract(target, r"\A[^?#]*", 0)
    # Relative paths begin at the page's last slash.
    way = F.when(F.startswith(way, F.lit("/")), way).otherwise(F.concat(
        F.regexp_extract(F.concat(F.lit("/"), F.regexp_replace(path_of(url), r"\A/", "")), r"(?s)\A.*/", 0), way))
    parts = F.aggregate(F.split(way, "/"), F.array().cast("array<string>"), lambda done, part: F.when(
        part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(part == ".", done).otherwise(F.concat(done, F.array(part))))
    whole = F.concat(site, F.array_join(parts, "/"), F.regexp_extract(target, r"(?s)\A[^?#]*(.*)", 1))
    return (F.when(target.rlike(r"(?i)\A[a-z][a-z0-9+.-]*://"), target)
            .when(target.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:") | (target == "") | (site == ""), "")
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
            .when(F.startswith(target, F.lit("#")), url)
            .when(F.startswith(target, F.lit("?")), F.concat(site, path_of(url), target))
            .otherwise(whole))


def links(html: Column, url: Column) -> Column:
    """Absolute targets of canonical links and refreshes in the page at ``url``."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), F.lit(0))

    def target(tag: Column) -> Column:
        href = r"(?is)(?<![\w-])href\s*=\s*(?:\"([^\">]*)|'([^'>]*)|([^\s\"'>]+))"
        content = r"(?is)(?<![\w-])content\s*=\s*[\"']?[\s\d.]*[;,\s]\s*(?:url\s*=\s*[\"']?\s*)?+([^\"'\s>]+)"
        named = (F.when(tag.rlike(r"(?is)\A<link\b.*\brel\s*=\s*[\"']?canonical\b"), F.concat(*(F.regexp_extract(tag, href, i) for i in (1, 2, 3))))
                 .when(tag.rlike(r"(?is)\A<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract(tag, content, 1)).otherwise(""))
        return F.regexp_replace(F.trim(named), r"(?i)&(?:amp|#0*38|#x0*26);", "&")
    return F.filter(F.transform(F.transform(tags, target), lambda t: resolved(t, url)), lambda u: u != "")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([(a, h.lower(), p) for a, h, p in rules], "action string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of every distinct (host, path): host, path,
    rule (host and path of the rule) and action; those without one are left out."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = (urls.select("host").filter("host != ''").distinct()
             .select("host", F.explode(F.array_distinct(suffixes)).alias("rule_host")))
    # Rules are few per host: a host meets its own rules only, and the
    # longest fitting one is chosen where the URL is.
    own = (hosts.join(rules, "rule_host").groupBy("host")
           .agg(F.collect_set(F.struct(F.concat("rule_host", "rule_path").alias("rule"),
                                       "rule_path", "action")).alias("rules")))
    met = urls.select("host", "path").distinct().join(own, "host")
    fit = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(
        F.char_length(r["rule"]).alias("n"), (r["action"] == "allow").alias("allow"), r["rule"].alias("rule"))))
    return (met.select("host", "path", best.alias("best")).filter("best IS NOT NULL")
            .select("host", "path", F.col("best.rule").alias("rule"),
                    F.when(F.col("best.allow"), "allow").otherwise("block").alias("action")))


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and component of every page.

    ``redirects`` (src, dst) are URLs known to lead to one another, besides
    what the pages say themselves."""
    src = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       canonical(F.col("url")).alias("node"), links(F.col("html"), F.col("url")).alias("links"))
    src = stored(src, "pages")
    found = stored(match_rules(src, rules), "page-rules")
    edges = src.select("node", F.explode("links").alias("to")).select(F.col("node").alias("src"), canonical(F.col("to")).alias("dst"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst")))
    joined = components(edges)
    judged = src.join(found, ["host", "path"], "left")
    # One row per node, then one per component; aliases of no page may join pages.
    nodes = judged.filter("node IS NOT NULL").groupBy("node").agg(
        F.max(F.col("action") == "allow").alias("allow"), F.max(F.col("action") == "block").alias("block"))
    named = nodes.join(joined, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), "allow", "block")
    named = stored(named, "page-nodes")
    verdicts = named.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    passed = F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block").otherwise("allow")
    per_node = named.select("node", "component").join(verdicts, "component").select("node", "component", passed.alias("passed"))
    out = judged.join(per_node, "node", "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("action", "passed", F.lit("allow")).alias("verdict"), "component")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: host, path, rule, verdict (and its component)."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules_frame(spark, RULES))


def _sql_rest(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) END"


def _sql_host(rest: str) -> str:
    return (f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            "'abcdefghijklmnopqrstuvwxyz'), '')")


def _sql_path(rest: str) -> str:
    return f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')"


def _sql_node(rest: str) -> str:
    kept = (f"array_to_string(list_sort(list_filter(string_split(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '&'), "
            "lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)=', 'i'))), '&')")
    return (f"CASE WHEN {rest} IS NOT NULL THEN regexp_replace({_sql_host(rest)}, '^www\\.', '') || "
            f"regexp_replace({_sql_path(rest)}, '(/|\\.html?)$', '') || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END END")


#: The same rules as above for hosts, rules, nodes, links in every form, and components.
ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, """ + _sql_rest("url") + r""" AS rest FROM pages),
n AS (SELECT page_id, url, html, """ + f'{_sql_host("rest")} AS host, {_sql_path("rest")} AS path, {_sql_node("rest")} AS node' + r""" FROM p),
rules(action, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT n.page_id, r.host || r.path AS rule, r.action,
         row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.host || r.path) DESC, r.action) AS k
  FROM n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)),
own AS (SELECT n.page_id, n.host, n.path, n.node, f.rule, f.action FROM n LEFT JOIN fits f ON n.page_id = f.page_id AND f.k = 1),
tags AS (
  SELECT node, path, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS site, regexp_extract(url, '(?s)^(.*?:)//', 1) AS scheme, url,
         unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM n WHERE node IS NOT NULL),
named AS (
  SELECT *, regexp_replace(trim(CASE
      WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN
        regexp_extract(tag, '(?is)[^\w-]href\s*=\s*(?:"([^">]*)|''([^''>]*)|([^\s"''>]+))', 1)
        || regexp_extract(tag, '(?is)[^\w-]href\s*=\s*(?:"([^">]*)|''([^''>]*)|([^\s"''>]+))', 2)
        || regexp_extract(tag, '(?is)[^\w-]href\s*=\s*(?:"([^">]*)|''([^''>]*)|([^\s"''>]+))', 3)
      WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN
        CASE WHEN regexp_matches(tag, '(?is)[^\w-]content\s*=\s*["'']?[\s\d.]*[;,\s]\s*url\s*=') THEN
          regexp_extract(tag, '(?is)[^\w-]content\s*=\s*["'']?[\s\d.]*[;,\s]\s*url\s*=\s*["'']?\s*([^"''\s>]+)', 1)
        ELSE regexp_extract(tag, '(?is)[^\w-]content\s*=\s*["'']?[\s\d.]*[;,\s]\s*([^"''\s>]+)', 1) END
      ELSE '' END), '(?i)&(amp|#0*38|#x0*26);', '&', 'g') AS t
  FROM tags),
ways AS (
  SELECT *, CASE WHEN starts_with(regexp_extract(t, '^[^?#]*'), '/') THEN regexp_extract(t, '^[^?#]*')
            ELSE regexp_extract('/' || regexp_replace(path, '^/', ''), '(?s)^.*/') || regexp_extract(t, '^[^?#]*') END AS way FROM named),
targets AS (
  SELECT node, CASE
      WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t
      WHEN t = '' OR site = '' OR regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') THEN ''
      WHEN starts_with(t, '//') THEN scheme || t
      WHEN starts_with(t, '#') THEN url
      WHEN starts_with(t, '?') THEN site || path || t
      ELSE site || list_reduce(string_split(way, '/'), lambda done, part: CASE WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '')
                               WHEN part = '.' THEN done ELSE done || '/' || part END)
           || regexp_extract(t, '(?s)^[^?#]*(.*)', 1) END AS target FROM ways),
ends AS (SELECT node AS src, """ + _sql_rest("target") + r""" AS rest FROM targets WHERE target <> ''),
links AS (SELECT src, """ + _sql_node("rest") + r""" AS dst FROM ends WHERE rest IS NOT NULL),
both_ways AS (SELECT src, dst FROM links WHERE src <> dst UNION SELECT dst, src FROM links WHERE src <> dst),
reach(node, other) AS (
  SELECT DISTINCT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
placed AS (SELECT own.*, coalesce(l.component, own.node) AS component FROM own LEFT JOIN least l ON own.node = l.node),
per AS (SELECT component, bool_or(action = 'allow') AS allow, bool_or(action = 'block') AS block FROM placed
        WHERE component IS NOT NULL GROUP BY component)
SELECT placed.page_id, placed.host, placed.path, placed.rule,
       coalesce(placed.action, CASE WHEN per.allow THEN 'allow' WHEN per.block THEN 'block' ELSE 'allow' END) AS verdict, placed.component
FROM placed LEFT JOIN per ON placed.component = per.component
"""
