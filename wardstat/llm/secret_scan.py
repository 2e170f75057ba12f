r"""Secrets in texts, found through a trigram inverted index.

*Queries.*  Every rule is a regular expression.  Its parse tree gives the
strings that each match has to hold, and those a Boolean query over trigrams
(lower-cased): an OR of alternatives, each an AND of trigrams.  A clause that
has no string of three characters, or that would make more than
``ALTERNATIVES``, is left out, which lets more texts through and never fewer.
*Index.*  One scan of the texts writes the postings: (trigram, text) for every
trigram that some rule asks for; no query would read any other.
*Candidates.*  Postings of an alternative's trigrams are intersected by a join
with the small table of alternatives and a count for each text.  Rules without a
mandatory trigram (hex) scan all texts.
*Verification.*  Only candidates are run against their rules.  A match's place
is the running sum of what ``split`` leaves between matches and of the matches
before it.

Base rules, in this order: ``assign``, ``access``, ``hex``; then ``private``
(PEM headers), ``github``, ``slack``, ``google``, ``stripe``, ``jwt``, ``url``
(credentials inside) and ``bearer``.  ``AKIA[A-Z0-9]{12,}`` and
``[0-9a-f]{32,}`` find just what the unbounded forms leave after matches
that are too short have been dropped: a match is a whole run from its start.

Defined results: null and empty texts have no span; letters are A-Z and a-z
only; spans are code points of the whole text, end exclusive; spans of
different kinds may overlap; rows that repeat (or share a null doc_id) each
have the spans of their own text; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

import itertools
import re
from re import _constants as C
from re import _parser
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small, stored, wide_hash

#: Bounds of a derived query: strings followed at once, characters of a class
#: that are spelled out, and alternatives.
STRINGS, CLASS, ALTERNATIVES = 64, 8, 64


class Rule(NamedTuple):
    """A kind, its expression (read alike by Java, RE2 and Python), and the
    least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ["password", "passwd", "secret", "token"]), _any_case("api") + "_?" + _any_case("key")])
#: Kinds, in the order in which spans of equal start are listed.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", f"({_NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
    Rule("private", "-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{1,19}://[A-Za-z0-9._~%+-]{1,100}:[A-Za-z0-9._~%!$&*+,;=-]{1,100}@"),
    Rule("bearer", _any_case("bearer") + r"\x20+[A-Za-z0-9._~+/-]{20,}"),
)

Query = frozenset  # of alternatives, each a frozenset of trigrams


def _strings(items) -> set[str] | None:
    """The lower-cased strings that a part of an expression matches, if they
    are few; None if not."""
    out = {""}
    for op, arg in items:
        if op is C.LITERAL:
            new = {chr(arg).lower()}
        elif op is C.AT:
            new = {""}
        elif op is C.IN:
            new = set()
            for kind, value in arg:
                span = range(value, value + 1) if kind is C.LITERAL else range(value[0], value[1] + 1) if kind is C.RANGE else None
                if span is None or len(span) > 2 * CLASS:
                    return None
                new |= {chr(c).lower() for c in span}
            if len(new) > CLASS:
                return None
        elif op is C.SUBPATTERN:
            new = _strings(arg[3])
        elif op is C.BRANCH:
            parts = [_strings(x) for x in arg[1]]
            new = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 3:
            once = _strings(arg[2])
            new = None if once is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(once, repeat=n)}
        else:
            return None
        if new is None or len(out) * len(new) > STRINGS:
            return None
        out = {a + b for a in out for b in new}
    return out


def _absorbed(alternatives) -> Query:
    """Without alternatives that ask for all that another one does."""
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _clause(strings: set[str]) -> Query | None:
    found = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in found else _absorbed(found)


def _clauses(items) -> list[Query]:
    """What a match of ``items`` has to hold: all of these."""
    out, open_strings = [], {""}
    for item in items:
        new = _strings([item])
        if new is not None and len(open_strings) * len(new) <= STRINGS:
            open_strings = {a + b for a in open_strings for b in new}
            continue
        out.append(_clause(open_strings))
        open_strings = new or {""}
        op, arg = item
        if op is C.SUBPATTERN and new is None:
            out += _clauses(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
            out += _clauses(arg[2])
        elif op is C.BRANCH and new is None:
            parts = [_conjunction(_clauses(x)) for x in arg[1]]
            out.append(None if None in parts else _absorbed(frozenset().union(*parts)))
    out.append(_clause(open_strings))
    return [q for q in out if q]


def _conjunction(clauses: list[Query]) -> Query | None:
    """One OR of ANDs; clauses that would make too many are left out."""
    out = None
    for q in sorted(clauses, key=len):
        met = q if out is None else _absorbed({a | b for a in out for b in q})
        if len(met) <= ALTERNATIVES:
            out = met
    return out


def trigram_query(pattern: str) -> Query | None:
    """The Boolean trigram query of an expression, or None if its matches
    need not hold any trigram."""
    return _conjunction(_clauses(_parser.parse(pattern)))


def forward(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """doc_id, the text's key (two hashes of doc_id and text) and which of
    ``trigrams`` (by number) its lower-cased text holds."""
    k1, k2 = wide_hash("doc_id", "text")
    # Lower-cased once, below the projection that looks for every trigram.
    texts = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)])) if trigrams \
        else F.array().cast("array<int>")
    return texts.select("doc_id", "k1", "k2", held.alias("held"))


def postings(rows: DataFrame) -> DataFrame:
    """trigram, k1, k2, sorted by trigram inside each file, so that a query
    skips the row groups of others."""
    return rows.select(F.explode("held").alias("trigram"), "k1", "k2").sortWithinPartitions("trigram", "k1", "k2")


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, Query]) -> DataFrame:
    """k1, k2, kinds: the rules for which a text holds all trigrams of one of
    the alternatives."""
    number = {t: i for i, t in enumerate(trigrams)}
    rows = [(kind, a, number[t], len(alt)) for kind, q in queries.items()
            for a, alt in enumerate(sorted(map(sorted, q))) for t in alt]
    asked = index.sparkSession.createDataFrame(rows, "kind string, alt int, trigram int, need int")  # bounded by the rules
    met = index.join(F.broadcast(asked), "trigram").groupBy("k1", "k2", "kind", "alt", "need").agg(
        F.count_distinct("trigram").alias("held")).filter("held = need")
    return met.groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))


def verified(docs: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...], everywhere: set[str]) -> DataFrame:
    """k1, k2, kind (number), start, end of every span: candidates against
    their rules, all texts against the rules in ``everywhere``."""
    text = F.coalesce("text", F.lit(""))
    k1, k2 = wide_hash("doc_id", "text")
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).join(small(chosen), ["k1", "k2"], "left")
    tried = []
    for n, r in enumerate(rules):
        asked = F.lit(True) if r.kind in everywhere else F.array_contains("kinds", r.kind)
        pattern = F.lit(r.pattern)
        tried.append(F.when(asked & F.rlike("text", pattern), F.struct(
            F.lit(n).alias("kind"), F.transform(F.split("text", r.pattern, -1), F.char_length).alias("gaps"),
            F.regexp_extract_all("text", pattern, F.lit(0)).alias("found"))))
    hits = rows.select("k1", "k2", F.explode(F.array_compact(F.array(*tried))).alias("r"))
    each = hits.select("k1", "k2", "r.kind", F.posexplode(F.arrays_zip("r.gaps", "r.found")).alias("i", "x"))
    each = each.select("k1", "k2", "kind", "i", F.col("x.gaps").alias("gap"), F.col("x.found").alias("found"),
                       F.coalesce(F.char_length("x.found"), F.lit(0)).alias("size"))
    # Rows that repeat have the same key and the same matches.
    each = each.dropDuplicates(["k1", "k2", "kind", "i"])
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("k1", "k2", "kind").orderBy("i"))
    each = each.withColumn("end", end).filter("found IS NOT NULL")
    for n, r in enumerate(rules):
        if r.least:
            each = each.filter((F.col("kind") != n) | (F.char_length(F.regexp_extract("found", r.pattern, r.group)) >= r.least))
    return each.select("k1", "k2", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans (array of start, kind, end, sorted by start and the
    rules' order) of every row."""
    docs = docs.select("doc_id", "text")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    everywhere = {kind for kind, q in queries.items() if q is None}
    queries = {kind: q for kind, q in queries.items() if q is not None}
    trigrams = sorted({t for q in queries.values() for alt in q for t in alt})
    rows = stored(forward(docs, trigrams), "trigrams-of-texts")
    index = stored(postings(rows), "postings")
    chosen = stored(candidates(index, trigrams, queries), "candidates")
    found = stored(verified(docs, chosen, rules, everywhere), "spans")
    spans = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return rows.join(spans, ["k1", "k2"], "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def listed(found: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans as text."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    word = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    numbers = [n for n, r in enumerate(rules) if r.kind in base]
    own = F.filter("spans", lambda s: s["kind"].isin(numbers))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{rules[n].kind}") for n in numbers]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(own, word), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", word), ",").alias("spans"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256, spans."""
    return listed(secrets(documents(spark, sf_dir, "doc_id", "text")))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Every text against every rule, without an index.
ORACLE = f"""
WITH rules(kind, name, pattern, grp, least) AS (VALUES {', '.join(
    f'({n}, {_quoted(r.kind)}, {_quoted(r.pattern)}, {r.group}, {r.least})' for n, r in enumerate(RULES))}),
texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
""" + ",\n".join(f"""hit{n} AS (
  SELECT row, {n} AS kind, regexp_extract_all(text, {_quoted(r.pattern)}, 0) AS found,
         regexp_extract_all(text, {_quoted(r.pattern)}, {r.group}) AS part, regexp_split_to_array(text, {_quoted(r.pattern)}) AS gaps
  FROM texts WHERE regexp_matches(text, {_quoted(r.pattern)}))""" for n, r in enumerate(RULES)) + f""",
hits AS ({' UNION ALL '.join(f'SELECT * FROM hit{n}' for n in range(len(RULES)))}),
each AS (SELECT row, kind, found, part, gaps, unnest(range(1, len(found) + 1)) AS i FROM hits),
placed AS (
  SELECT row, kind, length(found[i]) AS size, length(part[i]) AS held,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0) AS stop
  FROM each),
spans AS (
  SELECT placed.row, placed.kind, (stop - size)::BIGINT AS start, rules.name || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span
  FROM placed JOIN rules ON rules.kind = placed.kind WHERE held >= least),
lists AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN lists ON lists.row = texts.row
"""
