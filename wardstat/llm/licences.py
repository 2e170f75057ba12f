"""License scans: an inverted index of template words and banded alignment.

Templates are license texts and notices, a small table whose size is checked.
A find matches ``n`` of a template's ``m`` words and has up to ``BAND`` words put
in between, so its matched words lie in at most ``m - n + BAND + 1`` unbroken
runs, and the longest has ``ceil(n / (m - n + BAND + 1))`` words or more.  Where
that is two at least, the template is winnowed for it: rolling hashes of ``k``
words, the least of every ``w`` in a row (the rightmost of equal ones), with
``k + w - 1`` the length of that run, so every find holds one of the chosen.
Shorter templates have no such run (of ten words, two may be missing and any
two others parted); there, every find matches at least one of any ``m - n + 1``
places, and so many, those of the rarest words, are indexed by themselves.

The inverted index, fingerprint -> (template, place), is broadcast.  Every word
and every run of ``k`` words of a document is looked up in it; a hit whose
surroundings hold enough of the template's words (each as often
as the template has it) is a candidate, and the candidate is aligned to the
template by a banded sequence alignment (matches count 1, and a gap or
another word 0, along a band of diagonals to both sides).  Reported are the share of the
template's words matched in order (coverage) and the span of the text between
the first and the last matched word.  Of overlapping finds the one that matches more words stays.

Finds of one template do not overlap: what lies outside the accepted ones is
aligned again until no fingerprint begins another, so notices that follow
each other closely are all found.  A span whose words make two finds by
themselves is those two.

The band is ``BAND`` diagonals plus the words that a find may lack, so a text that
matches enough words meets the index and the band, wherever words are missing
or others stand in their place, with up to ``BAND`` words put in between.

Words are runs of letters and digits, A-Z lower-cased, so line breaks,
comment marks and punctuation do not matter.

Defined results: null or empty text, and text without words, has no find; a
template without words is never found; equal templates are both reported;
texts are scanned whole; repeated rows have equal results, rows of a null doc_id one each; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_arrow, utf8
from .decontaminate import words_of

#: Words put into a template's text that its alignment bears.
BAND = 16
#: Share of a template's words that a find has to match.
COVERAGE = 0.8
#: Words that all templates together may have (they are broadcast).
TEMPLATE_WORDS = 2_000_000
#: Bits of a place within an alignment's piece of text.
_BITS = 21
_LAST = (1 << _BITS) - 1

# Public license notices and short texts, as their licences print them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
]


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Words of a fingerprint, at most.
RUN_WORDS = 5


def run_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` words in a row: a polynomial of their ids that
    rolls on by one multiplication, one word in and one out; mixed at the end,
    so that the least of them is no particular word."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):  # all places at once, so k steps and not n
        h = h * _BASE + ids[j:j + n]
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash of every ``w`` in a row, the rightmost of
    equal ones; of all of them if there are fewer."""
    w = min(w, len(hashes))
    if not w:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(windows)) + (w - 1) - np.argmin(windows[:, ::-1], axis=1))


class TemplateIndex:
    """Words, fingerprints and lengths of the templates, as it is broadcast."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE):
        self.names, self.ids, self.word_id = [], [], {}
        self.coverage = coverage
        self.by_word: dict[int, list[tuple[int, int]]] = {}
        for name, text in templates:
            words = words_of((text or "").encode())
            if not words:
                continue
            self.names.append(name)
            self.ids.append(np.array([self.word_id.setdefault(x, len(self.word_id) + 1) for x in words], np.uint64))
            if sum(map(len, self.ids)) > TEMPLATE_WORDS:
                raise ValueError(f"templates have more than {TEMPLATE_WORDS} words; scan with parts of them")
        # By word id (0: in no template): how often the templates have it, and its length.
        often = np.bincount(np.concatenate(self.ids).astype(np.int64) if self.ids else [], minlength=len(self.word_id) + 1)
        length = np.array([0, *map(len, self.word_id)])
        self.is_key = np.zeros(len(self.word_id) + 1, bool)
        for t, ids in enumerate(self.ids):
            if len(ids) + 2 * self.band(t) > _LAST:
                raise ValueError("a template is too long for its alignment; scan with parts of it")
        self.bags = [np.unique(ids, return_counts=True) for ids in self.ids]
        #: For each length of run: its hashes, and the places of each.
        self.runs: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ids in enumerate(self.ids):
            k, w = self.run(t)
            if k:
                h = run_hashes(ids, k)
                for p in winnowed(h, w).tolist():
                    self.runs.setdefault(k, {}).setdefault(int(h[p]), []).append((t, p))
                continue
            at = ids.astype(np.int64)
            rarest = np.lexsort((np.arange(len(at)), -length[at], often[at]))
            for p in rarest[:len(at) - self.needed(t, coverage) + 1]:
                self.is_key[at[p]] = True
                self.by_word.setdefault(int(at[p]), []).append((t, int(p)))
        self.run_keys = {k: np.array(sorted(found), np.uint64) for k, found in self.runs.items()}

    def run(self, t: int) -> tuple[int, int]:
        """Words of a fingerprint and fingerprints of a window for a template,
        or (0, 0) if a find need not hold two of its words in a row."""
        n = self.needed(t, self.coverage)
        whole = math.ceil(n / (len(self.ids[t]) - n + BAND + 1))
        if whole < 2:
            return 0, 0
        k = min(RUN_WORDS, max(2, whole - 1))
        return k, whole - k + 1

    def needed(self, t: int, coverage: float) -> int:
        """Words that a find of template t matches at least."""
        return max(1, math.ceil(coverage * len(self.ids[t])))

    def band(self, t: int) -> int:
        """Diagonals to both sides of a candidate that its alignment may use."""
        return BAND + len(self.ids[t]) - self.needed(t, self.coverage)

    def holds(self, window: np.ndarray, t: int, needed: int) -> bool:
        """Whether a piece of text has so many of the template's words in any order."""
        words, counts = self.bags[t]
        at = np.minimum(np.searchsorted(words, window), len(words) - 1)
        here = np.bincount(at[words[at] == window], minlength=len(words))
        return int(np.minimum(here, counts).sum()) >= needed

    def candidates(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template: (place in the text, place where the template would
        begin) of every indexed word and run of words."""
        found: dict[int, list[tuple[int, int]]] = {}
        for k, keys in self.run_keys.items():
            h = run_hashes(ids, k)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for i in np.flatnonzero(keys[at] == h).tolist():
                for t, p in self.runs[k][int(h[i])]:
                    found.setdefault(t, []).append((i, i - p))
        for i in np.flatnonzero(self.is_key[ids]).tolist():
            for t, p in self.by_word[int(ids[i])]:
                found.setdefault(t, []).append((i, i - p))
        return found

    def align(self, ids: np.ndarray, t: int, begin: int, low: int, high: int) -> tuple[int, int, int]:
        """The most words of template t matched in order around a diagonal in
        the text from low to high (of equal ones the shortest span): matched,
        first and last matched word of the text."""
        want, band = self.ids[t], self.band(t)
        m, width = len(want), 2 * band + 1
        window = np.zeros(m + width - 1, np.uint64)
        start = begin - band
        a, b = max(low, start), min(high + 1, start + len(window))
        window[a - start:max(a, b) - start] = ids[a:max(a, b)]
        # best[d]: alignments ending on diagonal start + d, as one number:
        # matched, then first (late ones are better), then last (early ones are).
        best = np.zeros(width + 1, np.int64)
        place = np.arange(1, len(window) + 1)
        for p in range(m):
            here = best[:-1]
            hit = window[p:p + width] == want[p]
            if hit.any():
                at = place[p:p + width]
                begun = np.where(here > 0, here >> _BITS, at) << _BITS
                here = np.where(hit, begun + (1 << 2 * _BITS) + _LAST - at, here)
            # From the template's previous word: same diagonal, or one further
            # right (the template's word is missing in the text); then from the
            # left (the text has words that the template lacks).
            best[:-1] = np.maximum.accumulate(np.maximum(here, best[1:]))
        matched, first, last = best >> 2 * _BITS, (best >> _BITS) & _LAST, _LAST - (best & _LAST)
        d = int(np.lexsort((first, last - first, -matched))[0])
        return int(matched[d]), start + int(first[d]) - 1, start + int(last[d]) - 1

    def spans(self, ids: np.ndarray, t: int, begin: int, low: int, high: int, needed: int) -> list[tuple[int, int, int]]:
        """(matched, first, last) of the find around a diagonal, or of the two
        that the words of the best alignment's span make by themselves."""
        band, m = self.band(t), len(self.ids[t])
        if not self.holds(ids[max(low, begin - band):max(0, min(high + 1, begin + m + band))], t, needed):
            return []
        matched, first, last = self.align(ids, t, begin, low, high)
        if matched < needed:
            return []
        halves = []
        for cut in range(first + needed, last - needed + 2):
            left = self.align(ids, t, begin, first, cut - 1)
            right = self.align(ids, t, begin, cut, last)
            if min(left[0], right[0]) >= needed:
                halves.append((left[0] + right[0], -cut, [left, right]))
        return max(halves)[2] if needed > 1 and halves else [(matched, first, last)]

    def template_finds(self, ids: np.ndarray, t: int, hits: list[tuple[int, int]], needed: int) -> list[tuple[int, int, int]]:
        """Finds of one template that do not overlap: every indexed word
        outside the ones accepted so far is aligned again between them."""
        band, m = self.band(t), len(self.ids[t])
        taken = _Spans()
        known: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        while True:
            got = set()
            for i, begin in hits:
                low, high = taken.gap(i, len(ids))
                key = begin, max(low, begin - band), min(high, begin + m + band)
                if key not in known:
                    known[key] = self.spans(ids, t, *key, needed)
                got.update(known[key])
            accepted = [x for x in sorted(got, key=lambda x: (-x[0], x[2] - x[1], x[1])) if taken.add(x[1], x[2], x)]
            if not accepted:
                return taken.values()
            hits = [(i, begin) for i, begin in hits if not taken.overlaps(i, i)]

    def finds(self, ids: np.ndarray, coverage: float | None = None) -> list[dict]:
        """Finds of a text, best first where they overlap, in text order."""
        coverage = self.coverage if coverage is None else coverage
        got = []
        for t, hits in self.candidates(ids).items():
            for matched, first, last in self.template_finds(ids, t, hits, self.needed(t, coverage)):
                got.append((matched, matched / len(self.ids[t]), -first, -t, last))
        taken, out = _Spans(), []
        for matched, share, first, t, last in sorted(got, reverse=True):
            # Equal finds of several templates all stay.
            same = taken.at(-first)
            if taken.add(-first, last, (matched, share, last)) or same == (matched, share, last):
                out.append({"license": self.names[-t], "template": -t, "matched": matched, "coverage": share,
                            "first": -first, "last": last})
        return sorted(out, key=lambda o: (o["first"], o["template"]))


class _Spans:
    """Spans of a text that do not overlap, with a value each."""

    def __init__(self):
        self.firsts, self.lasts, self.found = [], [], {}

    def overlaps(self, first: int, last: int) -> bool:
        k = bisect_right(self.firsts, last)
        return k > 0 and self.lasts[k - 1] >= first

    def add(self, first: int, last: int, value) -> bool:
        if self.overlaps(first, last):
            return False
        k = bisect_right(self.firsts, first)
        self.firsts.insert(k, first)
        self.lasts.insert(k, last)
        self.found[first] = value
        return True

    def at(self, first: int):
        return self.found.get(first)

    def gap(self, place: int, n: int) -> tuple[int, int]:
        """First and last word around a free place that no span holds."""
        k = bisect_right(self.firsts, place)
        return (self.lasts[k - 1] + 1 if k else 0), (self.firsts[k] if k < len(self.firsts) else n) - 1

    def values(self) -> list:
        return [self.found[f] for f in self.firsts]


FOUND = ("doc_id long, n_words long, finds array<struct<license:string,template:int,matched:int,coverage:double,"
         "first:long,last:long>>")
_KIND = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("matched", pa.int32()),
                            ("coverage", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words and finds (license, template, matched words, coverage,
    first and last matched word of the text) of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(TEMPLATES if templates is None else templates, coverage))

    def task():
        index = shared.value
        get = index.word_id.get

        def step(batch):
            n_words, finds = [], []
            for text in utf8(batch, "text"):
                words = words_of(text)
                n_words.append(len(words))
                ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
                finds.append(index.finds(ids) if ids.any() else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(finds, _KIND)],
                                             ["doc_id", "n_words", "finds"])
        return step
    return in_arrow(docs.select("doc_id", "text"), task, FOUND)


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of finds, the licenses found (sorted), the best
    coverage, the words matched, and the finds themselves."""
    found = scan(documents(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", "n_words", F.size("finds").cast("long").alias("n_finds"),
                        F.array_sort(F.array_distinct(F.transform("finds", lambda f: f["license"]))).alias("licenses"),
                        F.array_max(F.transform("finds", lambda f: f["coverage"])).alias("coverage"),
                        F.aggregate("finds", F.lit(0).cast("long"), lambda a, f: a + f["matched"]).alias("matched"),
                        "finds")


def longest_common(text: list[bytes], template: list[bytes]) -> int:
    """Words of the template matched in order, without a band: for tests."""
    row = [0] * (len(template) + 1)
    for w in text:
        left = 0
        for j, x in enumerate(template, 1):
            up = row[j]
            row[j] = left + 1 if w == x else max(up, row[j - 1])
            left = up
    return row[-1]
