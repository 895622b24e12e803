"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

1. A template of n words is matched when ``m = ceil(MIN_COVERAGE * n)`` of its words stand in
   order in a stretch of at most ``n + 2 * slack`` document words, ``slack = max(SLACK, n / 8)``. Templates of ``WINNOW_WORDS``
   words and more are matched in at most ``n - m + 1`` runs that are unbroken in both.
2. Of such a long template some run of ``t = ceil(m / (n - m + 1))`` words is then whole (4 from 40 words on, at a coverage of 0.8). Fingerprints are hashes
   of ``k = min(FINGERPRINT, t)`` words, winnowed: of each window of ``t - k + 1`` in a row the smallest is kept, of template and
   document alike, so a whole run of t words shares one for certain. An inverted index leads from fingerprints to templates.
3. Shorter templates can match without any two words in a row, so fingerprints would lose some. For them the exact way is: of any n - m + 1
   words of the template a stretch holds one, and the rarest so many are its anchors in the same kind of index.
4. Around fingerprints and anchors every stretch is tested by a bit-parallel longest common subsequence. Stretches are
   passed over only when too few template words come in on their right to reach m.
5. A match is drawn tight: its earliest end, then its latest start. What is left before and behind it is
   searched again, so copies back to back are matches of their own. It is aligned over the diagonals that an alignment of its length can
   touch. Coverage is the share of the template's words that are matched, reported with the spans of its unbroken runs.
6. Of overlapping matches in a document the one with most matched, less unmatched,
   template words stays (then the higher coverage, the smaller template_id, the earlier start).

Templates are a stated query set: they are scanned in blocks of at most
``BLOCK_WORDS`` words, each broadcast, one after the other in the same pass over the
documents, which are never shuffled. Memory per task: a block, one document, and one
template's band.

Defined results: null and empty texts match nothing, as do templates
without words. Rows are scanned one by one, so repeated rows give repeated matches,
and null doc_ids are kept. Equal templates under two ids: the smaller id is reported. A null
template_id is reported as null. Empty tables give no rows. Extra columns pass through ``scanned``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordHash, column, ngram_hashes, words

SLACK = 5
MIN_COVERAGE = 0.8
BLOCK_WORDS = 1 << 20
FILTER_BITS = 20
WINNOW_WORDS = 40
FINGERPRINT = 3
# Fixed value: frequent words, which are anchors only when a template has too few others.
_FREQUENT = frozenset(b"a all an and any are as at be by for from has have if in is it may no not of on or that the this to use was will "
                      b"with you your".split())
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
MATCH = "struct<template_id:string,coverage:double,matched:bigint,start:bigint,end:bigint,spans:string>"
_MATCH = pa.list_(pa.struct([("template_id", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()),
                             ("start", pa.int64()), ("end", pa.int64()), ("spans", pa.string())]))

# License names, the sentences that grant them, and usual notices.
NAMES = {
    "apache-2.0": "Apache License, Version 2.0", "mit": "MIT License", "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": "BSD 3-Clause License", "isc": "ISC License", "mpl-2.0": "Mozilla Public License, v. 2.0",
    "gpl-2.0": "GNU General Public License, version 2", "gpl-3.0": "GNU General Public License, version 3",
    "lgpl-2.1": "GNU Lesser General Public License, version 2.1", "lgpl-3.0": "GNU Lesser General Public License, version 3",
    "agpl-3.0": "GNU Affero General Public License, version 3", "epl-2.0": "Eclipse Public License 2.0",
    "bsl-1.0": "Boost Software License, Version 1.0", "cc-by-4.0": "CC BY 4.0", "cc-by-sa-4.0": "CC BY-SA 4.0",
    "cc-by-nc-4.0": "CC BY-NC 4.0", "cc-by-nd-4.0": "CC BY-ND 4.0", "cc-by-nc-sa-4.0": "CC BY-NC-SA 4.0", "cc0-1.0": "CC0 1.0",
}
GRANTS = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}",
          "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under {}")
NOTICES = {
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
               "License as published by the Free Software Foundation, either version 3 of the License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


# Whole license texts.
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. ")
_NO_ENDORSEMENT = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. ")
_AUTHOR_DISCLAIMS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
           "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
           "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
           "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
           "of the Software. " + _WARRANTY,
    "bsd-2-clause": _REDISTRIBUTION + _DISCLAIMER,
    "bsd-3-clause": _REDISTRIBUTION + _NO_ENDORSEMENT + _DISCLAIMER,
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies. " + _AUTHOR_DISCLAIMS,
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _AUTHOR_DISCLAIMS,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
            "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
            "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must "
            "not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
            "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
            "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
            "source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                 "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
                 "and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
                 "copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the "
                 "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present "
                 "and future rights to this software under copyright law. " + _WARRANTY,
}


def standard_templates(spark: SparkSession) -> DataFrame:
    """``(template_id, text)``: every name in every grant, the notices, and whole texts."""
    rows = [(f"{k}/grant-{i}", g.format(name)) for k, name in NAMES.items() for i, g in enumerate(GRANTS)]
    rows += [(f"{k}/notice", t) for k, t in NOTICES.items()] + [(f"{k}/text", t) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, "template_id string, text string")


def winnowed(h: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the fingerprints that are kept: of every ``window`` hashes of k words in a row the smallest, the last of equal ones."""
    if len(h) < k + window - 1:
        return np.zeros(0, np.int64)
    g = ngram_hashes(h, k)
    views = np.lib.stride_tricks.sliding_window_view(g, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def fingerprinting(n: int, need: int) -> tuple[int, int] | None:
    """Words of a fingerprint and window of a template of n words; None for one that anchors are to find."""
    if n < WINNOW_WORDS:
        return None
    whole = math.ceil(need / (n - need + 1))
    k = min(FINGERPRINT, whole)
    return k, whole - k + 1


class Index:
    """Inverted index of a block of templates."""

    def __init__(self, templates: list[tuple[str | None, str | None]], min_coverage: float = MIN_COVERAGE):
        memo = WordHash()
        self.ids = [i for i, _ in templates]
        texts = [words((t or "").encode()) for _, t in templates]
        self.hashes = [memo.of(t) for t in texts]
        self.need = [max(1, math.ceil(min_coverage * len(t))) for t in texts]
        self.masks, self.back = [], []
        self.posts: dict[int, list[int]] = {}
        held = Counter(w for t in texts for w in set(t))
        self.anchors: list[set[int]] = []
        self.ways = [fingerprinting(len(t), need) for t, need in zip(texts, self.need, strict=True)]
        self.prints: dict[tuple[int, int], dict[int, list[int]]] = {}
        for n, t in enumerate(texts):
            way = self.ways[n]
            if way:
                own = set(ngram_hashes(self.hashes[n], way[0])[winnowed(self.hashes[n], *way)].tolist())
                for x in own:
                    self.prints.setdefault(way, {}).setdefault(x, []).append(n)
            rare = [] if way else sorted(t, key=lambda w: (w in _FREQUENT or len(w) < 2, held[w], -len(w), w))[:max(0, len(t) - self.need[n] + 1)]
            self.anchors.append({memo[w] for w in rare})
            if way:
                self.anchors[-1] = own
            else:
                for w in self.anchors[-1]:
                    self.posts.setdefault(w, []).append(n)
            ahead: dict[int, int] = {}
            back: dict[int, int] = {}
            for i, w in enumerate(self.hashes[n].tolist()):
                ahead[w] = ahead.get(w, 0) | 1 << i
                back[w] = back.get(w, 0) | 1 << len(t) - 1 - i
            self.masks.append(ahead)
            self.back.append(back)
        self.near = self._marked(self.posts)
        self.near_prints = {way: self._marked(own) for way, own in self.prints.items()}

    @staticmethod
    def _marked(keys: dict[int, list[int]]) -> np.ndarray:
        out = np.zeros(1 << FILTER_BITS, bool)
        out[np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(64 - FILTER_BITS)] = True
        return out

    def places(self, n: int, h: np.ndarray) -> np.ndarray:
        """Where the document has anchors of template ``n``, or fingerprints that both keep."""
        keys = np.fromiter(self.anchors[n], np.uint64, len(self.anchors[n]))
        if not self.ways[n]:
            return np.flatnonzero(np.isin(h, keys))
        at = winnowed(h, *self.ways[n])
        return at[np.isin(ngram_hashes(h, self.ways[n][0])[at], keys)] if len(at) else at

    def candidates(self, h: np.ndarray) -> list[int]:
        """Templates of which the document has an anchor or a fingerprint, and enough words."""
        near = h[self.near[h >> np.uint64(64 - FILTER_BITS)]]
        some = {n for w in set(near.tolist()) for n in self.posts.get(w, ())}
        for way, own in self.prints.items():
            at = winnowed(h, *way)
            if len(at):
                g = ngram_hashes(h, way[0])[at]
                g = g[self.near_prints[way][g >> np.uint64(64 - FILTER_BITS)]]
                some.update(n for x in set(g.tolist()) for n in own.get(x, ()))
        if not some:
            return []
        have = set(h.tolist())
        return sorted(n for n in some if sum(w in have for w in self.hashes[n].tolist()) >= self.need[n])


def common(masks: dict[int, int], size: int, seen: list[int]) -> tuple[int, int]:
    """Longest common subsequence of a template and the words ``seen``: its length, and the number of words in which it is reached."""
    full = (1 << size) - 1
    v, best, last = full, 0, 0
    for k, w in enumerate(seen):
        u = v & masks[w]
        up = v + u
        if up > full:
            best, last = best + 1, k + 1
            if best == size:
                break
        v = (up | (v - u)) & full
    return best, last


def stretches(index: Index, n: int, h: np.ndarray) -> list[tuple[int, int]]:
    """First and last word of every match of template ``n``, apart from each other."""
    t, need = index.hashes[n], index.need[n]
    size = len(t)
    reach = size + 2 * max(SLACK, size // 8)
    at = np.flatnonzero(np.isin(h, t))
    anchors = index.places(n, h)
    after = np.searchsorted(anchors, at)
    gap = np.full(len(at), len(h) + reach)
    gap[after < len(anchors)] = (anchors[after[after < len(anchors)]] - at[after < len(anchors)])
    gap[after > 0] = np.minimum(gap[after > 0], at[after > 0] - anchors[after[after > 0] - 1])
    at = at[gap < reach]
    word, place = h[at].tolist(), at.tolist()
    ends = np.searchsorted(at, at + reach).tolist()      # behind the last template word in reach
    out, parts = [], [(0, len(place))]
    while parts:
        i, stop = parts.pop()
        while stop - i >= need:
            z = min(ends[i], stop)
            best, last = common(index.masks[n], size, word[i:z]) if z - i >= need else (0, 0)
            if best < need:
                # a later start reaches ``need`` only with so many more words on its right
                i, more = i + 1, z + need - (best if z - i >= need else z - i)
                if more > stop:
                    break
                while min(ends[i], stop) < more:
                    i += 1
                continue
            first, got = i, 0
            while best > got:      # a tighter start may see further
                got = best
                end = first + last
                first = end - common(index.back[n], size, word[first:end][::-1])[1]
                best, last = common(index.masks[n], size, word[first:min(ends[first], stop)])
            end = first + last
            out.append((place[first], place[end - 1]))
            parts.append((i, first))
            i = end
    return out


def aligned(t: np.ndarray, h: np.ndarray, low: int, high: int) -> list[int]:
    """Document words of ``paired``."""
    return [d for _, d in paired(t, h, low, high)]


def paired(t: np.ndarray, h: np.ndarray, low: int, high: int) -> list[tuple[int, int]]:
    """Template and document words matched by a longest common subsequence of ``t`` and ``h``
    over the diagonals ``low .. high`` (document word less template word)."""
    n, width = len(t), high - low + 1
    at = np.arange(low, low + n + width)
    inside = (at >= 0) & (at < len(h))
    doc = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
    best = np.zeros((n + 1, width + 1), np.int32)
    for i in range(n):
        equal = (doc[i:i + width] == t[i]) & inside[i:i + width]
        row = np.maximum(best[i, 1:], best[i, :-1] + equal)
        best[i + 1, :-1] = np.maximum.accumulate(row)
    out, i, c = [], n, width - 1
    while i and c >= 0 and best[i, c]:
        if c and best[i, c - 1] == best[i, c]:
            c -= 1
        elif best[i - 1, c + 1] == best[i, c] and c + 1 < width:
            i, c = i - 1, c + 1
        else:
            if best[i, c] > best[i - 1, c]:
                out.append((i - 1, low + i - 1 + c))
            i -= 1
    return out[::-1]


def matches(index: Index, text: str, h: np.ndarray) -> list[dict]:
    """Every template occurrence of enough coverage in a document."""
    out, offsets = [], None
    for n in index.candidates(h):
        t = index.hashes[n]
        for first, last in stretches(index, n, h):
            part = h[first:last + 1]
            most = common(index.masks[n], len(t), [w for w in part.tolist() if w in index.masks[n]])[0]
            pairs = paired(t, part, most - len(t), len(part) - most)
            breaks = sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs[:-1], pairs[1:], strict=True))
            if index.ways[n] and breaks > len(t) - index.need[n]:
                continue
            hit = [first + x for _, x in pairs]
            offsets = offsets or [m.span() for m in _WORD.finditer(text)]
            cuts = [x for x in range(1, len(hit)) if hit[x] != hit[x - 1] + 1]
            runs = [(offsets[hit[a]][0], offsets[hit[z - 1]][1]) for a, z in zip([0, *cuts], [*cuts, len(hit)], strict=True)]
            out.append({"template_id": index.ids[n], "coverage": len(hit) / len(t), "matched": len(hit), "start": runs[0][0],
                        "end": runs[-1][1], "spans": ",".join(f"{a}:{z}" for a, z in runs)})
    return out


def apart(found: list[dict]) -> list[dict]:
    """Best first, those that overlap a better one left out; then by start."""
    starts: list[int] = []
    out: list[dict] = []
    for m in sorted(found, key=lambda m: (round(m["matched"] / m["coverage"]) - 2 * m["matched"], -m["coverage"], m["template_id"] or "", m["start"])):
        k = bisect_right(starts, m["start"])
        if (k == 0 or out[k - 1]["end"] <= m["start"]) and (k == len(out) or m["end"] <= out[k]["start"]):
            starts.insert(k, m["start"])
            out.insert(k, m)
    return out


def blocks(templates: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Templates in turn, at most ``block_words`` words together (a longer one alone)."""
    held, size = [], 0
    for r in templates.select(F.col("template_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        n = len(words((r.t or "").encode()))
        if held and size + n > block_words:
            yield held
            held, size = [], 0
        held, size = [*held, (r.i, r.t)], size + n
    if held:
        yield held


def scanned(docs: DataFrame, templates: DataFrame, min_coverage: float = MIN_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``matches`` of every document."""
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("scan_text"),
                       F.array().cast(f"array<{MATCH}>").alias("matches"))
    schema = rows.schema

    def scan(index, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo = WordHash()
            for b in batches:
                out = []
                for text, found in zip(column(b, "scan_text").to_pylist(), column(b, "matches").to_pylist(), strict=True):
                    if index is not None and text:
                        found = found + matches(index.value, text, memo.of(words(text.encode())))
                    out.append(apart(found) if last and found else found)
                memo.trim()
                yield pa.RecordBatch.from_arrays([column(b, "row"), column(b, "scan_text"), pa.array(out, _MATCH)], schema.names)
        return run

    for block in blocks(templates, block_words):
        rows = rows.mapInArrow(scan(docs.sparkSession.sparkContext.broadcast(Index(block, min_coverage)), False), schema)
    return rows.mapInArrow(scan(None, True), schema).select("row", "matches")


def license_matches(docs: DataFrame, templates: DataFrame, min_coverage: float = MIN_COVERAGE,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per match: doc_id, template_id, coverage, matched (words), start, end and spans (code points, end exclusive)."""
    out = scanned(docs.select("doc_id", "text"), templates, min_coverage, block_words)
    return out.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
