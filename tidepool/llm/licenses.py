"""Operator 7: license scans by patience alignment.

Of a text, only the words of a template and their places count. Every shortest stretch that holds enough different words of the template is
a candidate, however long. It is aligned with the template, together with what lies around it: words that occur once in both are anchors, the
longest run of them that rises in both is kept, and the gaps between anchors are aligned the same way; a gap without anchors is aligned by
its longest common subsequence. Partners are then moved as close together as the text allows, and the hit is the series of partners that is
worth most: each counts 1, and each word of the text that stands between two of them without being due there costs a fraction (4 partners for
as many words as the template has). So there is no longest hit, but strays far from the rest are none of it. Coverage is the share of the template's words that
found a partner; words that tell a license from others must be among them. Of hits that overlap, the one with the most partners stays, and
what lies before and behind it is searched on.

Cases: null and empty texts have no hits; texts of any length are searched whole, and all hits are kept; repeated rows get equal hits; of
hits of different templates with equal coverage, the longer template, then the name that sorts first, is the best; an empty table gives an
empty one; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidepool.llm.common import as_bytes, map_texts

#: Notices of well-known licenses.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
        sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under
        the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
        Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "bsd-notice": "Released under the BSD License.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
        redistribute it freely, subject to the following restrictions""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution.""",
}


TEMPLATES["mit-full"] = TEMPLATES["mit"] + """
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
    ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
TEMPLATES["bsd-3-clause"] = TEMPLATES["bsd-2-clause"] + """
    Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
    prior written permission."""

#: Words without which a text is not under the license.
TELLING: dict[str, tuple[str, ...]] = {
    "mit-notice": ("mit",), "bsd-notice": ("bsd",), "apache-2.0-notice": ("apache", "2.0"), "apache-2.0": ("apache", "2.0"), "gpl-3.0-notice": ("gnu", "3"), "gpl-3.0-or-later": ("gnu", "3", "later"),
    "cc-by-nc-4.0-notice": ("by-nc", "4.0"), "cc-by-4.0": ("attribution", "4.0"), "cc-by-sa-4.0": ("attribution-sharealike", "4.0"), "mit-full": ("merchantability",), "bsd-3-clause": ("neither", "endorse"),
}


@dataclass(frozen=True)
class Settings:
    """coverage: least share of a template's words. strays: how many partners it costs when as many words stand between partners as the template has."""

    coverage: float = 0.8
    strays: float = 4.0


_trim = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")


def normal(word: bytes) -> bytes:
    return _trim.sub(b"", word.lower())


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of words that occur once in a and once in b, as the longest series that rises in both (the least ends win ties)."""
    once: dict[int, int | None] = {}
    for i, w in enumerate(a):
        once[w] = None if w in once else i
    seen: dict[int, int | None] = {}
    for j, w in enumerate(b):
        seen[w] = None if w in seen else j
    pairs = [(i, seen[w]) for w, i in once.items() if i is not None and seen.get(w) is not None]
    pairs.sort()
    ends: list[int] = []
    tops: list[int] = []
    back = [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        k = bisect_left(ends, j)
        if k:
            back[p] = tops[k - 1]
        if k == len(ends):
            ends.append(j)
            tops.append(p)
        else:
            ends[k], tops[k] = j, p
    out, p = [], tops[-1] if tops else -1
    while p >= 0:
        out.append(pairs[p])
        p = back[p]
    return out[::-1]


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Partners (place in a, place in b), rising in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        fixed = anchors(a[a0:a1], b[b0:b1])
        if not fixed:
            out += [(a0 + i, b0 + j) for i, j in common_subsequence(a[a0:a1], b[b0:b1])]
            continue
        i0, j0 = a0, b0
        for i, j in fixed:
            out.append((a0 + i, b0 + j))
            todo.append((i0, a0 + i, j0, b0 + j))
            i0, j0 = a0 + i + 1, b0 + j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def closer(pairs: list[tuple[int, int]], words: list[int]) -> list[tuple[int, int]]:
    """The same partners, each moved to the place of its word that is next to the one behind it, then next to the one before it."""
    places: dict[int, list[int]] = {}
    for j, w in enumerate(words):
        places.setdefault(w, []).append(j)
    at = [j for _, j in pairs]
    for k in range(len(at) - 2, -1, -1):
        own = places[words[at[k]]]
        at[k] = own[bisect_left(own, at[k + 1]) - 1]
    for k in range(1, len(at)):
        own = places[words[at[k]]]
        at[k] = own[bisect_right(own, at[k - 1])]
    return [(i, j) for (i, _), j in zip(pairs, at)]


def worthiest(pairs: list[tuple[int, int]], places: list[int], cost: float) -> list[tuple[int, int]]:
    """The series of partners that is worth most; places: of the words that partners number."""
    best, begin, end, worth, start = 0.0, 0, 0, 0.0, 0
    for k, (i, j) in enumerate(pairs):
        if k:
            worth -= cost * max(0, places[j] - places[pairs[k - 1][1]] - (i - pairs[k - 1][0]))
        if worth <= 0:
            worth, start = 0.0, k
        worth += 1
        if worth > best + 1e-9:
            best, begin, end = worth, start, k + 1
    return pairs[begin:end]


class Scanner:
    def __init__(self, templates: dict[str, str], settings: Settings, telling: dict[str, tuple[str, ...]] = TELLING) -> None:
        number: dict[bytes, int] = {}
        self.settings = settings
        self.names = sorted(templates)
        self.words = [[number.setdefault(w, len(number) + 1) for w in map(normal, templates[n].encode().split()) if w] for n in self.names]
        self.number = number
        self.telling = [{number.get(w.encode(), 0) for w in telling.get(n, ())} for n in self.names]
        self.need = [int(np.ceil(settings.coverage * len(w) - 1e-9)) for w in self.words]
        self.cost = [settings.strays / max(len(w), 16) for w in self.words]
        self.member = np.zeros((len(self.names), len(number) + 1), bool)
        for t, words in enumerate(self.words):
            self.member[t, words] = True
        self.known: dict[bytes, int] = {}

    def ids(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self.number.get(normal(w), 0)
            return [known[w] for w in words]

    def stretches(self, t: int, words: list[int], places: list[int]) -> list[tuple[int, int]]:
        """The shortest stretches (first word, last word) that hold as many different words of a template as a hit has to, all telling ones, and are
        no longer than a hit can be worth."""
        template, need = self.words[t], self.need[t]
        distinct = len(set(template))
        least, longest = max(1, need - (len(template) - distinct)), len(template) * (1 + 1 / self.cost[t])
        held: dict[int, int] = {}
        out, first, missing = [], 0, set(self.telling[t])
        for last, w in enumerate(words):
            held[w] = held.get(w, 0) + 1
            missing.discard(w)
            while len(held) - (held[words[first]] == 1) >= least and not (held[words[first]] == 1 and words[first] in self.telling[t]):
                held[words[first]] -= 1
                if not held[words[first]]:
                    del held[words[first]]
                first += 1
            if len(held) >= least and not missing and places[last] - places[first] < longest and (not out or out[-1][0] != first):
                out.append((first, last))
        return out

    def aligned(self, t: int, words: list[int], places: list[int], low: int, high: int) -> tuple[int, int, int, int] | None:
        pairs = [(i, low + j) for i, j in closer(align(self.words[t], words[low:high]), words[low:high])]
        pairs = worthiest(pairs, places, self.cost[t])
        if len(pairs) < self.need[t] or not self.telling[t] <= {words[j] for _, j in pairs}:
            return None
        return t, places[pairs[0][1]], places[pairs[-1][1]] + 1, len(pairs)

    def best(self, t: int, words: list[int], places: list[int], stretches: list[tuple[int, int]], low: int, high: int) -> tuple[tuple[int, int, int, int] | None, bool]:
        """Of the first stretches between two words that hold a hit and overlap, the hit with the most partners, then the fewest words; and whether
        another one began before it."""
        n, hit, first = len(self.words[t]), None, 0
        for begin, end in stretches[bisect_left(stretches, (low, 0)) :]:
            if end >= high or hit and places[begin] >= hit[2]:
                break
            # around the stretch: as far as the partners that it lacks could be worth, but first close by, where more words occur once
            for reach in (n // 2 + 3, (n - self.need[t] + 1) / self.cost[t]):
                x, y = bisect_left(places, places[begin] - reach, low, high), bisect_right(places, places[end] + reach, low, high)
                new = self.aligned(t, words, places, x, y)
                if new:
                    first = min(first, new[1]) if hit else new[1]
                    if not hit or (new[3], new[1] - new[2]) > (hit[3], hit[1] - hit[2]):
                        hit = new
                if new and new[3] == n:
                    break
            if hit and hit[2] - hit[1] == n == hit[3]:
                break
        return hit, hit is not None and first < hit[1]

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, first word, word after the last, words matched) of every hit in a text."""
        out = []
        for t, need in enumerate(self.need):
            inside = np.flatnonzero(self.member[t][ids])  # words of the template
            if len(inside) < need:
                continue
            words, places = ids[inside].tolist(), inside.tolist()
            stretches = self.stretches(t, words, places)
            found, todo = [], [(0, len(words))]
            while todo and stretches:
                low, high = todo.pop()
                hit, more = self.best(t, words, places, stretches, low, high)
                if hit:
                    found.append(hit)
                    todo.append((bisect_left(places, hit[2]), high))
                    if more:
                        todo.append((low, bisect_left(places, hit[1])))
            out += sorted(found)
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int, int]]]:
        split = [t.split() for t in texts]
        ids = np.array([i for ws in split for i in self.ids(ws)], np.int64)
        edges = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
        some = np.flatnonzero(ids)
        least = min(self.need, default=0)
        found = np.searchsorted(some, edges[1:]) - np.searchsorted(some, edges[:-1])
        return [self.hits(ids[edges[i] : edges[i + 1]]) if found[i] >= least else [] for i in range(len(texts))]


HIT = T.StructType([T.StructField("license", T.StringType()), T.StructField("begin_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType())])
FIELDS = [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("hits", T.ArrayType(HIT))]


def find_licenses(df: DataFrame, *, keep: list[str] | None = None, text_col: str = "text", templates: dict[str, str] = TEMPLATES, telling: dict[str, tuple[str, ...]] = TELLING, settings: Settings = Settings()) -> DataFrame:
    """`keep` columns of each row, license and coverage of its best hit (null without one), and hits, by template name, then place."""

    def make():
        scanner = Scanner(templates, settings, telling)
        sizes = [len(w) for w in scanner.words]

        def work(texts: pa.Array, _rows: pa.RecordBatch) -> list[pa.Array]:
            found = scanner.scan(as_bytes(texts))
            best = [max(x, key=lambda h: (h[3] / sizes[h[0]], sizes[h[0]], -h[0]), default=None) for x in found]
            flat = [h for x in found for h in x]
            parts = [pa.array([scanner.names[h[0]] for h in flat], pa.string()), *(pa.array([h[i] for h in flat], pa.int64()) for i in (1, 2, 3)), pa.array([h[3] / sizes[h[0]] for h in flat], pa.float64())]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            hits = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, names=HIT.names))
            return [pa.array([b and scanner.names[b[0]] for b in best], pa.string()), pa.array([b and b[3] / sizes[b[0]] for b in best], pa.float64()), hits]

        return work

    return map_texts(df, text_col, keep or ["doc_id"], FIELDS, make)
