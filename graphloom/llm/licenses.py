"""License scans by patience alignment.

A template's notice is found in three steps: words of which one must occur point at places of the text; around each, words
that are unique in both the place and the template are anchors; the longest increasing run of anchors is kept and the gaps
between its members are aligned the same way, down to gaps without anchors, where equal ends are matched word by word.
Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

COVERAGE = 0.8

#: Short notices of public licenses.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_TOKEN = re.compile(r"[^\s\"'(),;:]+")
MATCHES = "doc_id long, license string, coverage double, start long, end long, matched_words long"


def license_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words without edge punctuation, and their code-point spans."""
    words, spans = [], []
    for m in _TOKEN.finditer(text):
        w = m[0].rstrip(".!?").lower()
        if w:
            words.append(w)
            spans.append((m.start(), m.start() + len(m[0].rstrip(".!?"))))
    return words, spans


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = top_at[k - 1] if k else -1
        tops[k : k + 1] = [v]
        top_at[k : k + 1] = [i]
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned word positions of *a* and *b*, increasing in both."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j in range(b0, b1) if in_b[w := b[j]] == 1 and in_a.get(w) == 1}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] in place]
        kept = [anchors[i] for i in longest_increasing([j for _, j in anchors])]
        if not kept:
            continue
        out += kept
        ends = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        work += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:]) if x + 1 < x2 and y + 1 < y2]
    return sorted(out)


class LicenseScanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: words for name, text in templates.items() if (words := license_words(text)[0])}
        common_in = Counter(w for words in self.templates.values() for w in set(words))
        self.seeds: dict[str, list[tuple[str, int]]] = {}
        for name, words in self.templates.items():
            # coverage needs all but a share of the words, so one more than that share always hits
            need = len(words) - math.ceil(len(words) * coverage) + 1
            counts = Counter(words)
            rare, held = [], 0
            for w in sorted(counts, key=lambda w: (w in _COMMON, len(w) < 5, common_in[w], -len(w), w)):
                rare.append(w)
                held += counts[w]
                if held >= need:
                    break
            for w in rare:
                self.seeds.setdefault(w, []).extend((name, i) for i, x in enumerate(words) if x == w)
        self.finder = None

    def any_seed(self, text: str) -> bool:
        """Whether some template's seed occurs, be it inside a word."""
        if self.finder is None:  # made once per worker
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for w in self.seeds:
                self.finder.add_word(w, True)
            self.finder.make_automaton()
        return next(self.finder.iter(text.lower()), None) is not None

    def matches(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, start, end, aligned words) of each place that a template covers, longest first where places overlap."""
        if not text or not self.any_seed(text):
            return []
        words, spans = license_words(text)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for name, at in self.seeds.get(w, ()):
                places.setdefault(name, []).append(i - at)
        found = []
        for name, starts in places.items():
            template = self.templates[name]
            n, slack = len(template), max(2, len(template) // 4)
            starts.sort()
            done = -1
            for s in starts:
                low = max(0, s - slack, done)
                high = min(len(words), s + n + slack)
                if high - low < n * self.coverage:
                    continue
                pairs = patience(words[low:high], template)
                # the words between the first and last aligned one must be the notice's own, not scattered
                if len(pairs) >= n * self.coverage and pairs[-1][0] - pairs[0][0] < n + slack:
                    a, b = low + pairs[0][0], low + pairs[-1][0]
                    found.append((len(pairs), name, len(pairs) / n, spans[a][0], spans[b][1]))
                    done = b + 1
        out: list[tuple[int, str, float, int, int]] = []  # kept in order of place, none overlapping
        for size, name, share, a, b in sorted(found, key=lambda f: (-f[0] * f[2], f[3], f[1])):
            k = bisect_left(out, a, key=lambda x: x[0])
            if (k == 0 or out[k - 1][3] <= a) and (k == len(out) or out[k][0] >= b):
                out.insert(k, (a, name, share, b, size))
        return [(name, share, a, b, size) for a, name, share, b, size in out]


_COMMON = frozenset("a all an and any are as at by for from in is it no not of on or that the this to under with without you".split())


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start, end, matched_words: one row per notice found in a text.

    Null or empty texts have none; where notices overlap the larger one holds (ties: the earlier, then by name); equal notices
    at several places are each reported; repeated rows are scanned each; extra columns are ignored; an empty table gives an
    empty result; texts of any length are read whole.  Templates are program parameters, so they are small.
    """
    scanner = LicenseScanner(TEMPLATES if templates is None else templates, coverage)

    def run(batches):
        for batch in common.slices(batches):
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in scanner.matches(t)]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "license", "coverage", "start", "end", "matched_words"])

    return docs.select("doc_id", "text").mapInArrow(run, MATCHES)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))
