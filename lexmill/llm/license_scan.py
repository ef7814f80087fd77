"""Licence notices in documents: fingerprints of templates propose, local alignment decides.

A local alignment with match 1 and mismatch and gap -1 begins with two equal words in a row, or its first word adds nothing;
and one that matches enough of a template begins early enough in it. The hashes of a template's pairs of words at these
places, all of them, form an inverted index (hash to template and place). Each place of a document where one occurs is
aligned from there, without a band: no notice with enough matched words can be missed. The index has the size of the
template list, a parameter.
"""

from __future__ import annotations

import math
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frame import tidy
from ._words import Words, cuts

GRAM, WINDOW, MIN_COVERAGE = 3, 3, 0.75
#: Licence and the words of a notice, one entry per wording.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "apache-short", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "mit-short", "Released under the MIT License."),
    ("MIT", "mit-licensed", "Licensed under the MIT License."),
    ("MIT", "mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "gpl3-short", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gpl3-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gpl2-header", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "mpl2-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "cc-by-nc-short", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "cc-by-nc-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "cc-by-short", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "cc-by-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "cc-by-sa-short", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "cc-by-sa-long", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "all-rights-reserved", "All rights reserved."),
)
_FOUND = "array<struct<license:string,template:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,matched:bigint,template_words:bigint,score:bigint>>"
_TYPE = pa.struct([("license", pa.string()), ("template", pa.string()), *((n, pa.int64()) for n in ("first_word", "last_word", "start", "end", "matched", "template_words", "score"))])


def align(template: list[int], words: list[int], first: int, low: int, high: int) -> tuple[int, int, int, int] | None:
    """Best local alignment (match 1, mismatch and gap -1) of a template with words from place first on, word j against
    template word i only where low <= j - i <= high. Score, matched words, first and last word; None without a match.

    Of equal scores the first to end wins.
    """
    n, width = len(template), high - low + 1
    best = (0, 0, 0, 0)
    above: list[tuple[int, int, int]] = [(0, 0, 0)] * (width + 2)
    for i in range(n):
        row: list[tuple[int, int, int]] = [(0, 0, 0)] * (width + 2)
        t = template[i]
        for b in range(width):
            j = i + low + b - first
            if not 0 <= j < len(words):
                continue
            s, m, at = above[b + 1]
            same = words[j] == t
            got = (s + 1, m + 1, at if s else j) if same else (s - 1, m, at)
            up, left = above[b + 2], row[b]
            if up[0] - 1 > got[0]:
                got = (up[0] - 1, up[1], up[2])
            if left[0] - 1 > got[0]:
                got = (left[0] - 1, left[1], left[2])
            if got[0] > 0:
                row[b + 1] = got
                if got[0] > best[0]:
                    best = (got[0], got[1], got[2], j)
        above = row
    return (best[0], best[1], best[2] + first, best[3] + first) if best[0] else None


def extend(template: list[int], words: list[int], i: int, j: int) -> tuple[int, int, int]:
    """Best local alignment (as in align()) that begins with template word i against the equal word j: score, matched words
    and last word. Only cells with a positive score are held."""
    above = {j: (1, 1)}
    best = (1, 1, j)
    for t in template[i + 1 :]:
        row: dict[int, tuple[int, int]] = {}
        at, end = min(above), max(above) + 1
        while at < len(words) and (at <= end or at - 1 in row):
            got = (0, 0)
            if at - 1 in above:
                s, m = above[at - 1]
                got = (s + 1, m + 1) if words[at] == t else (s - 1, m)
            for s, m in (above.get(at, got), row.get(at - 1, got)):
                if s - 1 > got[0]:
                    got = (s - 1, m)
            if got[0] > 0:
                row[at] = got
                if got[0] > best[0]:
                    best = (*got, at)
            at += 1
        if not row:
            break
        above = row
    return best


class Index:
    """Inverted index of the templates' fingerprints. gram: the most words of one, of which two are enough; nothing is left out by window."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...], gram: int, window: int):
        words = Words([t for _, _, t in templates])
        self.gram = gram
        self.names = [(a, b) for a, b, _ in templates]
        self.words = [words.hash[words.first[i] : words.first[i + 1]].tolist() for i in range(len(templates))]
        self._all = words

    def starts(self, min_coverage: float) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By number of words: hash to (template, place), wherever an alignment with enough matched words can begin."""
        need = [max(1, math.ceil(min_coverage * len(w))) for w in self.words]
        post: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for g in (1, 2):
            at, h = self._all.windows(g)
            for a, x in zip(at.tolist(), h.tolist(), strict=True):
                t = int(self._all.row[a])
                p = a - int(self._all.first[t])
                if g == (1 if need[t] == 1 else min(2, self.gram)) and p <= len(self.words[t]) - need[t]:
                    post.setdefault(g, defaultdict(list))[x].append((t, p))
        return post

    def scan(self, texts: list[str | None], min_coverage: float) -> list[list[dict]]:
        words = Words(texts)
        out: list[list[dict]] = [[] for _ in texts]
        for gram, post in self.starts(min_coverage).items():
            keys = np.array(sorted(post), np.uint64)
            at, h = words.windows(gram)
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            for a, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
                r = int(words.row[a])
                base = int(words.first[r])
                for t, p in post[x]:
                    n = len(self.words[t])
                    score, matched, last = extend(self.words[t], words.hash[a : min(int(words.first[r + 1]), a + 2 * n)].tolist(), p, 0)
                    if matched >= min_coverage * n:
                        lic, name = self.names[t]
                        out[r].append({"license": lic, "template": name, "first_word": a - base, "last_word": a - base + last, "start": int(words.start[a]), "end": int(words.end[a + last]), "matched": matched, "template_words": n, "score": score})
        return [choose(x) for x in out]


def choose(found: list[dict]) -> list[dict]:
    """The best of overlapping findings: by matched words, score, place, name; others may share no word with one taken."""
    first: list[int] = []
    taken: list[dict] = []
    for f in sorted(found, key=lambda f: (-f["matched"], -f["score"], f["first_word"], f["template"])):
        i = bisect(first, f["last_word"])
        if not i or taken[i - 1]["last_word"] < f["first_word"]:
            first.insert(i, f["first_word"])
            taken.insert(i, f)
    return taken


def licenses(
    docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, gram: int = GRAM, window: int = WINDOW, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """One row per notice: doc_id, license, template, first_word, last_word, start, end (characters), matched,
    template_words, coverage (matched share of the template's words), score.

    Every place of a document is aligned; of notices that overlap the one with more matched words is reported, then the one of
    the higher score, the one that begins first, and the template that comes first by name. Null and empty texts have none; null ids and
    repeated rows are scanned like others. An empty table gives an empty result; texts are read whole; extra columns are
    ignored, whatever their names.
    """
    docs, _ = tidy(docs, {"doc_id": "long", "text": "string"})

    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates, gram, window)
        for batch in batches:
            found: list[list[dict]] = []
            for a, b in cuts(batch):
                found += index.scan(batch.slice(a, b - a).to_pylist(), min_coverage)
            yield pa.array(found, pa.list_(_TYPE))

    out = docs.select("doc_id", run.asNondeterministic()("text").alias("__f")).filter(F.size("__f") > 0).select("doc_id", F.explode("__f").alias("f"))
    return out.select("doc_id", "f.license", "f.template", "f.first_word", "f.last_word", "f.start", "f.end", "f.matched", "f.template_words", F.round(F.col("f.matched") / F.col("f.template_words"), 6).alias("coverage"), "f.score")
