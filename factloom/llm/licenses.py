"""Licence scans: Dice coefficient over word bigrams, with size bounds pruning templates.

Templates are whole licence texts (``license_texts``) and the usual short notices. A text's units are
its lines, its sentences, its paragraphs, its runs of licence paragraphs, and the whole. A run is a
maximal row of successive paragraphs (of two words or more) in which at least half of the bigrams
occur in some template; so a licence of several paragraphs inside a longer file has a unit of its own.
A unit is normalised: lower case, anything but letters and digits becomes a blank. It is compared
with the templates whose number of bigrams allows a coefficient of at least ``DICE``:

    2 * common / (bigrams of the unit + bigrams of the template)

Repeated bigrams count as often as they occur on both sides, so a text that equals a template after
normalisation scores 1. A unit that reaches ``DICE`` with a template of m bigrams holds at least
``DICE / (2 - DICE)`` of them (2 of 3 at 0.8), so it holds a word of any set of words that touches more
than the rest. ``telling_words`` is such a set for all templates; texts without any of them cannot match
and are not scanned. All of it is one narrow projection of built-in functions: no shuffle, no Python.

Cases: null and empty texts match nothing; of templates with equal coefficients the first name in
code-point order wins; repeated rows are scanned alike; an empty table gives an empty table; other
columns are not looked at.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import text_of

DICE = 0.8
#: Words too common to tell a text that may match from others.
COMMON = frozenset("the of and to in a or that for is by this with any are be you from as it not on your at which such an may all has have other will can if been was its but so do does no than".split())

#: The usual short notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    """(name, text) of the licences in full, read from the files beside this module."""
    folder = os.path.join(os.path.dirname(os.path.abspath(__file__)), "license_texts")
    found = []
    for file in sorted(os.listdir(folder)):
        with open(os.path.join(folder, file), encoding="utf-8") as f:
            found.append((file.removesuffix(".txt"), f.read()))
    return tuple(found)


TEMPLATES = NOTICES + whole_texts()


def bigrams(text: str) -> list[str]:
    """Word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def prepared(templates=TEMPLATES) -> list[tuple[str, list[str]]]:
    return sorted((name, bigrams(text)) for name, text in templates)


def numbered(grams: list[str]) -> list[str]:
    """Each bigram once as it is; the second and further ones with their number: a set that stands for the bag."""
    return [g if k == 1 else f"{g}#{k}" for g, n in Counter(grams).items() for k in range(1, n + 1)]


def bounds(size: int, dice: float) -> tuple[float, float]:
    """Fewest and most bigrams of a unit that can reach ``dice`` with a template of ``size`` bigrams:
    2 * common / (n + size) >= dice, where common is at most the smaller of the two."""
    return dice / (2 - dice) * size, (2 - dice) / dice * size


@lru_cache(maxsize=8)
def telling_words(templates: tuple[tuple[str, str], ...] = TEMPLATES, dice: float = DICE) -> tuple[str, ...]:
    """Words of which every unit holds one that reaches ``dice`` with a template: chosen greedily until they
    touch, of each template, one bigram more than a unit may lack. Common words only where others do not do."""
    left = []
    for _, own in prepared(templates):
        lacking = len(own) - math.ceil(dice / (2 - dice) * len(own) - 1e-9)
        left.append([lacking + 1, Counter(own)])
    words: list[str] = []
    while any(n > 0 for n, _ in left):
        gain: Counter[str] = Counter()
        for n, grams in left:
            if n > 0:
                for g, c in grams.items():
                    for w in set(g.split()):
                        gain[w] += min(c, n) / n
        words.append(max(gain, key=lambda w: (w not in COMMON, gain[w], w)))
        for rest in left:
            for g in [g for g in rest[1] if words[-1] in g.split()]:
                rest[0] -= rest[1].pop(g)
    return tuple(words)


def _constant(words: list[str]) -> Column:
    """A constant array, as one literal that the optimizer splits once."""
    return F.split(F.lit("\n".join(words)), "\n")


def _pairs(unit: Column) -> Column:
    words = F.split(unit, " ")
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))


def _bind(value: Column, then) -> Column:
    """One evaluation of ``value``: it is the only element of an array."""
    return F.transform(F.array(value), then)[0]


def _numbered(grams: Column) -> Column:
    """:func:`numbered` of a sorted array: the runs of equal bigrams give the numbers."""
    at = F.sequence(F.lit(0), F.size(grams) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(grams, i) != F.get(grams, i - 1)))

    def further(starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(grams)))
        runs = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), (b - a).alias("n"))), lambda r: r["n"] > 1)
        return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(2), r["n"]), lambda k: F.concat_ws("#", F.get(grams, r["a"]), k.cast("string")))))

    distinct = F.array_distinct(grams)
    return F.when(F.size(distinct) == F.size(grams), grams).otherwise(F.concat(distinct, _bind(starts, further)))


def _unit_matches(unit: Column, templates: list[tuple[str, list[str]]], dice: float) -> Column:
    """Array of (license, dice) of one normalised unit."""

    def scored(grams: Column) -> Column:
        n, rows = F.size(grams), []
        for name, own in templates:
            low, high = bounds(len(own), dice)
            value = F.lit(2.0) * F.size(F.array_intersect(grams, _constant(numbered(own)))) / (n + len(own))
            rows.append(F.struct(F.lit(name).alias("license"), F.when((n >= low) & (n <= high), value).otherwise(F.lit(0.0)).alias("dice")))
        return F.filter(F.array(*rows), lambda m: m["dice"] >= dice)

    return _bind(F.array_sort(_pairs(unit)), lambda grams: _bind(_numbered(grams), scored))


def _runs(paragraphs: Column, templates: list[tuple[str, list[str]]]) -> Column:
    """Maximal rows of successive licence paragraphs, each joined to one unit."""
    known = sorted({g for _, own in templates for g in own})
    licensed = lambda p: _bind(_pairs(p), lambda grams: 2 * F.size(F.array_intersect(grams, _constant(known))) >= F.size(F.array_distinct(grams)))
    marked = F.transform(F.filter(paragraphs, lambda p: F.contains(p, F.lit(" "))), lambda p: F.when(licensed(p), p).otherwise(""))
    # normalised paragraphs hold no line ends: two of them mark a paragraph that is none of a licence
    return F.transform(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda r: F.trim(F.replace(r, F.lit("\n"), F.lit(" "))))


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", templates=TEMPLATES, dice: float = DICE) -> DataFrame:
    """One row for each document: ``keep``, matches (license and dice, once a license, best first), and
    license and dice of the best match (null: none)."""
    ready = prepared(templates)
    fewest = min(bounds(len(g), dice)[0] for _, g in ready)
    most = max(bounds(len(g), dice)[1] for _, g in ready)
    low = F.lower(text_of(docs, text))
    plain = lambda u: F.trim(F.regexp_replace(u, r"[^\p{L}\p{N}]+", " "))
    # a unit has as many bigrams as blanks
    blanks = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))

    def matched(body: Column) -> Column:
        paragraphs = F.split(body, "\n[ \t\r]*\n")
        sentences = F.flatten(F.transform(paragraphs, lambda p: F.split(p, "[.!?]+[ \t\r\n]+")))
        units = F.concat(F.transform(F.concat(F.split(body, "\n"), sentences, paragraphs, F.array(body)), plain), _runs(F.transform(paragraphs, plain), ready))
        short = F.filter(F.array_distinct(units), lambda u: (blanks(u) >= fewest) & (blanks(u) <= most))
        return F.flatten(F.transform(short, lambda u: _unit_matches(u, ready, dice)))

    telling = r"(?<![\p{L}\p{N}])(?:" + "|".join(telling_words(tuple(templates), dice)) + r")(?![\p{L}\p{N}])"
    found = F.when(F.rlike(low, F.lit(telling)), _bind(low, matched)).otherwise(F.array().cast("array<struct<license:string,dice:double>>"))
    ordered = F.array_sort(found, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0))
    # the best match of each license, best first
    ordered = _bind(ordered, lambda rows: F.transform(F.array_distinct(rows["license"]), lambda name: F.filter(rows, lambda m: m["license"] == name)[0]))
    out = docs.select(*[docs[c] for c in keep], ordered.alias("matches"))
    best = F.try_element_at("matches", F.lit(1))
    return out.select(*keep, "matches", best["license"].alias("license"), best["dice"].alias("dice"))
