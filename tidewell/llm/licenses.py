"""Licence scan by sentence rules: known licence sentences, and ordered rules over their identifiers.

A known sentence is looked for at every place where a sentence, a line or a list item starts, word by word, with anything but ASCII letters
and digits between its words (so line ends, comment marks and stop marks inside it do not count), and must end where a sentence
or a line ends. The identifiers in their order, with 0 for what is unknown between known ones, are matched against rules, which are ordered sequences of identifiers. The catalogue is small and
fixed, so it travels with the task; every row is handled on its own and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence wording, by sentence.
SENTENCES: dict[int, str] = {
    1: "Licensed under the Apache License, Version 2.0.",
    2: "Released under the MIT License.",
    3: "Licensed under CC BY-NC 4.0.",
    4: "This work is licensed under the GNU General Public License, version 3.",
    5: "All rights reserved.",
    6: "Licensed under the MIT License.",
    7: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    8: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    9: "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    10: "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    11: "Licensed under the Apache License, Version 2.0 (the \"License\");",
    12: "you may not use this file except in compliance with the License.",
    13: "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    14: "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    15: "See the License for the specific language governing permissions and limitations under the License.",
    16: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    17: "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    18: "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    19: "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    20: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    21: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    22: "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    23: "See the GNU General Public License for more details.",
    24: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    25: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    26: "This is free and unencumbered software released into the public domain.",
    27: "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    28: "Licensed under CC BY 4.0.",
    29: "Licensed under CC BY-SA 4.0.",
    30: "This work is in the public domain.",
}

# Licence and the sentence identifiers that state it, in order.
RULES: list[tuple[str, list[int]]] = [
    ("Apache-2.0", [1]), ("Apache-2.0", [11, 12]), ("Apache-2.0", [11, 12, 13, 14, 15]),
    ("MIT", [2]), ("MIT", [6]), ("MIT", [7, 8, 9, 10]), ("MIT", [7, 8]),
    ("CC-BY-NC-4.0", [3]), ("CC-BY-4.0", [27]), ("CC-BY-4.0", [28]), ("CC-BY-SA-4.0", [29]),
    ("GPL-3.0", [4]), ("GPL-3.0-or-later", [20]), ("GPL-3.0-or-later", [20, 21, 22, 23]),
    ("BSD-2-Clause", [16, 17, 18]), ("BSD-3-Clause", [16, 17, 18, 19]),
    ("MPL-2.0", [24]), ("ISC", [25]), ("Unlicense", [26]), ("public-domain", [30]), ("all-rights-reserved", [5]),
]

WORD = re.compile(r"[^a-z0-9]+")
MARK = r"\(?(?:[0-9]{1,2}|[A-Za-z]|[ivxIVX]{1,4})[.)]"  # of a list item: 1. (a) iv)
# Where a sentence, a line or a list item may start, up to its first word, and its first two words in their letters.
START = re.compile(rf"(?:\A|\n|(?<=[.!?;:])[ \t-\r])[^A-Za-z0-9(]*+(?:{MARK}[ \t-\r]+)?[^A-Za-z0-9]*+(?:(?=([A-Za-z0-9]++)[^A-Za-z0-9]++([A-Za-z0-9]++)))?")
PUNCTUATION = r"[!-/:-@\[-`{-~]*"
END = rf"(?:{PUNCTUATION}[.!?;:]{PUNCTUATION}(?=[ \t-\r]|\Z)|{PUNCTUATION}(?=[ \t\r\v\f]*(?:\n|\Z)))"
ITEM = re.compile(rf"(?<!\w){MARK}(?!\S)")
LETTER = re.compile(r"\w")
GAP = re.compile(r"[^A-Za-z0-9]*+")
WORDS = re.compile(r"([A-Za-z0-9]++)[^A-Za-z0-9]++([A-Za-z0-9]++)")


def normal(sentence: str) -> str:
    """Lower-case letters and digits of ASCII, anything else between them as one blank."""
    return WORD.sub(" ", sentence.lower()).strip(" ")


# Known sentences by their first two words, the longest first. One without a stop mark of its own may end anywhere between two words.
KNOWN: dict[tuple[str, str], list[tuple[re.Pattern, int]]] = {}
for _k in sorted(SENTENCES, key=lambda k: -len(SENTENCES[k])):
    _words = normal(SENTENCES[_k]).split(" ")
    _end = END if SENTENCES[_k][-1] in ".!?;:" else rf"(?:{END}|(?![A-Za-z0-9]))"
    KNOWN.setdefault((_words[0], _words[1]), []).append((re.compile("[^A-Za-z0-9]+".join(_words) + _end, re.I | re.A), _k))


def known_sentences(text: str) -> list[tuple[int, int, int]]:
    """(identifier, start, end) in order; identifier 0 stands for what is unknown between two known ones, other than list marks."""
    out: list[tuple[int, int, int]] = []
    at = 0

    def take(start: int) -> None:
        nonlocal at
        while start >= at:
            pair = WORDS.match(text, start)
            options = KNOWN.get((pair[1].lower(), pair[2].lower()), []) if pair else []
            m, k = next(((m, k) for p, k in options if (m := p.match(text, start))), (None, 0))
            if not m:
                return
            if out and LETTER.search(ITEM.sub("", text[at:start])):
                out.append((0, at, start))
            out.append((k, start, m.end()))
            at = m.end()
            # What follows a sentence starts one, also where the sentence has no stop mark.
            start = GAP.match(text, at).end()

    for m in START.finditer(text):
        if m[1] and m.end() >= at and (m[1].lower(), m[2].lower()) in KNOWN:
            take(m.end())
    return out


def match_rules(found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int]]:
    """(licence, rule, start, end) of every rule that matches adjacent sentences; a match inside a longer one does not count."""
    ids = [f[0] for f in found]
    hits = []
    for r, (name, rule) in enumerate(RULES):
        for k in range(len(ids) - len(rule) + 1):
            if ids[k : k + len(rule)] == rule:
                hits.append((k, k + len(rule), name, r))
    # By start, the longest first: a match lies inside a longer one if one that began before reaches as far, or one that begins with it further.
    best, reach, start = [], 0, -1
    for h in sorted(hits, key=lambda h: (h[0], -h[1])):
        if h[0] > start:
            reach, start, longest = max(reach, longest if start >= 0 else 0), h[0], h[1]
        if h[1] == longest and h[1] > reach:
            best.append(h)
    return [(name, r, found[a][1], found[b - 1][2]) for a, b, name, r in sorted(best)]


SCAN = "struct<ids: array<int>, matches: array<struct<license: string, rule: int, start: int, end: int>>>"


def _scan(texts: pd.Series) -> pd.DataFrame:
    ids, matches = [], []
    for t in texts:
        found = known_sentences(t)
        ids.append([f[0] for f in found])
        matches.append([{"license": n, "rule": r, "start": a, "end": b} for n, r, a, b in match_rules(found)] if found else [])
    return pd.DataFrame({"ids": ids, "matches": matches})


def with_licenses(docs: DataFrame, text: str = "text", name: str = "licenses") -> DataFrame:
    """``docs`` with a column ``name``: the identifiers found and the matches (licence, rule, start, end in code points).

    A null or empty text has none; repeated notices are all reported; other columns stay.
    """
    return docs.withColumn(name, F.pandas_udf(_scan, SCAN)(F.coalesce(text, F.lit(""))))
