"""License scans by sentence rules.

Each text is normalised to words and ends of sentences, the known licence sentences between two ends are mapped to their identifiers, and the identifiers, in the order of the
text, form a string that ordered rules are matched against: a rule is a sequence of identifiers, and more specific rules come first. An identifier that a rule has used is not
used by a later one.

Words are runs of a-z and 0-9, lower-cased; what lies between them (quotes, comment prefixes, rules of `***`, any number of blanks) does not count. A full stop, `!` or `?` before
white space and an empty line end a sentence. A line's end, and `:` or `;` before white space, may end one or not: a known sentence may begin or end there or go on, so wrapped
texts are read as texts on one line are. Where sentences overlap the first wins, then the longest. No sentence is too long or too far apart to be found.

All of it is one projection of built-in expressions, with patterns that read a text in one pass each; the tables are literals of a fixed size. Texts without any of the words that
each known sentence must hold are not read further.

Defined cases: a null or empty text has no sentences; texts of any length are read whole; repeated rows are scanned each on its own; further columns stay; columns with the result's
names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm._common import LOWER, UPPER

#: Licence sentences as published, by identifier (one letter each).
SENTENCES = {
    "m": ("Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "p": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions:",
    ),
    "n": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "w": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE '
        "AND NONINFRINGEMENT.",
    ),
    "l": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR "
        "IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "a": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0"),
    "c": ("you may not use this file except in compliance with the License.",),
    "o": (
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License '
        'is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "u": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    "g": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "r": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    "s": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    "h": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    ),
    "y": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "b": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "d": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "e": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "f": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    "k": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    "t": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    "x": ("All rights reserved.",),
}
#: Ordered rules: licence, the sequence of identifiers, whether other identifiers may lie between. A later rule sees what the earlier ones left.
RULES = (
    ("apache-2.0-notice", "aco", True),
    ("mit-text", "pnw", True),
    ("mit-text", "nw", True),
    ("gpl-3.0-notice", "rh", True),
    ("gpl-2.0-notice", "sh", True),
    ("bsd-3-clause", "xdefkt", True),
    ("bsd-3-clause", "defkt", True),
    ("bsd-2-clause", "xdeft", True),
    ("bsd-2-clause", "deft", True),
    ("apache-2.0", "a", False),
    ("mit", "m", False),
    ("gpl-3.0", "g", False),
    ("cc-by-nc-4.0", "y", False),
    ("cc-by-4.0", "b", False),
    ("bsd", "d", False),
    ("proprietary", "x", False),
)
#: Steps from a lower-cased text, between empty lines and with `.` for `!` and `?` and `;` for `:`, to words with ` ` between them, `!!` at the ends of sentences and `//` where one
#: may end. Each pattern begins with what it must hold, so no run is read more than once.
STEPS = (
    (r"[^a-z0-9\n.;]+", " "),
    (r"[.]+", "."),
    (r"[;]+", ";"),
    (r"[.][ \n]", "!"),
    (r"\n ?\n", "!"),
    (r";[ \n]|\n", "/"),
    (r"[ .;]+", " "),
    (r" ?/[ /]*", "/"),
    (r"[ /]?![ !/]*", "!!"),
    (r"/", "//"),
)
FROM, TO = UPPER + "!?:", LOWER + "..;"


def words(sentence: str) -> list[str]:
    return re.findall("[a-z0-9]+", sentence.lower())


def known_sentences(table: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier."""
    return {" ".join(words(s)): i for i, of in table.items() for s in of}


def sentence_pattern(known: dict[str, str]) -> str:
    """Matches a known sentence between two ends; its group is the sentence. Longer sentences come first."""
    return "[!/](" + "|".join(s.replace(" ", "(?: |//)") for s in sorted(known, key=lambda s: (-len(s), s))) + ")[!/]"


def anchors(known: dict[str, str]) -> list[str]:
    """Words of which each known sentence holds one: the most frequent of the longer ones first."""
    left, out = [set(s.split()) for s in known], []
    while left:
        n = Counter(w for s in left for w in s)
        out.append(max(n, key=lambda w: (len(w) > 5, n[w], len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def normalised(text: Column) -> Column:
    out = F.concat(F.lit("\n\n"), F.translate(text, FROM, TO), F.lit("\n\n"))
    for pattern, mark in STEPS:
        out = F.regexp_replace(out, pattern, mark)
    return out


def sentence_ids(text: Column, table: dict[str, tuple[str, ...]] = SENTENCES) -> Column:
    """The identifiers of the known sentences, in order, as one string."""
    known = known_sentences(table)
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.regexp_extract_all(normalised(text), F.lit(sentence_pattern(known)), F.lit(1))
    named = F.concat_ws("", F.transform(found, lambda s: F.element_at(ids, F.replace(s, F.lit("//"), F.lit(" ")))))
    return F.when(F.regexp_like(text, F.lit("(?i)" + "|".join(anchors(known)))), named).otherwise("")


def rule_pattern(sequence: str, gaps: bool) -> tuple[str, int]:
    """A rule as a pattern over identifiers, and the number of its groups: what lies between, which stays."""
    return ("([a-z]*?)".join(sequence), len(sequence) - 1) if gaps else (sequence, 0)


def licence_matches(df: DataFrame, ids_col: str, rules: tuple[tuple[str, str, bool], ...] = RULES) -> DataFrame:
    """df with the licences whose rules match its identifiers, in the rules' order, each once. A matched sequence's identifiers are taken out before the next rule; a gap's stay."""
    out = df.withColumns({"_rest": F.col(ids_col), "_found": F.array().cast("array<string>")})
    for name, sequence, gaps in rules:
        pattern, groups = rule_pattern(sequence, gaps)
        hit = F.when(F.regexp_like("_rest", F.lit(pattern)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
        left = F.regexp_replace("_rest", pattern, "".join(f"${i + 1}" for i in range(groups)))
        out = out.select(*df.columns, left.alias("_rest"), F.array_union("_found", hit).alias("_found"))
    return out.select(*df.columns, F.col("_found").alias("licenses"))


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df without its text, with sentence_ids, licenses (array) and n_licenses."""
    rest = [c for c in df.columns if c not in {text_col, "sentence_ids", "licenses", "n_licenses", "_rest", "_found"}]
    found = df.select(*rest, sentence_ids(F.coalesce(F.col(text_col), F.lit(""))).alias("sentence_ids"))
    return licence_matches(found, "sentence_ids").withColumn("n_licenses", F.size("licenses").cast("long"))
