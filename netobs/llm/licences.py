"""Licence scans: text units compared with licence templates by Dice over word bigrams.

A document's units are its lines, its paragraphs of several lines and the whole
text; notices inside them are found in paragraphs of comments, in sentences and in
windows of as many words as a template has. A unit is lower-cased, everything but letters and digits becomes one space.
Dice = 2 |A and B| / (|A| + |B|) over the distinct word bigrams; to reach t, |A|
must lie between t/(2-t) |B| and (2-t)/t |B|, so only templates of such sizes are
looked at. Everything is a column expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netobs.plans.stage import stage

DICE = 0.8
SLACK = 1e-9  # so that rounding never moves a bound past a whole number
NO_WORD = r"[^\p{L}\p{N}]"
KINDS = ("line", "paragraph", "text", "comment", "sentence", "window")

# Notices and licence texts as their publishers word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "BSD source condition": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
    "BSD binary condition": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 long notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def grams_of(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def template_column(templates: dict[str, str]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(name).alias("licence"), F.lit(len(grams)).alias("size"), F.array(*map(F.lit, grams)).alias("grams"),
            F.lit(words).alias("words"),
        )
        for name, grams, words in ((n, grams_of(t), template_words(t)) for n, t in templates.items())
    ])


def template_words(text: str) -> int:
    return len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split())


def units(text: Column, inside: bool = False) -> Column:
    """(kind, unit_no, unit) of a text: lines, paragraphs of several lines, and the text where it has several lines.

    ``inside`` adds paragraphs of several lines between lines without letters and
    digits, such as a lone comment sign, where that gives more parts, and sentences.
    """

    def all_of(kind: int, parts: Column) -> Column:
        return F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit_no"), x.alias("unit")))

    def of_several_lines(kind: int, parts: Column, more_than: Column) -> Column:
        several = F.filter(all_of(kind, parts), lambda x: x["unit"].contains("\n"))
        return F.when(F.size(parts) > more_than, several).otherwise(F.filter(several, lambda x: F.lit(False)))

    paragraphs = F.split(text, r"\n\s*\n")
    whole = F.filter(all_of(2, F.array(text)), lambda x: x["unit"].contains("\n"))
    found = [all_of(0, F.split(text, "\n")), of_several_lines(1, paragraphs, F.lit(1)), whole]
    if inside:
        found.append(of_several_lines(3, F.split(text, rf"\n{NO_WORD}*\n"), F.size(paragraphs)))
        found.append(all_of(4, F.split(text, rf"(?<=[.!?]|[.!?][\"')\]])\s+|\n{NO_WORD}*\n")))
    return F.concat(*found)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def words_in(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), f"{NO_WORD}+", " ")), " ")


def pairs_of(words: Column) -> Column:
    """All bigrams in their order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def windows(pairs: Column, hits: Column, template: Column, low: float) -> Column:
    """(kind, unit_no, grams, only) of the windows of the template's size that can reach it.

    Windows start where one of its bigrams occurs, the last ones early enough
    to be whole, and only where enough of its bigrams follow within the window.
    ``unit_no`` is the number of the window's first word.
    """
    span = template["words"] - 1
    need = F.greatest(F.ceil(low * template["size"]), F.lit(1)).cast("int")
    own = F.transform(F.filter(hits, lambda h: F.array_contains(template["grams"], h["gram"])), lambda h: h["at"])
    starts = bound(own, lambda at: F.filter(at, lambda x, j: F.get(at, j + need - 1) - x < span))
    last = F.greatest(F.size(pairs) - span + 1, F.lit(1))
    starts = F.array_distinct(F.transform(starts, lambda x: F.least(x, last)))
    return F.transform(
        starts,
        lambda x: F.struct(
            F.lit(5).alias("kind"), (x - 1).alias("unit_no"), F.array_distinct(F.slice(pairs, x, span)).alias("grams"),
            template["licence"].alias("only"),
        ),
    )


def scan(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = DICE, key: str = "doc_id", text: str = "text",
    inside: bool = False,
) -> DataFrame:
    """(doc_id, licence, dice, unit, unit_no): each document's best unit for every template it reaches.

    ``unit`` is line, paragraph or text, with ``inside`` also comment, sentence or
    window; ``unit_no`` is its number from 0, a window's that of its first word.
    Ties go to the earlier kind in this order, then the first. Null and empty
    texts have no unit with a bigram and no row; rows that share a key are one
    document.
    """
    templates = templates or TEMPLATES
    wanted = template_column(templates)
    low, high = least / (2 - least) - SLACK, (2 - least) / least + SLACK
    found = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stage(found, {"words": words_in(F.col("text"))}, where=F.col("text") != "")
    # n words have at most n - 1 bigrams: shorter texts reach no template.
    smallest = min(len(grams_of(t)) for t in templates.values())
    found = stage(found, {"pairs": pairs_of(F.col("words"))}, where=F.size("words") - 1 >= low * smallest, drop=["words"])
    # Units have no bigrams that the text has not, so a text with too few of a template's has no unit that reaches it.
    any_gram = sorted({g for t in templates.values() for g in grams_of(t)})
    hit = F.transform("pairs", lambda g, i: F.when(g.isin(any_gram), F.struct((i + 1).alias("at"), g.alias("gram"))))
    found = stage(found, {"hits": F.filter(hit, lambda h: h.isNotNull())})
    seen = F.array_distinct(F.transform("hits", lambda h: h["gram"]))
    near = bound(seen, lambda s: F.filter(wanted, lambda t: F.size(F.array_intersect(t["grams"], s)) >= low * t["size"]))
    found = stage(found, {"near": near}, where=F.size("hits") > 0)
    parts = F.transform(
        units(F.col("text"), inside),
        lambda u: F.struct(
            u["kind"].alias("kind"), u["unit_no"].alias("unit_no"),
            bound(words_in(u["unit"]), lambda w: F.array_distinct(pairs_of(w))).alias("grams"), F.lit(None).cast("string").alias("only"),
        ),
    )
    if inside:
        parts = F.concat(parts, F.flatten(F.transform("near", lambda t: windows(F.col("pairs"), F.col("hits"), t, low))))
    found = found.where(F.size("near") > 0).select("doc_id", "near", F.inline(parts))
    size = F.size("grams")
    fits = F.filter(
        "near",
        lambda t: (size >= low * t["size"]) & (size <= high * t["size"]) & F.coalesce(F.col("only") == t["licence"], F.lit(True)),
    )
    tried = found.select("doc_id", "kind", "unit_no", "grams", F.explode(fits).alias("t"))
    dice = 2.0 * F.size(F.array_intersect("grams", "t.grams")) / (F.size("grams") + F.col("t.size"))
    tried = stage(tried.select("doc_id", "kind", "unit_no", "grams", "t"), {"licence": F.col("t.licence"), "dice": dice}, drop=["grams", "t"])
    best = F.max(F.struct("dice", (-F.col("kind")).alias("k"), (-F.col("unit_no")).alias("a"))).alias("best")
    best = tried.where(F.col("dice") >= least).groupBy("doc_id", "licence").agg(best)
    names = F.element_at(F.array(*map(F.lit, KINDS)), 1 - F.col("best.k"))
    return best.select("doc_id", "licence", F.col("best.dice").alias("dice"), names.alias("unit"), (-F.col("best.a")).alias("unit_no"))
