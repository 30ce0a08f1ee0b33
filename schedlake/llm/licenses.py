"""License scans: normalised parts of a text against templates, by the Dice coefficient of their word bigrams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, functions as F

from schedlake.llm.shared import LOWER, UPPER, bind, lower_ascii

LEAST = 0.8
#: Bigrams of templates in one literal; a larger library is compared in as many literals.
BLOCK_BIGRAMS = 20_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Customary notices, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
]


_GNU = ("is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
        "Software Foundation, {} of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} "
        "along with this program.")
#: The headers that licences ask to put into files, by SPDX identifier.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    *[(name, _GNU.format(license, version, license, license)) for name, license, version in [
        ("GPL-3.0", "General Public License", "either version 3"), ("GPL-2.0", "General Public License", "either version 2"),
        ("LGPL-3.0", "Lesser General Public License", "either version 3"),
        ("LGPL-2.1", "Lesser General Public License", "either version 2.1"),
        ("AGPL-3.0", "Affero General Public License", "either version 3")]],
]


def full_texts() -> list[tuple[str, str]]:
    """The whole texts of licences, by SPDX identifier."""
    found = [f for f in files("schedlake.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in found)


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """The sizes of sets whose Dice coefficient with a set of this size can reach ``least``."""
    return math.ceil(size * least / (2 - least) - 1e-9), math.floor(size * (2 - least) / least + 1e-9)


def gate(templates: Iterable[list[str]], least: float) -> list[str]:
    """Bigrams of which every text that matches a template holds at least one.

    A match shares at least ``size * least / (2 - least)`` bigrams with the template, so it holds one of any selection
    that leaves out fewer; the longest are selected, as they are the rarest.
    """
    out: set[str] = set()
    for bigrams in templates:
        out.update(sorted(bigrams, key=lambda b: (-len(b), b))[:len(bigrams) - size_bounds(len(bigrams), least)[0] + 1])
    return sorted(out)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), NOT_WORD, " "))


def parts(text: Column) -> Column:
    """The text, its lines and its sentences, normalised, each once."""
    lines = F.split(text, "\n")
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    return F.array_distinct(F.transform(F.concat(F.array(text), lines, sentences), normal))


def word_bigrams(part: Column) -> Column:
    words = F.split(part, " ")
    return bind(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1])))).otherwise(
            F.array().cast("array<string>")))


def scan(text: Column, templates: Iterable[tuple[str, str]] = tuple(NOTICES), least: float = LEAST) -> Column:
    """``dice, name`` of every part of a text and template with a coefficient of at least ``least``, best first."""
    named = sorted({(name, tuple(template_bigrams(t))) for name, t in templates})
    if not all(b for _, b in named) or not 0 < least <= 1:
        raise ValueError("a template needs two words, and the least coefficient lies in (0, 1]")
    none = F.array().cast("array<struct<dice:double,name:string>>")
    if not named:
        return none
    blocks: list[list] = [[]]
    for name, bigrams in named:
        if blocks[-1] and sum(len(b) for _, b in blocks[-1]) + len(bigrams) > BLOCK_BIGRAMS:
            blocks.append([])
        blocks[-1].append((name, bigrams))

    def compared(part: Column) -> Column:
        def with_block(bigrams: Column, block: list) -> Column:
            literal = F.array(*[F.struct(
                F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.lit(size_bounds(len(b), least)[0]).alias("low"),
                F.lit(size_bounds(len(b), least)[1]).alias("high"), F.array(*[F.lit(x) for x in b]).alias("b")) for name, b in block])
            fitting = F.filter(literal, lambda t: F.size(bigrams).between(t["low"], t["high"]))
            scored = F.transform(fitting, lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(bigrams, t["b"])) / (F.size(bigrams) + t["n"])).alias("dice"), t["name"].alias("name")))
            return F.filter(scored, lambda s: s["dice"] >= least)

        return bind(word_bigrams(part), lambda b: F.concat(*[with_block(b, block) for block in blocks]))

    whole = normal(text)
    opens = bind(whole, lambda n: reduce(Column.__or__, [F.contains(n, F.lit(g)) for g in gate([b for _, b in named], least)]))
    found = F.flatten(F.transform(parts(text), compared))
    ordered = F.sort_array(F.transform(found, lambda s: F.struct((-s["dice"]).alias("dice"), s["name"].alias("name"))))
    return F.when(opens, F.transform(ordered, lambda s: F.struct((-s["dice"]).alias("dice"), s["name"].alias("name")))).otherwise(none)


def windows(text: Column, templates: Iterable[tuple[str, str]], least: float = LEAST) -> Column:
    """``dice, name``: for each name the best coefficient that a window of words reaches, if it is at least ``least``.

    The words of the whole text are taken in a row, whatever lines and sentences they stand in. A window has the words
    of its template, fewer at the end of the text, and begins with one of the template's bigrams. A window with fewer of
    them than the best coefficient so far needs is passed over.
    """
    sized = sorted({(name, len(template_words(t)), tuple(template_bigrams(t))) for name, t in templates})
    none = F.array().cast("array<struct<dice:double,name:string>>")
    if not sized:
        return none

    def array_of(bigrams: Iterable[str]) -> Column:
        return F.split(F.lit("\n".join(bigrams)), "\n")

    def best(g: Column, words: int, bigrams: tuple[str, ...]) -> Column:
        n, low = len(bigrams), size_bounds(len(bigrams), least)[0]

        def of(known: Column) -> Column:
            def dice(start: Column) -> Column:
                return bind(F.array_distinct(F.slice(g, start + 1, F.lit(words - 1))), lambda d: (
                    2.0 * F.size(F.array_intersect(d, known)) / (F.size(d) + n)))

            def over(at: Column) -> Column:
                def step(top: Column, j: Column) -> Column:
                    need = F.greatest(F.lit(low), F.ceil(top * n / (2 - top) - 1e-9).cast("int"))
                    enough = F.get(at, j + need - 1) <= F.get(at, j) + (words - 2)
                    return F.when((top < 1) & enough, F.greatest(top, dice(F.get(at, j)))).otherwise(top)

                return F.aggregate(F.sequence(F.lit(0), F.size(at) - low), F.lit(0.0), step)

            places = F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(known, x), i)), F.isnotnull)
            return F.when(F.size(known) >= low, bind(places, over)).otherwise(0.0)

        return bind(F.array_intersect(g, array_of(bigrams)), of)

    def compared(g: Column) -> Column:
        each = {}
        for name, words, bigrams in sized:
            each.setdefault(name, []).append(best(g, words, bigrams))
        scored = F.array(*[F.struct(F.greatest(F.lit(0.0), *tops).alias("dice"), F.lit(name).alias("name"))
                           for name, tops in each.items()])
        opening = array_of(gate([b for _, _, b in sized], least))
        return F.when(F.arrays_overlap(g, opening), F.filter(scored, lambda s: s["dice"] >= least)).otherwise(none)

    def in_a_row(w: Column) -> Column:
        return F.when(F.size(w) > 1, F.transform(
            F.slice(w, F.lit(1), F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), w[i + 1]))).otherwise(
                F.array().cast("array<string>"))

    return bind(bind(F.split(normal(text), " "), in_a_row), compared)


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
             templates: Iterable[tuple[str, str]] = tuple(NOTICES), least: float = LEAST,
             texts: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, n_matches, license, dice, licenses``, one row per row of docs.

    ``n_matches`` counts pairs of a distinct part (the text, a line, a sentence) and a template, and names for which a
    window of words comes closer to one of ``templates`` or ``texts`` (by default the headers and whole texts) than any
    part does; ``license`` is the name of the best of these, the first in the alphabet among equals, ``licenses`` all
    names, sorted and comma-joined. Null and empty texts match nothing: 0, null, null and an empty string. Nothing is
    shuffled or moved; texts without any of the gate's bigrams are not taken apart.
    """
    templates = list(templates)
    texts = [*HEADERS, *full_texts()] if texts is None else list(texts)
    whole = F.coalesce(F.col(text), F.lit(""))

    def closer(found: Column) -> Column:
        return F.filter(found["w"], lambda w: ~F.exists(found["p"], lambda p: (p["name"] == w["name"]) & (p["dice"] >= w["dice"])))

    def best_first(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda s: F.struct((-s["dice"]).alias("dice"), s["name"].alias("name"))))
        return F.transform(ordered, lambda s: F.struct((-s["dice"]).alias("dice"), s["name"].alias("name")))

    both = F.struct(scan(whole, templates, least).alias("p"), windows(whole, [*templates, *texts], least).alias("w"))
    found = docs.select(F.col(doc_id).alias("doc_id"), bind(both, lambda b: best_first(F.concat(b["p"], closer(b)))).alias("found"))
    best = F.get("found", F.lit(0))
    return found.select(
        F.col("doc_id").alias(doc_id), F.size("found").cast("long").alias("n_matches"), best["name"].alias("license"),
        best["dice"].alias("dice"),
        F.array_join(F.sort_array(F.array_distinct(F.col("found.name"))), ",").alias("licenses"))
