"""License scans with DataFrame functions only.

A unit of text (each line, and the whole text) is normalised: A-Z in lower
case, words of letters and digits. Its set of word bigrams is compared with
those of licence templates by the Dice coefficient ``2 |A and B| / (|A| + |B|)``.
A template can only reach the threshold ``t`` if the unit's set has between
``t / (2 - t)`` and ``(2 - t) / t`` of its bigrams, so units outside all bounds
are never cut into bigrams, and inside only the templates whose bounds fit are
compared. Before that, a unit must hold one of the templates' anchors: the
threshold needs at least ``t / (2 - t)`` of a template's bigrams, so of any
larger part of them than the rest at least one is there, and the anchors are
words that such a part is made with.

Notices that are wrapped over lines, stand inside a longer line or in a licence
file are found by windows: runs of consecutive words of the whole text, across
lines, of ``t / (2 - t)`` to ``(2 - t) / t`` times the template's bigrams. Only
windows that start and end with one of the template's bigrams are compared, as
trimming any other end never lowers the coefficient, and only for templates of
which the text holds ``t / (2 - t)`` of the bigrams, as a window needs as many.
A licence file counts by the notice or sentence (``TEXTS``) that it holds.

Defined results
    null or empty text: no match (``license`` null, ``dice`` 0). A text's
    licence is the template of its best unit; ties go to the earlier unit
    (whole text first), then the template's name. A window counts only where it
    is better than every unit; its ``unit`` is the line it starts in, ties go to
    the template with more bigrams, the earlier start, then the name. Rows that repeat a
    ``doc_id`` are scanned each by itself. Empty table: empty result. Other
    columns pass through; internal names start with ``__ls_``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxlink.llm.common import let, require, text_of

DICE = 0.8
#: Licence notices as their licences word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Sentences of licence files that hold none of the notices; looked for by windows only.
TEXTS = {
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "CC-BY-4.0-text": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\").",
    "CC-BY-NC-4.0-text": "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License (\"Public License\").",
}
WORDS = "[a-z0-9]+"
_LONG = 6


def template_bigrams(text: str) -> list[str]:
    words = re.findall(WORDS, text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def bounds(n: int, dice: float) -> tuple[float, float]:
    """Set sizes that can reach the coefficient against a set of ``n``."""
    return n * dice / (2 - dice), n * (2 - dice) / dice


def anchors(sets: dict[str, list[str]], dice: float) -> tuple[list[str], list[str]]:
    """Long words and patterns of bigrams, one of which every unit that reaches
    the threshold must hold."""
    words: list[str] = []
    pairs: list[str] = []
    for grams in sets.values():
        spare = len(grams) - math.ceil(bounds(len(grams), dice)[0] - 1e-9) + 1
        left = [g for g in grams if not any(a in w for a in words for w in g.split())]
        while len(grams) - len(left) < spare:
            count = Counter(w for g in left for w in set(g.split()) if len(w) >= _LONG)
            if count:
                best = max(count, key=lambda w: (count[w] * len(w), w))
                words.append(best)
                left = [g for g in left if not any(best in w for w in g.split())]
            else:
                pair = max(left, key=lambda g: (len(g), g))
                pairs.append(pair.replace(" ", "[^a-z0-9]+"))
                left.remove(pair)
    return sorted(words), sorted(set(pairs))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    return F.array_distinct(running_bigrams(words))


def best_window(text: Column, sets: dict[str, list[str]], dice: float) -> Column:
    """Struct of d (the coefficient, negated), less (the template's bigrams, negated), at (place of the first word), license; null if no window is compared."""
    strings = lambda x: F.array(*[F.lit(g) for g in x])
    rows = []
    for name, own in sets.items():
        low, high = bounds(len(own), dice)
        rows.append(F.struct(F.lit(name).alias("license"), F.lit(math.ceil(low - 1e-9)).alias("low"), F.lit(math.floor(high + 1e-9)).alias("high"), strings(own).alias("own")))

    def ends(g: Column, t: Column, a: Column) -> Column:
        last = F.least(a + t["high"] - 1, F.size(g))
        span = F.when(a + t["low"] - 1 <= last, F.sequence(a + t["low"] - 1, last)).otherwise(F.array().cast("array<int>"))
        return F.filter(span, lambda b: F.array_contains(t["own"], F.get(g, b - 1)))

    def judged(g: Column, t: Column, a: Column, b: Column) -> Column:
        score = lambda s: -(2.0 * F.size(F.array_intersect(s, t["own"])) / (F.size(s) + F.size(t["own"])))
        return F.struct(let(F.array_distinct(F.slice(g, a, b - a + 1)), score).alias("d"), (-F.size(t["own"])).alias("less"), a.alias("at"), t["license"].alias("license"))

    def best(g: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(g)), lambda a: F.array_contains(t["own"], F.get(g, a - 1)))
        return F.array_min(F.transform(starts, lambda a: F.array_min(F.transform(ends(g, t, a), lambda b: judged(g, t, a, b)))))

    def over(g: Column) -> Column:
        known = F.array_intersect(g, strings(sorted({x for own in sets.values() for x in own})))
        fits = let(known, lambda k: F.filter(F.array(*rows), lambda t: F.size(F.array_intersect(k, t["own"])) >= t["low"]))
        return F.array_min(F.transform(fits, lambda t: best(g, t)))

    return let(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda words: let(running_bigrams(words), over))


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, that holds the word of that place."""
    sizes = F.transform(F.split(text, "\n", -1), lambda t: F.size(F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))))
    zero = F.struct(F.lit(0).alias("words"), F.lit(1).alias("line"))
    return F.aggregate(sizes, zero, lambda acc, n: F.struct((acc["words"] + n).alias("words"), (acc["line"] + F.when(acc["words"] + n < at, 1).otherwise(0)).alias("line")), lambda acc: acc["line"])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """``docs`` with ``__ls_best``: struct of dice, license, unit (0: whole text, else the line)."""
    require(docs, "text")
    if not 0 < dice <= 1:
        raise ValueError("dice must be in (0, 1]")
    sets = {k: template_bigrams(v) for k, v in (templates or TEMPLATES).items()}
    sets = dict(sorted((k, v) for k, v in sets.items() if v))
    spoken = sets | ({} if templates else {k: template_bigrams(v) for k, v in TEXTS.items()})
    low, high = min(bounds(len(v), dice)[0] for v in sets.values()), max(bounds(len(v), dice)[1] for v in sets.values())
    # a set of n bigrams takes n + 1 words at least, each of a character and a separator
    least_chars = 2 * int(low) + 1
    words, pairs = anchors(spoken, dice)
    text = F.col("__ls_text")
    anchored = lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words] + ([t.rlike("|".join(pairs))] if pairs else []))
    whole = F.struct(F.lit(0).alias("unit"), text.alias("t"))
    lines = F.transform(F.split(text, "\n", -1), lambda t, i: F.struct((i + 1).alias("unit"), t.alias("t")))
    units = F.filter(F.concat(F.array(whole), lines), lambda u: (F.length(u["t"]) >= least_chars) & anchored(u["t"]))
    # each step hands its result to the next as a field, so nothing is computed twice
    cut = F.transform(units, lambda u: F.struct(u["unit"].alias("unit"), F.regexp_extract_all(u["t"], F.lit(WORDS), F.lit(0)).alias("words")))
    # n words hold at most n - 1 bigrams, n distinct words at least n - 1 distinct ones
    fits = F.filter(cut, lambda u: (F.size(u["words"]) - 1 >= low - 1e-9) & (F.size(F.array_distinct(u["words"])) - 1 <= high + 1e-9))
    paired = F.transform(fits, lambda u: F.struct(u["unit"].alias("unit"), bigrams(u["words"]).alias("grams")))

    def judged(u: Column) -> Column:
        score = []
        for name, own in sets.items():
            n, (a, b) = F.size(u["grams"]), bounds(len(own), dice)
            both = F.size(F.array_intersect(u["grams"], F.array(*[F.lit(x) for x in own])))
            d = F.when((n >= a - 1e-9) & (n <= b + 1e-9), 2.0 * both / (n + len(own))).otherwise(0.0)
            score.append(F.struct((-d).alias("d"), u["unit"].alias("unit"), F.lit(name).alias("license")))
        return F.array_min(F.array(*score))

    best = F.array_min(F.transform(paired, judged))
    kind = "struct<dice:double,license:string,unit:int>"

    def found(unit: Column) -> Column:
        whole = unit["d"] <= -1.0 + 1e-12  # no window is better
        return let(F.when(whole.isNull() | ~whole, best_window(text, spoken, dice)), lambda w: chosen(unit, w))

    def chosen(unit: Column, window: Column) -> Column:
        ahead = window["d"].isNotNull() & (window["d"] < F.coalesce(unit["d"], F.lit(0.0)) - 1e-12)
        d = F.when(ahead, window["d"]).otherwise(unit["d"])
        name = F.when(ahead, window["license"]).otherwise(unit["license"])
        place = F.when(ahead, line_of(text, window["at"])).otherwise(unit["unit"])
        return F.when(-d >= dice - 1e-12, F.struct((-d).alias("dice"), name.alias("license"), place.alias("unit")).cast(kind))

    out = docs.withColumn("__ls_text", _lower(text_of("text")))
    return out.withColumn("__ls_best", F.when(anchored(text), let(best, found))).drop("__ls_text")
