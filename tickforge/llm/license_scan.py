"""Licence scan by the Dice coefficient over word bigrams.

A text is compared line by line and paragraph by paragraph with licence texts. Both sides are normalised to
lower-case ASCII letters and digits with single spaces. A score of at least ``MIN_DICE`` bounds the number of
bigrams on either side by the other, so most templates are ruled out by size before any set is intersected. It
also asks for two thirds of a template's bigrams, so a few words of each, of which one at least must be there, rule
out most texts before any set is built. All work on a document happens in its row: nothing is shuffled.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_DICE = 0.8

#: Usual licence notices and short licence texts, by SPDX identifier.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
]

#: Words too common to tell a licence by; they are only asked for where a notice has no others.
COMMON = frozenset("a all an and any as at be by for from if in is it may not of on or that the these this to under with you".split())

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain_bigrams(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def templates(notices: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """Identifier and bigrams of each notice."""
    return [(name, _plain_bigrams(text)) for name, text in notices]


def needed_words(grams: list[str], min_dice: float) -> set[str]:
    """Words of which a text must hold one: too few of the bigrams for ``min_dice`` do without all of them."""
    words, least = sorted({w for g in grams for w in g.split()}), math.ceil(len(grams) * min_dice / (2 - min_dice) - 1e-9)
    chosen: set[str] = set()
    left = [set(g.split()) for g in grams]
    while len(left) >= least:
        best = max((w for w in words if w not in chosen), key=lambda w: (w not in COMMON and len(w) > 1, sum(w in g for g in left), w))
        chosen.add(best)
        left = [g for g in left if best not in g]
    return chosen


def bigrams(unit: Column) -> Column:
    """Distinct word bigrams of a normalised text."""
    words = F.split(unit, " ", -1)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.instr(unit, " ") > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " "))


def units(text: Column) -> Column:
    """Lines, and paragraphs of more than one line."""
    lines = F.split(text, "\n", -1)
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n", -1), lambda x: F.instr(x, "\n") > 0)
    return F.concat(F.transform(lines, normalised), F.transform(paragraphs, normalised))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] = NOTICES,
         min_dice: float = MIN_DICE) -> DataFrame:
    """id, license (the identifier with the highest Dice coefficient, null below ``min_dice``), dice and n_units
    (lines and paragraphs that match any notice) for every row.

    Equal coefficients go to the last identifier in code point order. Null, empty and one-word texts match nothing.
    Repeated rows and null ids give a row each.
    """
    known = templates(notices)
    candidates = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(grams)).alias("n"), F.array(*map(F.lit, grams)).alias("grams"))
                           for name, grams in known))
    low = min(len(g) for _, g in known) * min_dice / (2 - min_dice)
    high = max(len(g) for _, g in known) * (2 - min_dice) / min_dice

    def best(unit_grams: Column) -> Column:
        size = F.size(unit_grams)
        fitting = F.filter(candidates, lambda t: ((2 - min_dice) * size >= min_dice * t["n"]) & ((2 - min_dice) * t["n"] >= min_dice * size))
        dice = F.transform(fitting, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(unit_grams, t["grams"])) / (size + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.array_max(dice)

    words = sorted(set().union(*(needed_words(grams, min_dice) for _, grams in known)))
    hint = F.lit("(?i)(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])")
    text = F.col(text_col)
    likely = F.filter(units(text), lambda u: F.rlike(u, hint) & (F.size(F.split(u, " ", -1)) - 1 >= low))
    sets = F.filter(F.transform(likely, bigrams), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    found = F.when(F.rlike(text, hint), F.filter(F.transform(sets, best), lambda b: b["dice"] >= min_dice))
    top = docs.select(F.col(id_col), F.coalesce(found, F.array().cast("array<struct<dice:double,name:string>>")).alias("_found"))
    return top.select(id_col, F.array_max("_found")["name"].alias("license"), F.array_max("_found")["dice"].alias("dice"),
                      F.size("_found").cast("long").alias("n_units"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_NORMAL = f"trim(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ')"
SQL = rf"""
WITH t(name, grams) AS (VALUES {", ".join(f"('{n}', {_sql_list(g)})" for n, g in templates(NOTICES))}),
  d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
  u AS (SELECT k, unnest(list_concat(string_split(text, chr(10)),
          list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda x: contains(x, chr(10))))) AS u FROM d),
  w AS (SELECT k, string_split({_NORMAL}, ' ') AS w FROM u),
  g AS (SELECT k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams, row_number() OVER () AS r FROM w),
  s AS (SELECT g.k, g.r, t.name, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
        FROM g JOIN t ON len(g.grams) > 0 AND list_has_any(g.grams, t.grams)),
  b AS (SELECT k, name, dice, r FROM s WHERE dice >= {MIN_DICE}),
  m AS (SELECT k, arg_max(name, (dice, name)) AS license, max(dice) AS dice, count(DISTINCT r) AS n_units FROM b GROUP BY k)
SELECT d.doc_id, m.license, m.dice, coalesce(m.n_units, 0)::BIGINT AS n_units FROM d LEFT JOIN m ON d.k = m.k
"""
