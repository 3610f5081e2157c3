"""Licence statements in texts: Dice coefficient over word bigrams against templates. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.expr import let
from guardlake.operators.barrier import sealed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Licence names (SPDX identifiers where there are such) and usual wordings of each.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]


def bigrams(text: Column) -> Column:
    """Different pairs of neighbouring words; words are runs of a-z and 0-9 after A-Z are lower-cased."""
    plain = F.trim(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))

    def pairs(words: Column) -> Column:
        first, second = F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words))
        joined = F.zip_with(first, second, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(F.size(words) > 1, F.array_distinct(joined)).otherwise(F.array().cast("array<string>"))

    return let(F.split(plain, " "), pairs)


def units(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, level, unit, text): every line, every paragraph of several lines, every text of several paragraphs.

    Paragraphs are parted by blank lines. Units count from 0 in their text; blank ones are left out.
    """
    def of(level: str, body: Column, unit: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), unit.alias("unit"), body.alias("body"))

    def split(whole: Column) -> Column:
        return let(F.split(whole, "\n[ \t]*\n[ \t\n]*"), lambda parts: listed(whole, parts))

    def listed(whole: Column, parts: Column) -> Column:
        line = F.transform(F.split(whole, "\n"), lambda x, i: of("line", x, i))
        several = F.filter(F.transform(parts, lambda x, i: of("paragraph", x, i)), lambda u: F.contains(u["body"], F.lit("\n")))
        none = F.array().cast("array<struct<level:string,unit:int,body:string>>")
        return F.concat(line, several, F.when(F.size(parts) > 1, F.array(of("text", whole, F.lit(0)))).otherwise(none))

    cut = let(F.regexp_replace(F.col(text), "\r\n?", "\n"), split)
    found = docs.select(F.col(key).alias("key"), F.explode(cut).alias("u"))
    return found.select("key", "u.level", "u.unit", "u.body").where(F.rlike("body", F.lit("[A-Za-z0-9]")))


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, level, unit, license, dice): the closest licence of every unit that has a Dice coefficient of ``threshold`` or
    more with any; of equally close ones the first by name.

    Sizes alone bound the coefficient, so a template with ``b`` bigrams is a
    candidate only for units with ``b * t / (2 - t)`` to ``b * (2 - t) / t`` of them: units meet templates by an
    equality of sizes. Null and empty texts and units of one word match nothing; equal findings of rows that share a
    key count once. The templates are a parameter of the plan, and few.
    """
    known = docs.sparkSession.createDataFrame(templates, "license string, wording string")
    known = known.select("license", bigrams(F.col("wording")).alias("wanted")).withColumn("b", F.size("wanted")).where("b > 0")
    low, high = F.ceil(F.col("b") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("b") * (2 - threshold) / threshold + 1e-9)
    known = known.withColumn("a", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    found = sealed(units(docs, text, key).select("key", "level", "unit", bigrams(F.col("body")).alias("own")))
    found = found.withColumn("a", F.size("own"))
    dice = 2 * F.size(F.array_intersect("own", "wanted")) / (F.col("a") + F.col("b"))
    near = sealed(found.join(F.broadcast(known), "a").select("key", "level", "unit", "own", "license", dice.alias("dice")))
    best = near.where(F.col("dice") >= threshold).groupBy("key", "level", "unit", "own")
    best = best.agg(F.min(F.struct((-F.col("dice")).alias("less"), "license")).alias("best"))
    return best.select(F.col("key").alias(key), "level", "unit", "best.license", (-F.col("best.less")).alias("dice"))
