"""License notices by MinHash bands over overlapping windows, then exact shingle containment.

DataFrame functions only. Windows are as long as the notice they look for, plus a stride; only those
that share a shingle with a notice are hashed, which loses none as a match shares most of them.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pramana.llm._spark import table

SHINGLE, SIMILARITY = 5, 0.8
#: 24 bands of 2 values. A window holds up to stride - 1 words beside the notice, an eighth of it; with 80 % of
#: the shingles there, their likeness is about 0.6 or more (0.609 for a notice of 100 words) and 1 - (1 - 0.6 ** 2) ** 24 > 0.9999.
BANDS, DEPTH = 24, 2
MOST_TEMPLATE_WORDS = 100_000

# Texts of widely used license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense-line": "This is free and unencumbered software released into the public domain.",
}


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hash of every five consecutive words; of all words, if there are fewer."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def smallest(hashes: Column) -> Column:
    """MinHash values of a set of hashes."""
    return F.transform(F.array(*[F.lit(j) for j in range(BANDS * DEPTH)]), lambda j: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, j))))


def bands(low: Column, key: Column) -> Column:
    """Band keys of MinHash values. ``low`` should be a column by itself: within a lambda it would be made anew for each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(key, b, *[F.element_at(low, b * DEPTH + d + 1) for d in range(DEPTH)]))


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def anchor_words(templates: dict[str, str], share: float = 1 - SIMILARITY) -> list[str]:
    """Words of which a text has one if it holds the stated similarity of a template.

    For every template they are in more than 1 - similarity of its shingles, so that a text without
    any of them holds too few.
    """
    need = {}
    for name, text in templates.items():
        w = _words(text)
        need[name] = [set(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))]
    seen = Counter(w for t in templates.values() for w in set(_words(t)) if len(w) > 4)
    chosen: list[str] = []
    open_ = {n for n in need}
    while open_:
        left = Counter()
        for n in open_:
            for w in set().union(*need[n]):
                if w not in chosen:
                    left[w] += sum(w in s for s in need[n]) / len(need[n])
        chosen.append(max(left, key=lambda w: (len(w) > 4, left[w], seen[w], w)))
        open_ = {n for n in open_ if sum(bool(s & set(chosen)) for s in need[n]) <= share * len(need[n]) + 1e-9}
    return sorted(chosen)


def _library(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """One row for each template: name, window words and stride, shingle hashes, bands. Bounded by MOST_TEMPLATE_WORDS."""
    if sum(len(_words(t)) for t in templates.values()) > MOST_TEMPLATE_WORDS:
        raise ValueError("the templates are too large to be sent to all tasks: scan with a part of them at a time")
    rows = []
    for name, text in sorted(templates.items()):
        n = len(_words(text))
        stride = max(1, n // 8)
        rows.append(F.struct(F.lit(name).alias("template"), F.lit(text).alias("notice"), F.lit(n + stride - 1).alias("width"), F.lit(stride).alias("stride")))
    lib = spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    lib = lib.withColumn("shingles", F.array_distinct(shingles(tokens(F.col("notice"))))).withColumn("class", F.xxhash64("width", "stride"))
    lib = lib.withColumn("low", smallest(F.col("shingles")))
    return lib.select("template", "width", "stride", "class", "shingles", bands(F.col("low"), F.col("class")).alias("bands"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, template, containment, first_word, n_words): the best window for every notice in a text.

    containment is the share of the template's shingles in the window, ``similarity`` or more;
    first_word counts a-z and 0-9 words from 0. Null and empty texts hold none; repeated rows are reported once.
    """
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    lib = _library(spark, templates)
    # the library is bounded, so that its shingles can be a literal of the plan
    classes = lib.groupBy("width", "stride", "class").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("known")).orderBy("class").collect()
    looked_for = F.array(*[F.struct(F.lit(c["width"]).alias("width"), F.lit(c["stride"]).alias("stride"), F.lit(c["class"]).alias("class"), F.array(*[F.lit(h) for h in c["known"]]).alias("known")) for c in classes])
    text = F.col(text_col).cast("string")
    near = docs.where(text.rlike("(?i)" + "|".join(anchor_words(templates, 1 - similarity)))).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("_h"), tokens(text).alias("words"))
    hashed = near.select("id", "_h", F.size("words").alias("n"), shingles(F.col("words")).alias("hashes"))
    # a lambda binds the shingles that a text shares with a class, so that they are found once and not for each word
    shared = F.filter(F.transform(looked_for, lambda c: F.struct(c["width"].alias("width"), c["stride"].alias("stride"), c["class"].alias("class"), F.array_intersect("hashes", c["known"]).alias("met"))), lambda c: F.size(c["met"]) > 0)

    def of_class(c):
        at = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains(c["met"], h), i)), lambda i: i.isNotNull())
        # numbers of the windows that hold the shingle at word p
        around = F.transform(at, lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p + SHINGLE - c["width"]) / c["stride"]).cast("int")), F.floor(p / c["stride"]).cast("int")))
        return F.transform(F.array_distinct(F.flatten(around)), lambda k: F.struct(c["class"].alias("class"), (k * c["stride"]).alias("at"), c["width"].alias("width")))

    windows = hashed.select("id", "_h", "n", "hashes", F.explode(F.flatten(F.transform(shared, of_class))).alias("w"))
    windows = windows.select("id", "_h", "w.class", F.col("w.at").alias("first_word"), F.least(F.col("w.width"), F.col("n") - F.col("w.at")).alias("n_words"), F.array_distinct(F.slice("hashes", F.col("w.at") + 1, F.col("w.width") - (SHINGLE - 1))).alias("own"))
    windows = windows.withColumn("low", smallest(F.col("own"))).withColumn("own_bands", bands(F.col("low"), F.col("class"))).drop("low")
    # outer, though the arrays are never empty: else a check of their size is pushed below and makes them anew
    probe = windows.select("*", F.posexplode_outer("own_bands").alias("b", "band"))
    keys = lib.select("template", "shingles", F.col("bands"), F.explode_outer("bands").alias("band"))
    met = probe.join(F.broadcast(keys), "band")
    # a window that meets a template in several bands is verified in the first
    first = F.array_position(F.zip_with("own_bands", "bands", lambda x, y: x == y), True) - 1
    overlap = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    verified = met.where(F.col("b") == first).withColumn("containment", overlap).where(F.col("containment") >= similarity)
    best = F.max_by(F.struct("first_word", "n_words", "containment"), F.struct("containment", -F.col("first_word")))
    found = verified.groupBy("id", "_h", "template").agg(best.alias("m"))
    return found.select("id", "template", "m.containment", "m.first_word", "m.n_words")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document; see ``scan`` for nulls and repeats. A row without an id is reported with a null id."""
    return scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
