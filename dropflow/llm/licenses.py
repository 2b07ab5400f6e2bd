"""Licence scans: MinHash over overlapping windows, then exact shingle containment.

Texts and templates are lower-case words ``[0-9a-z and non-ASCII]+`` in 5-word
shingles, each a 64-bit hash.

Retrieval. A text is cut into overlapping windows of ``WINDOW`` shingles, a
step of ``STEP`` apart; each window has ``BANDS`` MinHash values, one a band.
Any band that equals a band of some window of a template (at every offset)
retrieves that template. Two windows of similarity s meet in at least one band
with probability 1 - (1 - s)**BANDS, 0.99994 at 0.8 and 0.996 at 0.6, and a
long template has several windows. A template too short to hold a whole window
at any alignment (under ``WINDOW + STEP - 1`` shingles) is retrieved by windows
of one shingle, whose MinHash is the shingle itself: there nothing is missed.

Verification. Only rows with a retrieved template are expanded. A template of
t shingles is found in a text if a stretch of 2t shingles (starting at
multiples of t) holds at least ``CONTAINMENT`` of its distinct shingles,
counted exactly.

Templates are a parameter whose size is checked (``MAX_TEMPLATE_WORDS``); they
are the only thing that is broadcast. DataFrame operations only.

Defined cases: null, empty or short texts (under five words) match nothing;
repeated rows are scanned each; ties give one row for each template found; a
template of under five words is an error; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty

SHINGLE = 5
WINDOW, STEP, BANDS = 8, 4, 6
CONTAINMENT = 0.8
MAX_TEMPLATE_WORDS = 200_000

#: Notices and parts of public licences, as published.
TEMPLATES = (
    ("cc-by-nc-4.0/notice", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0/short-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("apache-2.0/short-notice", "Licensed under the Apache License, Version 2.0."),
    ("mit/short-notice", "Released under the MIT License."),
    ("mit/permission",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("isc/permission",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-2-clause/conditions",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("apache-2.0/header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl-3.0-or-later/header",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl-2.0/header",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def licence_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def shingles(words: Column) -> Column:
    """Hashes of all 5-word shingles, in order."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))),
                       lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE)]))


def band(hashes: Column, k: int, step: int) -> Column:
    """MinHash ``k`` of each stretch of ``step`` shingles."""
    n = F.ceil(F.size(hashes) / step).cast("int")
    panes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return _min_hashes(hashes, panes, k, step, step)


def _min_hashes(hashes: Column, numbers: Column, k: int, step: int, length: int) -> Column:
    """MinHash ``k`` of the stretch of ``length`` shingles from ``number * step`` on, for each number."""
    return F.transform(numbers, lambda j: F.array_min(F.transform(
        F.slice(hashes, j * step + 1, F.lit(length)), lambda x: F.xxhash64(x, F.lit(k)))))


def _windows(panes: Column) -> Column:
    """MinHashes of windows: each is two neighbouring panes."""
    return F.transform(panes, lambda x, j: F.least(x, F.get(panes, j + 1)))


def _template_tables(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> tuple[DataFrame, list, list[list]]:
    """(template shingles, short keys, long keys of each band) of a bounded set of templates."""
    if sum(len(text.split()) for _, text in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold over {MAX_TEMPLATE_WORDS} words; scan them in several calls")
    table = (spark.createDataFrame(list(templates), "template string, text string")
             .withColumn("words", licence_words(F.col("text"))).withColumn("h", shingles(F.col("words"))))
    offsets = F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0)))
    for k in range(BANDS):  # every offset of a template, as texts are cut at any place
        table = table.withColumn(f"band{k}", _min_hashes(F.col("h"), offsets, k, 1, WINDOW))
    rows = table.collect()
    short, long_, parts = [], [[] for _ in range(BANDS)], []
    for r in rows:
        if not r["h"]:
            raise ValueError(f"template {r['template']} has under {SHINGLE} words")
        distinct = len(set(r["h"]))
        is_short = len(r["h"]) < WINDOW + STEP - 1
        parts += [(r["template"], h, len(r["h"]), distinct) for h in set(r["h"])]
        if is_short:
            short += [(h, r["template"]) for h in set(r["h"])]
        else:
            for k in range(BANDS):
                long_[k] += [(m, r["template"]) for m in set(r[f"band{k}"])]
    return spark.createDataFrame(parts, "template string, h long, size int, distinct_size int"), short, long_


def _longs(values) -> Column:
    values = sorted(set(values))
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<bigint>")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
         containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, template, containment (best stretch), first_word and last_word (its first and last matched words).

    One row for each document row and template that is found.
    """
    spark = docs.sparkSession
    parts, short, long_ = _template_tables(spark, templates)
    d = docs.select("doc_id", licence_words(text_or_empty()).alias("words"))
    d = d.select("doc_id", shingles(F.col("words")).alias("h"))
    panes = {f"p{k}": band(F.col("h"), k, STEP) for k in range(BANDS) if long_[k]}
    d = d.withColumns(panes) if panes else d
    d = d.withColumns({f"b{p[1:]}": _windows(F.col(p)) for p in panes}).drop(*panes) if panes else d
    wanted = F.arrays_overlap("h", _longs(h for h, _ in short)) if short else F.lit(False)
    for p in panes:
        k = int(p[1:])
        wanted = wanted | F.arrays_overlap(f"b{k}", _longs(m for m, _ in long_[k]))
    # a generator, as a filter would be pushed below the projections and repeat them inside each other
    retrieved = checkpoint(d.withColumn("hit", F.explode(F.when(wanted, F.array(F.lit(True)))))
                           .withColumn("rid", F.monotonically_increasing_id()))
    keys = [(-1, h, t) for h, t in short] + [(k, m, t) for k in range(BANDS) for m, t in long_[k]]
    template_keys = F.broadcast(spark.createDataFrame(keys, "band int, key long, template string"))
    bands = F.explode(F.array(F.struct(F.lit(-1).alias("band"), F.col("h").alias("keys")),
                              *[F.struct(F.lit(int(p[1:])).alias("band"), F.col(f"b{p[1:]}").alias("keys")) for p in panes]))
    pairs = (retrieved.select("rid", bands.alias("b")).select("rid", "b.band", F.explode("b.keys").alias("key"))
             .join(template_keys, ["band", "key"]).select("rid", "template").distinct())
    # exact verification of the retrieved templates
    at = (retrieved.select("rid", "doc_id", F.posexplode("h").alias("pos", "h"))
          .join(F.broadcast(parts), "h").join(pairs, ["rid", "template"], "left_semi")
          .withColumn("stretch", F.explode(F.array(F.floor(F.col("pos") / F.col("size")),
                                                   F.floor(F.col("pos") / F.col("size")) - 1)))
          .filter("stretch >= 0"))
    counted = at.groupBy("rid", "doc_id", "template", "distinct_size", "stretch").agg(
        F.countDistinct("h").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    found = counted.withColumn("containment", F.col("n") / F.col("distinct_size")).filter(F.col("containment") >= containment)
    best = F.min(F.struct((-F.col("containment")).alias("less"), "first", "last"))
    return (found.groupBy("rid", "doc_id", "template").agg(best.alias("best"))
            .select("doc_id", "template", (-F.col("best.less")).alias("containment"),
                    F.col("best.first").cast("long").alias("first_word"),
                    (F.col("best.last") + SHINGLE - 1).cast("long").alias("last_word")))
