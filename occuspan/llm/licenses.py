"""License scans: MinHash bands over overlapping windows retrieve templates, shingles verify them.

Words are runs of letters and digits, lowered; shingles are runs of five. Texts are
reduced to the shingles that any template has, with their places. Windows of three
lengths, each overlapping the next by half, hold what is left; a template belongs to
the shortest windows that hold it whole. A window's signature has one minimum per
band. As only template shingles count, a window with a template and little else of
the kind is nearly equal to it: at a similarity of 0.1 the chance that one of the 64
bands agrees is 1 - 0.9 ** 64 = 99.9 %, and it grows with similarity. Retrieved
templates are verified by the exact share of their shingles in the window.

All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occuspan.llm.common import shared_folder, stage

SHINGLE = 5
CONTAINED = 0.8
BANDS = 64
STRIDES = (16, 64, 256)
# Longer templates are cut into pieces, so that a piece with a quarter of other words still fits a stride.
PIECE_WORDS = 200
# Up to so many template shingles go to every task; more are joined by shuffle.
BROADCAST_SHINGLES = 1 << 18

# Notices and opening paragraphs of common licenses.
TEMPLATES = (
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(words: Column) -> Column:
    """Hashes of all runs of five words, in order; of fewer words, none."""
    last = F.size(words) - SHINGLE
    run = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, run).otherwise(F.array().cast("array<bigint>"))


def lowest(hashes: Column, band: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))


def bands(hashes: Column) -> Column:
    return F.array(*(lowest(hashes, b) for b in range(BANDS)))


def template_pieces(templates: DataFrame) -> DataFrame:
    """license, template, piece, stride, hashes (distinct), n: templates of five words or more, cut where they are long."""
    cut = templates.select("license", "text").distinct().withColumn("template", F.xxhash64("license", "text")).withColumn("w", words(F.col("text")))
    # Pieces overlap by four words, so that no shingle is lost between them.
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - SHINGLE, F.lit(0)), F.lit(PIECE_WORDS - SHINGLE + 1))
    cut = cut.filter(F.size("w") >= SHINGLE).select("license", "template", "w", F.posexplode(starts).alias("piece", "start"))
    cut = cut.withColumn("w", F.slice("w", F.col("start") + 1, F.lit(PIECE_WORDS))).withColumn("length", F.size("w"))
    cut = cut.withColumn("hashes", F.array_distinct(shingles(F.col("w")))).filter(F.size("hashes") > 0)
    stride = F.lit(STRIDES[-1])
    for s in STRIDES[-2::-1]:
        stride = F.when(F.col("length") * 1.25 <= s, s).otherwise(stride)
    return cut.select("license", "template", "piece", stride.alias("stride"), "hashes", F.size("hashes").alias("n"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, license, containment, first_word, n_found, n_shingles: one row for each document row and license found.

    containment is the share of the template's distinct shingles found, taken from
    the best window of each of its pieces; of several templates of a license the best
    counts, and on a tie the one seen first. first_word is where its first window's
    first shingle starts. Null, empty and short texts hold no shingle and give no row;
    templates of fewer than five words are passed over. Repeated rows are found alike.
    Other columns are not read. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    pieces = stage(template_pieces(default_templates(spark) if templates is None else templates), folder, "templates")
    wanted = pieces.select("stride", F.explode("hashes").alias("hash")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_SHINGLES else wanted
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
    met = rows.select("row", "doc_id", F.posexplode(shingles(F.col("w"))).alias("at", "hash")).join(wanted, "hash")
    met = stage(met, folder, "met")
    window = F.floor(F.col("at") / F.col("stride"))
    both = F.when(window > 0, F.array(window - 1, window)).otherwise(F.array(window))
    windows = met.select("row", "doc_id", "at", "hash", "stride", F.explode(both).alias("window"))
    windows = windows.groupBy("row", "doc_id", "stride", "window").agg(F.collect_set("hash").alias("held"), F.min("at").alias("first"))
    windows = stage(windows, folder, "windows")
    signed = windows.select("row", "stride", "window", F.posexplode(bands(F.col("held"))).alias("band", "value"))
    known = pieces.select("stride", "template", "piece", F.posexplode(bands(F.col("hashes"))).alias("band", "value"))
    retrieved = signed.join(known, ["stride", "band", "value"]).select("row", "stride", "window", "template", "piece").distinct()
    compared = retrieved.join(windows, ["row", "stride", "window"]).join(pieces, ["stride", "template", "piece"])
    compared = compared.withColumn("found", F.size(F.array_intersect("held", "hashes")))
    best = compared.groupBy("row", "doc_id", "license", "template", "piece").agg(F.max(F.struct("found", -F.col("first"))).alias("best"))
    whole = pieces.groupBy("template").agg(F.sum("n").alias("n_shingles"))
    sums = best.groupBy("row", "doc_id", "license", "template").agg(F.sum("best.found").alias("n_found"), F.min(-F.col("best.col2")).alias("first_word"))
    sums = sums.join(whole, "template").withColumn("containment", F.col("n_found") / F.col("n_shingles")).filter(F.col("containment") >= contained)
    chosen = F.max(F.struct("containment", -F.col("first_word"), "n_found", "n_shingles")).alias("c")
    named = sums.groupBy("row", "doc_id", "license").agg(chosen)
    return named.select(
        "doc_id", "license", "c.containment", (-F.col("c.col2")).cast("long").alias("first_word"), F.col("c.n_found").cast("long").alias("n_found"), F.col("c.n_shingles").cast("long").alias("n_shingles")
    )
