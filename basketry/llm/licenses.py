"""Licence scans by a trained paragraph classifier.

Units are the lines of a text and, for notices that are wrapped over several lines,
the lines with the REACH words before and after them, over however many lines these
are spread; lines without a word do not count. No template has more than REACH words,
so a unit around any line of a notice holds the whole notice.
A multinomial logistic regression over sparse word n-grams (1 to 3 words), made
sparse by an elastic net, names the licence family or `unknown`. It is trained
here, on notices (TEMPLATES), their variants with words left out, and negatives:
notices with their words shuffled and at most NEGATIVES lines of the corpus. Notices
and shuffled ones are also shown between words of such lines.
Probabilities are calibrated by a temperature fitted on variants that training did
not see. A prediction counts if its probability is at least CERTAIN and the unit
holds at least CONFIRMED of the word triples of a template of that family; else the
unit is `unknown`.

Only units that can be confirmed or read like a notice need the classifier: a unit with
CONFIRMED of a template's triples has one of the ANCHOR words, which are chosen
so that too few triples of any template are without one. The test for them is a plain
substring search over all texts, and then one for whole words in the lines that it finds.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

NEGATIVES, VARIANTS, CERTAIN, CONFIRMED, REACH = 2000, 12, 0.5, 0.6, 40
UNKNOWN = "unknown"
# Notices by family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.", "This project is licensed under the terms of the Apache License, Version 2.0."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This software is released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License version 2.", "Released under the GPLv2 license.", "SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License version 3.", "Released under the GPLv3 license.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License version 2.1.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Copyright. All rights reserved.", "This content may not be reproduced without written permission."],
}
#: Words too common in any text to be anchors.
COMMON = set("the of a an is and or to in for with without this that you may not any are be by on at as it from under all use work file file terms 2.0 3.0 4.0 1.0 2 3 by form forms copy person v sa nc".split())


def _words(text: str) -> list[str]:
    import re

    return [w for w in (x.strip(".") for x in re.split(r"[^a-z0-9.]+", text.lower())) if w]


def _triples(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def anchors() -> list[str]:
    """Words of which every unit has one that holds CONFIRMED of a template's triples: the most useful first, until no template is short of them."""
    open_ = [[t.split() for t in _triples(_words(x))] for texts in TEMPLATES.values() for x in texts]
    need = [(1 - CONFIRMED) * len(t) for t in open_]
    chosen: list[str] = []
    while True:
        short = [[t for t in triples if not set(t) & set(chosen)] for triples in open_]
        left = [t for t, n in zip(short, need, strict=True) if len(t) > n or len(t) == n and n == 0]
        if not left:
            return chosen
        gain: dict[str, int] = {}
        for triples in left:
            for w in {w for t in triples for w in t}:
                gain[w] = gain.get(w, 0) + sum(w in t for t in triples)
        better = {w: g for w, g in gain.items() if w not in COMMON} or gain
        chosen.append(max(sorted(better), key=better.get))


def words_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(text), r"[^a-z0-9.]+"), lambda w: F.trim(w, F.lit("."))), lambda w: w != "")


def n_grams(words: Column, longest: int = 3) -> Column:
    """All runs of one to `longest` words."""
    out = words
    for n in range(2, longest + 1):
        runs = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i, n=n: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))
        out = F.concat(out, runs)
    return out


def has_anchor(text: Column) -> Column:
    low, chosen = F.lower(text), anchors()
    short = [a for a in chosen if len(a) < 4]  # whole words, as they are parts of many others
    found = low.rlike(f"(?<![a-z0-9])(?:{'|'.join(short)})(?![a-z0-9])") if short else F.lit(False)
    for a in chosen:
        if a not in short:
            found = found | low.contains(a)
    return F.coalesce(found, F.lit(False))


def nearest(lines: Column, before: bool) -> Column:
    """The texts and words of `lines`, given nearest first, up to the line that makes them REACH words, in the order of the text."""
    none = F.array().cast("array<string>")
    join = (lambda old, new: F.concat(new, old)) if before else F.concat
    more = lambda got, line: F.struct(join(got["texts"], F.array(line)).alias("texts"), join(got["words"], words_of(line)).alias("words"))
    return F.aggregate(lines, F.struct(none.alias("texts"), none.alias("words")), lambda got, line: F.when(F.size(got["words"]) >= REACH, got).otherwise(more(got, line)))


class Model:
    def __init__(self, vocabulary: CountVectorizerModel, regression: LogisticRegressionModel, temperature: float):
        self.vocabulary, self.regression, self.temperature = vocabulary, regression, temperature
        self.families = [*sorted(TEMPLATES), UNKNOWN]

    def predict(self, units: DataFrame) -> DataFrame:
        """units with family and probability; column `grams` is used up."""
        raw = self.regression.transform(self.vocabulary.transform(units)).withColumn("_raw", vector_to_array("rawPrediction"))
        scaled = F.transform("_raw", lambda x: F.exp((x - F.array_max("_raw")) / F.lit(self.temperature)))
        p = raw.withColumn("_p", scaled).withColumn("_p", F.transform("_p", lambda x: x / F.aggregate("_p", F.lit(0.0), lambda a, y: a + y)))
        best = F.array_position("_p", F.array_max("_p"))
        named = F.element_at(F.array(*map(F.lit, self.families)), best.cast("int"))
        return p.select(*[c for c in units.columns if c != "grams"], named.alias("family"), F.array_max("_p").alias("probability"), "_p")


def _amid(examples: DataFrame, lines: DataFrame, places: int = 64) -> DataFrame:
    """examples between words of corpus lines, up to REACH on either side, as they stand in the middle of a text; without lines as they are."""
    at = lambda side: F.pmod(F.xxhash64("label", "words", F.lit(side)), F.lit(places))
    context = lines.groupBy(F.pmod(F.xxhash64("words"), F.lit(places)).alias("place")).agg(F.min("words").alias("context"))
    out = examples.select("*", *[at(side).alias(side) for side in ("ahead", "behind")])
    for side in ("ahead", "behind"):
        few = (F.pmod(F.xxhash64("words", F.lit(f"{side} words")), F.lit(REACH + 1))).cast("int")
        near = context.select(F.col("place").alias(side), F.col("context").alias(f"{side}_words"))
        out = out.join(F.broadcast(near), side, "left").withColumn(f"{side}_words", F.slice(F.coalesce(f"{side}_words", F.array().cast("array<string>")), 1, few))  # at most `places` rows
    return out.select("label", F.concat("ahead_words", "words", "behind_words").alias("words"), "held")


def train(docs: DataFrame) -> Model:
    """Fit on templates, their variants and at most NEGATIVES corpus lines, those of the documents whose ids have the lowest hashes."""
    spark = docs.sparkSession
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows = [(families.index(f), f"{f} {i}", t) for f, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    known = spark.createDataFrame(rows, "label int, name string, text string").withColumn("words", words_of(F.col("text")))
    variants = known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))))
    dice = lambda i, *more: F.pmod(F.xxhash64("name", "v", i, *more), F.lit(100))
    kept = F.filter("words", lambda w, i: (F.col("v") == 0) | (dice(i) >= F.pmod(F.col("v"), F.lit(5)) * 5))
    positives = variants.select(F.col("label").cast("double").alias("label"), kept.alias("words"), (F.pmod(F.col("v"), F.lit(4)) == 3).alias("held"))
    shuffled = F.transform(F.array_sort(F.transform("words", lambda w, i: F.struct(dice(i, F.lit("order")).alias("o"), i.alias("i"), w.alias("w")))), lambda x: x["w"])
    unknown = float(families.index(UNKNOWN))
    mixed = variants.where("v < 3").select(F.lit(unknown).alias("label"), F.slice(shuffled, 1, F.greatest(F.lit(2), F.size("words") - 1)).alias("words"), (F.col("v") == 2).alias("held"))
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(NEGATIVES // 8)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")  # NEGATIVES // 8 ids
    lines = some.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(~has_anchor(F.col("line")))
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(NEGATIVES).select(F.lit(unknown).alias("label"), F.slice(words_of(F.col("line")), 1, 60).alias("words"), (F.pmod(F.xxhash64("line"), F.lit(4)) == 3).alias("held"))
    every = positives.union(mixed)
    every = every.union(_amid(every, lines)).union(lines).select("label", "held", n_grams(F.col("words")).alias("grams")).coalesce(2).cache()
    fit_on = every.where("not held")
    # only what notices say is a feature, so the words around a notice are no evidence against it
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=1 << 14).fit(positives.where("not held").select(n_grams(F.col("words")).alias("grams")))
    regression = LogisticRegression(family="multinomial", maxIter=40, regParam=0.002, elasticNetParam=0.3).fit(vocabulary.transform(fit_on))
    raw = regression.transform(vocabulary.transform(every.where("held"))).select("label", vector_to_array("rawPrediction").alias("r"))
    grid = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0]

    def loss(t: float) -> Column:
        top = F.array_max("r")
        norm = F.log(F.aggregate(F.transform("r", lambda x: F.exp((x - top) / t)), F.lit(0.0), lambda a, x: a + x))
        return F.avg(norm - (F.element_at("r", (F.col("label") + 1).cast("int")) - top) / t)

    losses = raw.agg(*[loss(t).alias(str(i)) for i, t in enumerate(grid)]).first()
    every.unpersist()
    best = min(range(len(grid)), key=lambda i: losses[i] if losses[i] is not None and not math.isnan(losses[i]) else math.inf)
    return Model(vocabulary, regression, grid[best])


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Each unit that the classifier gives a licence family: doc_id, line, wrapped, family, predicted, probability, similarity, confirmed and unit.

    family is `unknown` where the prediction is not certain or not confirmed. A
    wrapped unit is returned where its line alone is not confirmed.
    Null and empty texts have no units. Rows with a null or repeated doc_id, and
    repeated rows, are each scanned. A unit that repeats in a text is returned at
    each place. Other columns are ignored. An empty table gives no rows.
    """
    model = model or train(docs)
    spark = docs.sparkSession
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text")))
    with_words = F.filter(numbered, lambda x: F.lower(x["text"]).rlike("[a-z0-9]"))
    hit = docs.select("doc_id", "text").where(has_anchor(F.col("text"))).select("doc_id", with_words.alias("lines"))
    is_marked = lambda x: has_anchor(x) & F.arrays_overlap(words_of(x), F.array(*map(F.lit, anchors())))
    marked = F.filter(F.transform("lines", lambda x, i: F.when(is_marked(x["text"]), i)), lambda i: i.isNotNull())
    ahead = lambda i: nearest(F.reverse(F.slice("lines", F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)))["text"]), True)
    behind = lambda i: nearest(F.slice("lines", i + 2, REACH)["text"], False)
    place = lambda i: F.struct(F.col("lines")[i]["line"].alias("line"), F.col("lines")[i]["text"].alias("unit"), ahead(i).alias("before"), behind(i).alias("after"))
    found = hit.select("doc_id", F.explode(F.transform(marked, place)).alias("x")).select("doc_id", "x.*").withColumn("words", words_of(F.col("unit")))
    found = written(found.withColumn("at", F.monotonically_increasing_id()), "units")
    start = F.greatest(F.size("before.words") - REACH, F.lit(0)) + 1
    wide = F.concat(F.slice("before.words", start, F.lit(REACH)), F.col("words"), F.slice("after.words", 1, REACH))
    single = found.select("at", "doc_id", "line", F.lit(False).alias("wrapped"), "unit", "words")
    several = found.where((F.size("before.words") > 0) | (F.size("after.words") > 0)).select("at", "doc_id", "line", F.lit(True).alias("wrapped"), F.concat_ws("\n", "before.texts", "unit", "after.texts").alias("unit"), wide.alias("words"))
    units = single.union(several).withColumn("grams", n_grams(F.col("words")))
    predicted = model.predict(units)
    by_family = spark.createDataFrame([(f, [_triples(_words(t)) for t in texts]) for f, texts in TEMPLATES.items()], "family string, templates array<array<string>>")
    joined = predicted.join(F.broadcast(by_family), "family", "left")
    few = F.array(F.array_join("words", " "))
    triples = F.when(F.size("words") < 3, few).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 2, F.lit(1))), lambda i: F.array_join(F.slice("words", i, 3), " ")))
    joined = joined.withColumn("_triples", triples)
    similarity = F.coalesce(F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("_triples"))) / F.size(t))), F.lit(0.0))
    judged = joined.withColumn("similarity", similarity)
    confirmed = (F.col("probability") >= CERTAIN) & (F.col("similarity") >= CONFIRMED) & (F.col("family") != UNKNOWN)
    judged = judged.withColumn("confirmed", confirmed)
    alone = F.max(~F.col("wrapped") & F.col("confirmed")).over(Window.partitionBy("at"))
    judged = judged.withColumn("_alone", alone).where(~F.col("wrapped") | ~F.col("_alone")).where(F.col("family") != UNKNOWN)
    return judged.select("doc_id", "line", "wrapped", F.when(F.col("confirmed"), F.col("family")).otherwise(UNKNOWN).alias("family"), F.col("family").alias("predicted"), "probability", "similarity", "confirmed", "unit")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
