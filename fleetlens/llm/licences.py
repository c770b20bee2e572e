"""Licence scan: which paragraphs state a licence, and of which family.

A notice may stand on one line or be wrapped over several, so both are judged: lines that aren't blank, and windows of ``WINDOW``
words over blocks (runs of lines that hold letters or digits; comment marks are no words). Windows start every ``STRIDE`` words and
overlap by more words than any template has. What a block's windows find counts once for the block, unless one of its lines states
that family already. Lines and windows become sparse counts of hashed words and word pairs; a multinomial logistic regression,
trained here, gives the probabilities of the licence families and of ``unknown``. It learns from notices that are composed of the
families' names and common phrases, from the families' own texts, and from at most ``UNKNOWN_ROWS`` paragraphs of the corpus that look
like no template, taken by the smallest hashes of their texts. A temperature, fitted on a held-out third, calibrates the
probabilities. The likeliest family counts if it has at least ``SURE`` probability and a template of that family confirms it: at
least ``CONFIRMED`` of the template's word pairs stand in the line or window. Any other family counts beside it if it is at least
``SURE`` against ``unknown`` alone and one of its templates stands whole (names of different families share most of their pairs);
a name of one word ("mit" is a German word as well) then has to stand beside a word of ``BEFORE``, ``AFTER`` or another's name.

All of it is DataFrame expressions and feature stages of Spark ML. Defined results: null and empty texts have no paragraph and no
licence; equal paragraphs get equal results; rows that share a key are one document; a null key is a key like any other; paragraphs
of any length are read whole; an empty corpus gives no rows (the model then knows nothing of unknown paragraphs, which templates
still have to confirm).
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import product

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import keyed_text
from fleetlens.session import materialize

UNKNOWN, UNKNOWN_ROWS, FEATURES, SURE, CONFIRMED = "unknown", 3000, 1 << 14, 0.5, 0.6
WINDOW, STRIDE = 60, 24
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0]

# Names and usual notices of public licences.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License", "GNU GPL v3", "GNU General Public License version 2", "GPL-3.0"],
    "LGPL": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "LGPL-2.1"],
    "AGPL": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "AGPL-3.0"],
    "BSD": ["BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD License"],
    "MPL": ["Mozilla Public License, version 2.0", "Mozilla Public License", "MPL 2.0"],
    "ISC": ["ISC License"],
    "EPL": ["Eclipse Public License 2.0", "Eclipse Public License"],
    "Unlicense": ["Unlicense"],
    "CC0": ["CC0 1.0 Universal", "CC0", "Creative Commons Zero"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"],
}
PHRASES = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.",
           "This software is released under the terms of the {}.", "This project is licensed under the {} - see the LICENSE file.", "SPDX-License-Identifier: {}", "Available under the {}.",
           "The source code is made available under the {}.", "License: {}"]
TEXTS = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "CC0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide"],
}
FAMILIES = [*NAMES, UNKNOWN]
# Words that tie a name of one word to a notice that states another family as well.
BEFORE, AFTER = ["or", "and", "the", "under", "identifier", "either"], ["or", "and", "license", "licence", "licenses", "licences"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs_of(words: Column) -> Column:
    """Neighbouring words, with marks at both ends so that a single word has pairs as well."""
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.concat(F.array(F.lit("<")), words), F.concat(words, F.array(F.lit(">"))), lambda a, b: F.concat_ws(" ", a, b)))


def inner_pairs(words: Column) -> Column:
    """Neighbouring words without the ends, as a template is looked up inside a paragraph."""
    return F.when(F.size(words) < 2, words).otherwise(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def templates(spark: SparkSession) -> DataFrame:
    """(family, pairs): a constant table of name and text templates."""
    rows = [(f, n) for f, names in NAMES.items() for n in names] + [(f, t) for f, texts in TEXTS.items() for t in texts]
    return spark.createDataFrame(rows, "family string, template string").select("family", F.array_distinct(inner_pairs(words_of(F.col("template")))).alias("pairs"))


def beside(family: str) -> list[list[str]]:
    """Pairs, each of which is a template, for one-word names of a family that isn't the likeliest."""
    firsts = sorted({n.split()[0].split("-")[0].lower() for f, names in NAMES.items() if f != family for n in names})
    words = [n.lower() for n in NAMES[family] if n.isalnum()]
    return [[f"{b} {w}"] for w in words for b in BEFORE] + [[f"{w} {a}"] for w in words for a in [*AFTER, *firsts]]


def plain(template: str) -> list[str]:
    """The words of a template; templates are plain ASCII."""
    return re.findall("[a-z0-9]+", template.lower())


def hint_words() -> list[str]:
    """Words of which a paragraph has at least one if any template can confirm it.

    A template is confirmed by ``CONFIRMED`` of its pairs, so words are taken from it, longest first, until the pairs without one of
    them are too few. Pairs that stand beside a one-word name hold the name itself.
    """
    hints: set[str] = set()
    for template in sorted(t for texts in (*NAMES.values(), *TEXTS.values()) for t in texts):
        words = plain(template)
        pairs = set(zip(words, words[1:], strict=False)) or {(words[0],)}
        while len(left := [p for p in pairs if hints.isdisjoint(p)]) >= CONFIRMED * len(pairs):
            hints.add(max((w for p in left for w in p), key=lambda w: (len(w), w)))
    return sorted(hints)


def worth_judging(words: Column) -> Column:
    """Whether a template can be confirmed by these words; all others are left out before they are counted and scored."""
    return F.arrays_overlap(words, F.lit(hint_words()))


def features(df: DataFrame, text: str) -> DataFrame:
    """Adds ``words`` and the sparse counts ``features``."""
    return counted(df.withColumn("words", words_of(F.col(text))))


def counted(df: DataFrame) -> DataFrame:
    """Adds the sparse counts ``features`` of ``words``."""
    terms = df.withColumn("terms", F.concat("words", pairs_of(F.col("words"))))
    return HashingTF(numFeatures=FEATURES, inputCol="terms", outputCol="features", binary=True).transform(terms).drop("terms")


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("paragraph", "line"))
    return rows.where(F.trim("line") != "")


def units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, said, block, line, words) of lines, and of windows over blocks (line is null), that a template may confirm; ``said`` tells
    texts of one key apart."""
    blocks = docs.select(key, F.xxhash64(text).alias("said"), F.posexplode(F.split(text, r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*")).alias("block", "body"))
    lines = blocks.select(key, "said", "block", F.posexplode(F.split("body", "\n")).alias("line", "text")).where(F.trim("text") != "").withColumn("words", words_of(F.col("text"))).drop("text").where(worth_judging(F.col("words")))
    joined = blocks.withColumn("words", words_of(F.regexp_replace("body", r"(?mi)^\s*(rem|dnl)\b", " "))).where((F.contains("body", F.lit("\n")) | (F.size("words") > WINDOW)) & worth_judging(F.col("words")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - (WINDOW - STRIDE) - 1), F.lit(STRIDE))
    wide = joined.withColumn("start", F.explode(starts)).select(key, "said", "block", F.lit(None).cast("int").alias("line"), F.slice("words", F.col("start") + 1, F.lit(WINDOW)).alias("words"))
    return lines.unionByName(wide.where(worth_judging(F.col("words"))))


def template_share(told: Column, pairs: Column) -> Column:
    """The share of a template's pairs (or of its one word) that stand among a paragraph's words and pairs."""
    return F.size(F.array_intersect(pairs, told)) / F.size(pairs)


def notices() -> list[tuple[str, str]]:
    """Training notices: each name in each phrase, and the families' texts."""
    made = [(f, p.format(n)) for f, names in NAMES.items() for n, p in product(names, PHRASES)]
    return made + [(f, n) for f, names in NAMES.items() for n in names] + [(f, t) for f, texts in TEXTS.items() for t in texts]


def training_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(line, label, weight, fold): notices, and a bounded sample of paragraphs that no template is found in."""
    spark = docs.sparkSession
    told = spark.createDataFrame([(t, float(FAMILIES.index(f))) for f, t in notices()], "line string, label double")
    hashed = paragraphs(docs, key, text).select("line", F.xxhash64("line").alias("hash"))
    least = hashed.select("hash").distinct().orderBy("hash").limit(UNKNOWN_ROWS)  # hashes alone are shuffled
    sample = hashed.join(F.broadcast(least), "hash", "left_semi").select("line").distinct().withColumn("words", words_of(F.col("line")))
    sample = sample.select("line", F.concat("words", inner_pairs(F.col("words"))).alias("told"))  # once a line, before it meets the templates
    looks = sample.crossJoin(F.broadcast(templates(spark))).groupBy("line").agg(F.max(template_share(F.col("told"), F.col("pairs"))).alias("share"))  # bounded sample, constant table
    rows = told.unionByName(looks.where(f"share < {CONFIRMED}").select("line", F.lit(float(FAMILIES.index(UNKNOWN))).alias("label")))
    return rows.withColumn("fold", F.pmod(F.xxhash64("line"), F.lit(3)))


class LicenceModel:
    """The fitted regression and its temperature."""

    def __init__(self, model: LogisticRegressionModel, temperature: float) -> None:
        self.model, self.temperature = model, temperature

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Adds calibrated ``probabilities`` in order of ``FAMILIES``."""
        scored = self.model.transform(df).withColumn("raw", vector_to_array("rawPrediction"))
        return calibrated(scored, self.temperature).drop("raw", "rawPrediction", "probability", "prediction")


def calibrated(df: DataFrame, temperature: float) -> DataFrame:
    power = F.transform("raw", lambda r: F.exp((r - F.array_max("raw")) / temperature))
    return df.withColumn("_power", power).withColumn("probabilities", F.transform("_power", lambda p: p / F.aggregate("_power", F.lit(0.0), lambda a, b: a + b))).drop("_power")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> LicenceModel:
    rows = materialize(features(training_rows(docs, key, text), "line").select("features", "label", "fold").coalesce(4), "licence-training")
    regression = LogisticRegression(maxIter=25, regParam=1e-3, family="multinomial", standardization=False)
    every = rows.agg(F.max("label")).first()[0]
    if every < FAMILIES.index(UNKNOWN):  # no paragraph to learn unknown from: one blank row keeps the class
        rows = rows.unionByName(features(docs.sparkSession.createDataFrame([("",)], "line string"), "line").select("features", F.lit(float(FAMILIES.index(UNKNOWN))).alias("label"), F.lit(1).cast("long").alias("fold")))
    held = regression.fit(rows.where("fold != 0")).transform(rows.where("fold = 0")).select("label", vector_to_array("rawPrediction").alias("raw"))
    held = materialize(held, "licence-held-out")
    own = F.element_at("probabilities", F.col("label").cast("int") + 1)
    losses = [calibrated(held, t).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-12)))).alias("loss")).withColumn("t", F.lit(t)) for t in TEMPERATURES]
    best = reduce(DataFrame.unionByName, losses).orderBy(F.asc_nulls_last("loss"), "t").first()["t"]
    return LicenceModel(regression.fit(rows), best)


def scan(df: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, block, line, family, probability, similarity): confirmed licences of lines, and of blocks beyond their lines (line is null).
    The probability is the family's against unknown alone."""
    spark, docs = df.sparkSession, keyed_text(df, key, text)
    scored = model.probabilities(counted(units(docs, key, text))).select(key, "said", "block", "line", "words", "probabilities")
    own, unknown = F.col("f.own"), F.element_at("probabilities", len(FAMILIES))
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.element_at("probabilities", i + 1).alias("own")) for i, f in enumerate(FAMILIES[:-1])])
    sure = F.filter(each, lambda f: f["own"] >= SURE * (f["own"] + unknown))
    most = F.array_max("probabilities")
    likely = scored.withColumn("f", F.explode(sure)).select(key, "said", "block", "line", "words", F.col("f.family").alias("family"), (own / (own + unknown)).alias("probability"), ((own == most) & (own >= SURE)).alias("first"))
    kept = templates(spark).groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    likely = likely.withColumn("told", F.concat("words", inner_pairs(F.col("words"))))
    shared = likely.join(F.broadcast(kept), "family")  # a constant table
    tied = spark.createDataFrame([(f, beside(f)) for f in NAMES], "family string, tied array<array<string>>")
    shared = shared.join(F.broadcast(tied), "family")  # a constant table
    fitting = F.when(F.col("first"), F.col("templates")).otherwise(F.concat(F.filter("templates", lambda t: (F.size(t) > 1) | F.contains(t[0], F.lit(" "))), F.col("tied")))
    similarity = F.array_max(F.transform(fitting, lambda t: template_share(F.col("told"), t)))
    confirmed = shared.withColumn("similarity", similarity).where(F.col("similarity") >= F.when(F.col("first"), CONFIRMED).otherwise(1.0))
    found = confirmed.groupBy(key, "said", "block", "family").agg(
        F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line", "probability", "similarity"))).alias("lines"), F.max(F.struct(F.lit(None).cast("int").alias("line"), "probability", "similarity")).alias("whole"))
    hits = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array("whole"))
    return found.select(key, "block", "family", F.explode(hits).alias("hit")).select(key, "block", "hit.line", "family", "hit.probability", "hit.similarity")


def documents_with_licences(df: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_paragraphs, n_licences, families, probability): every document once, with the families it states in alphabetical order."""
    docs = keyed_text(df, key, text)
    counts = docs.groupBy(key).agg(F.sum(F.size(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""))).alias("n_paragraphs"))
    found = scan(df, model, key, text).groupBy(key).agg(F.count("*").alias("n_licences"), F.array_sort(F.collect_set("family")).alias("families"), F.max("probability").alias("probability"))
    found = found.withColumnRenamed(key, "_key")
    return counts.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n_paragraphs", F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability")
