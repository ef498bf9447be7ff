"""Licence statements in texts by a trained paragraph classifier, with DataFrame and SQL functions only.

A sparse multinomial logistic regression over word n-grams (one to three words, not all of them stop words) tells licence
families, other licence statements and ordinary paragraphs apart. It is fitted by Spark's own estimator on statements of
the families, thinned out at random, on fragments of them too small to say anything, and on a bounded sample of the
corpus's own paragraphs. A part of the thinned statements is held back to calibrate the least share of probability a
family needs: below it, or if the family's templates don't confirm the prediction, a licence statement counts as unknown.

Scoring needs no shuffle: paragraphs without any word of a feature that speaks for a licence can't exceed the bias, so one
regular expression leaves them out without changing the result, and the rest look their n-grams up in a literal map.

Defined results: a paragraph is the text between line breaks; null, empty and other texts without licence statements have
no row; repeated rows repeat their findings; places are in code points. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NONE, OTHER, UNKNOWN = "none", "other", "unknown"

#: Short statements by which licences are given.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Distributed under the MIT License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU GPL v3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU General Public License Version 3, 29 June 2007",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution NonCommercial 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
#: Licence statements of no listed family.
OTHERS = (
    "Licensed under the terms of the agreement with the publisher.",
    "This work is distributed under its own license, see the terms of use.",
    "Subject to the license terms of the vendor.",
    "Released under a custom license.",
    "Distributed under the Mozilla Public License, version 2.0.",
    "Licensed under the Eclipse Public License 2.0.",
    "Use is governed by the end user license agreement.",
    "Licensed under the Open Data Commons license.",
)
STOP_WORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "but", "by", "can", "for", "from", "has", "have", "in", "is", "it",
    "its", "may", "no", "not", "of", "on", "or", "the", "this", "that", "to", "under", "we", "with", "without", "you",
    "your", "see", "all", "part", "person", "either", "following", "own", "work", "use", "file", "source", "terms",
)
WORD = "([a-z0-9]+(?:[.-][a-z0-9]+)*)"


@dataclass(frozen=True)
class LicenseConfig:
    """At most ``sample_paragraphs`` paragraphs of the corpus are used as ordinary ones, each with ``variants`` thinned
    copies of every statement beside them. ``precision`` is what the calibrated share must reach on those held back."""

    sample_paragraphs: int = 2000
    variants: int = 24
    features: int = 2048
    penalty: float = 0.002
    precision: float = 0.99
    licence_share: float = 0.5
    template_share: float = 0.6


def _grams(words: Column) -> Column:
    """Distinct n-grams of one to three words that aren't all stop words."""

    def of(n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    stop = "(?:" + "|".join(STOP_WORDS) + ")"
    return F.array_distinct(F.filter(F.concat(of(1), of(2), of(3)), lambda g: ~g.rlike(f"^{stop}(?: {stop})*$")))


def _with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` with ``grams`` in place of ``words``, which must be a column: an expression would be worked out anew for
    every n-gram."""
    return rows.withColumn("grams", _grams(F.col("words"))).drop("words")


def _kept(rows: DataFrame, keep: Column) -> DataFrame:
    """The rows for which ``keep`` holds. A filter would be pushed below the columns it reads, and their expressions would
    then be worked out in it once for each place they are mentioned."""
    once = F.when(keep, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("kept", F.explode(once)).drop("kept")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))


def _literal(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, whole (the document's text), paragraph number and text of every paragraph that isn't blank."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("whole"), F.posexplode(F.split("text", "\n", -1)).alias("paragraph", "text"))
    return split.where("trim(text) <> ''")


@dataclass
class LicenseModel:
    classes: list[str]
    weights: dict[str, list[float]]  # n-gram -> weight for each class
    bias: list[float]
    least_share: float  # calibrated

    def gate(self) -> str:
        """A pattern that every paragraph matches that has a feature speaking for a licence statement."""
        none = self.classes.index(NONE)
        stops = set(STOP_WORDS)
        speaking = [g for g, w in self.weights.items() if max(w) > w[none]]
        words = {next(w for w in g.split(" ") if w not in stops) for g in speaking}
        return r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(map(re.escape, words))) + r")(?![a-z0-9])" if words else r"(?!)"


def _scored(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """``rows`` with ``grams`` and, by stages so that nothing is worked out twice, p: the probability of each class."""
    known = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    rows = rows.withColumn("hits", F.filter(F.transform("grams", lambda g: F.try_element_at(known, g)), lambda h: h.isNotNull()))
    bias = F.array(*map(F.lit, model.bias))
    rows = rows.withColumn("z", F.aggregate("hits", bias, lambda total, hit: F.zip_with(total, hit, lambda x, y: x + y)))
    rows = rows.withColumn("top", F.array_max("z"))
    rows = rows.withColumn("e", F.transform("z", lambda x: F.exp(x - F.col("top"))))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda total, x: total + x))
    return rows.withColumn("p", F.transform("e", lambda x: x / F.col("total"))).drop("hits", "z", "top", "e", "total")


def training_rows(docs: DataFrame, config: LicenseConfig) -> DataFrame:
    """(label, grams, held_back) of thinned statements, small fragments and the corpus's own paragraphs."""
    spark = docs.sparkSession
    rows = [{"label": f, "text": t} for f, ts in TEMPLATES.items() for t in ts] + [{"label": OTHER, "text": t} for t in OTHERS]
    statements = _literal(spark, rows, "label:string,text:string").withColumn("words", _words(F.col("text")))
    copies = statements.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(config.variants - 1))))

    def thinned(share: Column) -> Column:
        chance = F.pmod(F.xxhash64(F.col("text"), F.col("copy")), F.lit(1000))
        positions = F.sequence(F.lit(0), F.size("words") - 1)
        kept = F.filter(positions, lambda i: F.pmod(F.xxhash64(F.col("text"), F.col("copy"), i) + chance, F.lit(1000)) < share * 1000)
        return F.transform(kept, lambda i: F.element_at("words", i + 1))

    # the first copy is the statement itself; later ones lose up to a quarter of their words
    def rows_of(label: Column, words: Column, held_back: Column, of: DataFrame) -> DataFrame:
        return of.select(label.alias("label"), words.alias("words"), held_back.alias("held_back"))

    whole = rows_of(F.col("label"), thinned(1 - F.col("copy") / (4.0 * config.variants)), F.col("copy") % 4 == 3, copies)
    crumbs = rows_of(F.lit(NONE), thinned(0.05 + F.col("copy") / (8.0 * config.variants)), F.lit(False), copies)
    own = paragraphs(docs).select("text").where(F.length("text") < 2000)
    own = own.orderBy(F.xxhash64("text"), "text").limit(config.sample_paragraphs).distinct()
    ordinary = _with_grams(rows_of(F.lit(NONE), _words(F.col("text")), F.lit(False), own))
    ordinary = _kept(ordinary, ~_like_a_template(F.col("grams"), 0.5))
    return _with_grams(whole).unionByName(_with_grams(crumbs)).unionByName(ordinary)


def _template_grams() -> dict[str, list[list[str]]]:
    """Distinctive n-grams of the templates of each family."""
    stops = set(STOP_WORDS)
    out: dict[str, list[list[str]]] = {}
    for family, texts in TEMPLATES.items():
        for t in texts:
            words = re.findall(WORD, t.lower())
            grams = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
            out.setdefault(family, []).append(sorted(g for g in grams if not set(g.split(" ")) <= stops))
    return out


def _template_similarity(grams: Column, family: Column) -> Column:
    """Largest share of a template's n-grams, over the templates of the family."""
    known = F.from_json(F.lit(json.dumps(_template_grams())), "map<string,array<array<string>>>")
    shares = F.transform(F.try_element_at(known, family), lambda t: F.size(F.array_intersect(t, grams)) / F.size(t))
    return F.coalesce(F.array_max(shares), F.lit(0.0))


def _like_a_template(grams: Column, least: float) -> Column:
    every = F.lit(json.dumps([t for ts in _template_grams().values() for t in ts]))
    return F.exists(F.from_json(every, "array<array<string>>"), lambda t: F.size(F.array_intersect(t, grams)) >= least * F.size(t))


def train(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> LicenseModel:
    """Fit the classifier and calibrate the least share of a family."""
    classes = [NONE, OTHER, *TEMPLATES]
    numbers = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    rows = training_rows(docs, config).withColumn("y", numbers.cast("double")).coalesce(2).cache()
    fitted = rows.where("not held_back")
    vocabulary = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=config.features, minDF=2.0).fit(fitted.where(F.col("label") != NONE))
    estimator = LogisticRegression(
        featuresCol="x", labelCol="y", family="multinomial", regParam=config.penalty, elasticNetParam=1.0, standardization=False, maxIter=60
    )
    found = estimator.fit(vocabulary.transform(fitted))
    matrix = found.coefficientMatrix.toArray()
    weights = {g: [float(matrix[c, i]) for c in range(len(matrix))] for i, g in enumerate(vocabulary.vocabulary) if matrix[:, i].any()}
    model = LicenseModel(classes[: len(matrix)], weights, [float(b) for b in found.interceptVector], 0.0)
    model.least_share = _calibrated(rows.where("held_back"), model, config)
    rows.unpersist()
    return model


def _calibrated(rows: DataFrame, model: LicenseModel, config: LicenseConfig) -> float:
    """Least share of a family among all licence probability at which the predictions held back are precise enough."""
    scored = _predicted(_scored(rows, model), model)
    tried = [r for r in scored.select("label", "family", "share").collect() if r.family not in (NONE, OTHER)]  # some hundred rows
    tried.sort(key=lambda r: -r.share)
    right, best = Counter(), 1.0
    for n, r in enumerate(tried, 1):
        right["right"] += r.family == r.label
        if right["right"] >= config.precision * n:
            best = r.share
    return max(best, 1 / math.e)


def _predicted(rows: DataFrame, model: LicenseModel) -> DataFrame:
    """With the probability of any licence statement, the likeliest kind of it and its share of that probability."""
    kinds = F.array(*[F.struct(F.col("p")[c].alias("p"), F.lit(k).alias("kind")) for c, k in enumerate(model.classes) if k != NONE])
    rows = rows.withColumn("best", F.array_max(kinds)).withColumn("licence_probability", 1 - F.col("p")[model.classes.index(NONE)])
    return rows.withColumns({"family": F.col("best.kind"), "share": F.col("best.p") / F.greatest("licence_probability", F.lit(1e-12))})


def license_statements(docs: DataFrame, config: LicenseConfig = LicenseConfig()) -> DataFrame:
    """One row per paragraph that gives a licence: doc_id, paragraph, begin, stop, family (or unknown), predicted (before
    confirmation), licence_probability, share, template_similarity, confirmed."""
    model = train(docs, config)
    gate = model.gate()
    likely = paragraphs(docs.where(F.col("text").rlike(gate))).where(F.col("text").rlike(gate))
    rows = _with_grams(likely.withColumn("words", _words(F.col("text"))))
    rows = _kept(_predicted(_scored(rows, model), model), F.col("licence_probability") >= config.licence_share)
    rows = rows.withColumn("template_similarity", _template_similarity(F.col("grams"), F.col("family")))
    # the text before the paragraph's line break, and the break
    begin = F.when(F.col("paragraph") == 0, F.lit(0)).otherwise(F.length(F.expr("substring_index(whole, '\n', paragraph)")) + 1).cast("long")
    sure = (F.col("family") != OTHER) & (F.col("share") >= model.least_share) & (F.col("template_similarity") >= config.template_share)
    return rows.select(
        "doc_id",
        F.col("paragraph").cast("long").alias("paragraph"),
        begin.alias("begin"),
        (begin + F.length("text")).alias("stop"),
        F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"),
        F.col("family").alias("predicted"),
        "licence_probability",
        "share",
        "template_similarity",
        sure.alias("confirmed"),
    )
