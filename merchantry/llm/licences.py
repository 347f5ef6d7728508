"""Licence notices: a trained paragraph classifier, calibrated, confirmed by template comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.llm.learning import sampled
from merchantry.sources.shared import discard, shared_dir, written

UNKNOWN = "unknown"
MAX_DOCUMENTS = 400
MAX_WORDS = 80
STRIDE = 40
CONFIDENT = 0.5
CONFIRMED = 0.8

# fixed values: the licences' own notices and opening sentences
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("AGPL-3.0", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# marks that may open or close a line of a comment
MARKS = r"(?m)^[ \t]*(?:<!--|//+!?|/?\*+/?|[#;%>]+|--+|(?:dnl|REM|rem|\.\.)(?=[ \t]))+[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$"
TOKEN = r"[\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*"
BLANK_LINES = r"(?>\r\n|\r|\n)\s*(?>\r\n|\r|\n)"
FAMILIES = sorted({family for family, _ in TEMPLATES})


@dataclass
class LicenceModel:
    """Text features, the classifier of families, and the calibration of its best probability."""

    features: PipelineModel
    classifier: LogisticRegressionModel
    calibration: LogisticRegressionModel


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however often they are used afterwards.

    They come out of a generator, through which the optimiser neither moves filters nor repeats
    what stands below, as it would write a chain of features out wherever its end is used.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _pairs(words: Column, vocabulary: list[str]) -> Column:
    """The pair that begins at every word, null if it is in no template; the last word begins none."""
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(pairs, lambda pair: F.when(pair.isin(vocabulary), pair))


def paragraphs(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, text_hash, part, line, words, grams): the runs of lines without a blank one between, and
    the lines of every run, long ones of both in overlapping windows, that have a word pair of the
    vocabulary; `words` is a hash of the piece, `grams` these pairs in order.

    Marks of comments are left out, so a notice that is wrapped over the lines of a source file
    is in one run. Whole runs have line -1. A line is cut into words once; a run's words are those
    of its lines. A window has MAX_WORDS words and the next one starts STRIDE words later, so a
    notice inside a long run lies whole in some window.
    """
    runs = F.split(F.regexp_replace("text", MARKS, ""), BLANK_LINES)
    each = _identified(docs).where("text is not null").select("doc_id", "text_hash", F.posexplode(runs).alias("part", "run"))
    words = F.transform(F.split("run", r"[\r\n]+"), lambda x: F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)))
    cut = _once(each, lines=F.filter(words, lambda x: F.size(x) > 0)).drop("run").where(F.size("lines") > 0)

    def piece(line: Column, words: Column) -> Column:
        pairs = _pairs(words, vocabulary)
        return F.struct(line.cast("int").alias("line"), F.xxhash64(words).alias("words"), pairs.alias("pairs"))

    # a run of one line is its line
    whole = F.when(F.size("lines") > 1, F.array(piece(F.lit(-1), F.flatten("lines"))))
    single = F.transform("lines", lambda x, i: piece(i, x))
    none = F.array().cast("array<struct<line: int, words: bigint, pairs: array<string>>>")
    pieces = cut.select("doc_id", "text_hash", "part", F.inline(F.concat(F.coalesce(whole, none), single)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("pairs") - 1 - (MAX_WORDS - STRIDE)), F.lit(STRIDE))
    # the last word of a window begins no pair of it
    windows = F.transform(starts, lambda at: F.slice("pairs", at + 1, F.lit(MAX_WORDS - 1)))
    cuts = F.when(F.size("pairs") > MAX_WORDS, windows).otherwise(F.array("pairs"))
    known = F.filter(F.transform(cuts, lambda x: F.filter(x, lambda pair: pair.isNotNull())), lambda x: F.size(x) > 0)
    return pieces.select("doc_id", "text_hash", "part", "line", "words", F.explode(known).alias("grams"))


def _described(pieces: DataFrame, features: PipelineModel) -> DataFrame:
    """The pieces with their features."""
    keys = pieces.columns
    described = features.stages[-1].transform(pieces).withColumnRenamed("features", "_features")
    return _once(described, features=F.col("_features")).select(*keys, "features")


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a hash of the text, which tells rows with the same id apart."""
    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("text_hash"))


def _examples(spark: SparkSession) -> DataFrame:
    """Templates whole, without their first or last words, and short cuttings, which prove nothing."""
    rows = []
    for family, text in TEMPLATES:
        words = text.split()
        whole = [words, words, words[1:], words[:-1], words[2:], words[1:-1]]
        rows += [(FAMILIES.index(family), " ".join(w)) for w in whole if len(w) >= 4]
        rows += [(len(FAMILIES), " ".join(words[k : k + 3])) for k in range(len(words) - 3)]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "number int, label int, paragraph string")


def _templates(model: PipelineModel, spark: SparkSession) -> dict[str, list[list[str]]]:
    """The word pairs of every template, by family."""
    rows = model.transform(spark.createDataFrame(TEMPLATES, "family string, paragraph string")).collect()
    found: dict[str, list[list[str]]] = {}
    for r in rows:
        found.setdefault(r["family"], []).append(list(dict.fromkeys(r["grams"])))
    return found


def _lists(templates: list[list[str]]) -> Column:
    return F.array(*[F.array(*[F.lit(g) for g in grams]) for grams in templates])


def _likest(templates: Column) -> Column:
    """The largest share of a template's word pairs that the column grams holds."""
    return F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t)))


def _margins() -> Column:
    """Log odds of every licence family against the class unknown. Other families have no part in
    it, so two licences in one paragraph do not weaken each other."""

    logs = F.transform(vector_to_array(F.col("probability")), lambda p: F.log(F.greatest(F.lit(1e-12), p)))
    # the last one is taken away from a pair, so that it is not computed for every family
    paired = F.arrays_zip(
        F.slice(logs, 1, len(FAMILIES)).alias("family"), F.array_repeat(F.element_at(logs, -1), len(FAMILIES)).alias("none")
    )
    return F.transform(paired, lambda p: p["family"] - p["none"])


def train(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> LicenceModel:
    """Fit on the templates and on the paragraphs of about `max_documents` documents.

    Features are word pairs of the templates. Cuttings of templates too short to prove a
    licence, and sampled paragraphs that hold less than half of any template, are examples of
    the class unknown. One half of all examples trains the classifier, the other half
    calibrates the probability that its best family is right.
    """
    spark = docs.sparkSession
    examples = _examples(spark)
    features = Pipeline(
        stages=[
            RegexTokenizer(inputCol="paragraph", outputCol="tokens", gaps=False, pattern=TOKEN),
            NGram(n=2, inputCol="tokens", outputCol="grams"),
            CountVectorizer(inputCol="grams", outputCol="features", binary=True),
        ]
    ).fit(examples)
    some = docs.where(sampled("doc_id", docs.count(), max_documents))
    pool = paragraphs(some, features.stages[-1].vocabulary).select("words", "grams").distinct()
    pool = _described(pool.withColumn("number", F.xxhash64("words", "grams")), features)
    every = _lists([t for own in _templates(features, spark).values() for t in own])
    clean = pool.where(_likest(every) < 0.5).select(
        "number", F.lit(len(FAMILIES)).alias("label"), "features"
    )
    known = features.transform(examples).select(F.col("number").cast("bigint"), "label", "features")
    rows = written(known.union(clean), "examples")
    half = F.pmod("number", F.lit(2))
    classifier = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60).fit(rows.where(half == 0))
    judged = classifier.transform(rows.where(half == 1)).withColumn(
        "margin", array_to_vector(F.array(F.array_max(_margins())))
    )
    best = F.array_position(_family_odds(), F.array_max(_family_odds())) - 1
    right = (F.col("label") == best).cast("int")
    calibration = LogisticRegression(
        featuresCol="margin", labelCol="right", probabilityCol="sure", rawPredictionCol="odds", predictionCol="yes",
        family="binomial", regParam=1e-3, maxIter=40,
    ).fit(judged.select("margin", right.alias("right")))
    return LicenceModel(features, _bare(classifier), _bare(calibration))


def _bare(model: LogisticRegressionModel) -> LogisticRegressionModel:
    """The model without its training summary, which refers to the session and can keep the model
    from being sent to the tasks."""
    spark = SparkSession.active()
    path = shared_dir(spark, "licence-model")
    try:
        model.save(path)
        return LogisticRegressionModel.load(path)
    finally:
        discard(spark, path)



def _family_odds() -> Column:
    return F.slice(vector_to_array(F.col("probability")), 1, len(FAMILIES))


def _held(grams: Column) -> Column:
    """The share of the word pairs that the column grams holds."""
    return F.size(F.array_intersect(grams, F.col("grams"))) / F.size(grams)


def _in_its_own_right(template: Column) -> Column:
    """Whether a template of the column present is there by more than what others lend it.

    Templates of different families share word pairs. Of those that no other family's present
    template has, CONFIRMED or more must be there, if there are any.
    """
    others = F.filter("present", lambda o: o["family"] != template["family"])
    rest = F.array_except(template["pairs"], F.flatten(F.transform(others, lambda o: o["pairs"])))
    return (F.size(rest) == 0) | (_held(rest) >= CONFIRMED)


def notices(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, text_hash, part, line, family, probability, similarity) of every confirmed notice.

    A paragraph without any word pair of a template cannot reach a family and is left before
    the classifier. Every family of the others that is calibrated to CONFIDENT or more is
    compared with its templates, of which one must be there in its own right. The notices of
    one line are those of the line; one that no line holds alone has line -1.
    """
    keys = ["doc_id", "text_hash", "part", "line"]
    scored = model.classifier.transform(_described(paragraphs(docs, model.features.stages[-1].vocabulary), model.features))
    scored = _once(scored.select(*keys, "grams", F.col("probability").alias("_chance")), probability=F.col("_chance"))
    slope, bias = float(model.calibration.coefficients[0]), float(model.calibration.intercept)
    sure = F.transform(_margins(), lambda m: 1 / (1 + F.exp(-(m * F.lit(slope) + F.lit(bias)))))
    likely = _once(scored, sure=sure).select(*keys, "grams", "sure").where(F.array_max("sure") >= CONFIDENT)
    known = _templates(model.features, docs.sparkSession)
    listed = F.array(
        *[
            F.struct(F.lit(FAMILIES.index(f)).alias("family"), F.array(*[F.lit(g) for g in grams]).alias("pairs"))
            for f, own in known.items()
            for grams in own
        ]
    )
    there = _once(likely, present=F.filter(listed, lambda t: _held(t["pairs"]) >= CONFIRMED)).where(F.size("present") > 0)
    sole = there.withColumn("t", F.explode(F.filter("present", _in_its_own_right)))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    hits = sole.select(
        "doc_id", "text_hash", "part", "line", names[F.col("t.family")].alias("family"),
        F.col("sure")[F.col("t.family")].alias("probability"), _held(F.col("t.pairs")).alias("similarity"),
    ).where(F.col("probability") >= CONFIDENT)
    # few rows; written down, so that the scan of all texts runs once and in one stage
    found = written(hits, "notices").groupBy("doc_id", "text_hash", "part", "line", "family").agg(
        F.max("probability").alias("probability"), F.max("similarity").alias("similarity")
    )
    keys = ["doc_id", "text_hash", "part", "family"]
    in_lines = found.where("line >= 0").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return found.where("line >= 0").union(found.where("line < 0").join(in_lines, same, "left_anti"))


def scan_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Per document: doc_id, licences, n_notices, probability and similarity.

    `licences` are the families found, by name, joined by commas; the figures are those of the
    best notice. A null or empty text, or one without a notice, has '', 0, 0.0 and 0.0. Null
    ids and repeated rows are reported like others.
    """
    found = notices(docs, model).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("licences"),
        F.count("*").alias("n_notices"),
        F.max("probability").alias("probability"),
        F.max("similarity").alias("similarity"),
    )
    rows = _identified(docs).select("doc_id", "text_hash")
    joined = rows.join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")), "left"
    )
    return joined.select(
        "doc_id",
        F.coalesce("licences", F.lit("")).alias("licences"),
        F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )
