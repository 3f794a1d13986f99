"""Licence notices in documents: a trained paragraph classifier, confirmed by templates.

A paragraph (line) is scored by multinomial logistic regression over the word 1-
and 2-grams of the notices below, with one more class for everything else.
Training rows are the notices, whole and with words left out or put before them,
and at most MAX_NEGATIVES paragraphs of the corpus, the ones with the smallest
hashes that share no word triple with a notice.  Part of these rows is held back
to set the probability below which the answer is "unknown".  A predicted family
counts only if one of its notices is contained in the paragraph, or in it and the
words around it: a notice may be wrapped over lines.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm.decontamination import words
from gradewell.session import materialize

# Short public notices by family.
NOTICES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.",
               "You may not use this file except in compliance with the License."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL, version 2.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL."],
    "bsd": ["Released under the BSD 3-Clause License.", "Licensed under the BSD license.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "public-domain": ["This work has been released into the public domain.", "Dedicated to the public domain under CC0 1.0."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
FAMILIES = sorted(NOTICES)
MAX_NEGATIVES = 3000
#: Share of a notice's word triples (or pairs, or words, if it is shorter) that a paragraph must hold.
TEMPLATE_SHARE = 0.75
#: Share of ordinary paragraphs that may hold a word of the vocabulary.
MAX_COMMON = 0.005
#: Weights closer to zero are left out.
MIN_WEIGHT = 1e-3


def _grams(w: str | Column) -> Column:
    """Distinct words and word pairs."""
    w = F.col(w) if isinstance(w, str) else w
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, pairs))


def _runs(w: Column, size: Column) -> Column:
    """Distinct runs of ``size`` (1 to 3) words."""
    n = F.greatest(F.size(w) - size + 1, F.lit(0))
    parts = F.arrays_zip(*[F.when(size > k, F.slice(w, F.lit(k + 1), n)).otherwise(F.array_repeat(F.lit(""), n)).alias(f"w{k}") for k in range(3)])
    return F.array_distinct(F.transform(parts, lambda x: F.rtrim(F.concat_ws(" ", x["w0"], x["w1"], x["w2"]))))


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table from values, without leaving the engine."""
    text = F.lit(json.dumps(rows))
    return spark.range(1).select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def notices(spark: SparkSession) -> DataFrame:
    rows = [{"family": f, "notice": t} for f in FAMILIES for t in NOTICES[f]]
    out = _rows(spark, rows, "family: string, notice: string").select("family", words(F.col("notice")).alias("w"))
    size = F.least(F.size("w"), F.lit(3))
    return out.select("family", "w", size.alias("run"), _runs(F.col("w"), size).alias("runs"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, place`` (from 0) and the ``line`` of every paragraph."""
    lines = F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("place", "line")
    return docs.select("doc_id", lines).withColumn("place", F.col("place").cast("long"))


def training_rows(docs: DataFrame) -> DataFrame:
    """``label`` (0: none, else place of the family from 1), ``grams`` and ``held`` (for calibration)."""
    spark = docs.sparkSession
    known = notices(spark)
    label = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")).cast("double")
    copies = known.select(label.alias("label"), "w", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("copy"))
    # Copy 0 is whole; in others a hash leaves out about one word in twelve.
    keep = F.filter("w", lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(w, i, F.col("copy")), F.lit(12)) > 0))
    positive = copies.select("label", keep.alias("w"))
    triples = known.select(F.explode(_runs(F.col("w"), F.lit(3))).alias("run")).agg(F.collect_set("run").alias("known"))
    lines = paragraphs(docs).where("line <> ''").select("line").orderBy(F.xxhash64("line"), "line").limit(MAX_NEGATIVES)
    lines = lines.select(words(F.col("line")).alias("w"))
    other = lines.crossJoin(F.broadcast(triples)).where(~F.arrays_overlap(_runs(F.col("w"), F.lit(3)), "known"))  # one row on the right
    negative = other.select(F.lit(0.0).alias("label"), "w")
    rows = positive.unionByName(negative).select("label", _grams("w").alias("grams"))
    return rows.withColumn("held", F.pmod(F.xxhash64("grams", "label"), F.lit(4)) == 0)


class LicenceModel:
    """Weights per gram and class, intercepts, and the least probability of a family."""

    def __init__(self, weights: dict[str, list[float]], intercepts: list[float], least: float):
        self.weights, self.intercepts, self.least = weights, intercepts, least

    def words(self) -> list[str]:
        """All words of weighted grams; a paragraph without any has the probabilities of the intercepts."""
        return sorted({w for g in self.weights for w in g.split(" ")})

    def known(self, grams: Column) -> Column:
        """The grams that have a weight."""
        return F.filter(grams, lambda g: g.isin(*self.weights))

    def with_probabilities(self, df: DataFrame, grams: str = "grams", name: str = "p") -> DataFrame:
        """``df`` with the class probabilities of known grams, an array in the order of the classes."""
        vocabulary = F.array(*[F.lit(g) for g in self.weights])
        matrix = F.from_json(F.lit(json.dumps(list(self.weights.values()))), "array<array<double>>")
        rows = F.transform(grams, lambda g: F.element_at(matrix, F.array_position(vocabulary, g).cast("int")))
        start = F.array(*[F.lit(x) for x in self.intercepts])
        logits = F.aggregate(rows, start, lambda s, w: F.zip_with(s, w, lambda a, b: a + b))
        df = df.withColumn(name, F.transform(logits, lambda x: F.exp(x)))
        total = F.aggregate(name, F.lit(0.0), lambda s, y: s + y)
        return df.withColumn(name, F.zip_with(name, F.array_repeat(total, len(self.intercepts)), lambda x, y: x / y))


def train(docs: DataFrame) -> LicenceModel:
    """Fit on the bounded training rows and set the least probability on those held back."""
    rows = materialize(training_rows(docs), label="licence-rows")
    grams = {g for r in notices(docs.sparkSession).select(_grams("w").alias("g")).collect() for g in r["g"]}
    # Words that ordinary paragraphs hold, and single letters and digits, say nothing by themselves.
    negative = rows.where("label = 0")
    often = negative.select(F.explode("grams").alias("g")).where(F.col("g").isin(*grams)).groupBy("g").count()
    common = {r["g"] for r in often.where(F.col("count") > MAX_COMMON * negative.count()).collect()}
    telling = {g for g in grams if " " not in g and len(g) > 1 and g not in common}
    vocabulary = sorted(g for g in grams if g in telling or " " in g and telling & set(g.split(" ")))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    fit = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60, standardization=False)
    model = fit.fit(vectors.transform(rows.where("not held")))
    matrix = model.coefficientMatrix.toArray()
    weights = {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > MIN_WEIGHT}
    out = LicenceModel(weights, [float(x) for x in model.interceptVector], 0.0)
    scored = out.with_probabilities(rows.where("held and label = 0").select(out.known(F.col("grams")).alias("grams")))
    worst = scored.agg(F.max(1 - F.col("p")[0])).first()[0]
    # Not below what the intercepts alone give: paragraphs without a weighted gram are never a licence.
    powers = [math.exp(x) for x in out.intercepts]
    out.least = max(min(0.9, max(0.5, worst or 0.0)), 1 - powers[0] / sum(powers))
    return out


def scan_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``) with the licence family it states.

    Returns ``doc_id, licence`` (``none``; ``unknown`` where paragraphs look like
    a licence but match no notice of the family; else the family of the most
    probable confirmed paragraph, ties by its place), ``probability`` (null for
    none), ``n_paragraphs`` that look like a licence, ``n_confirmed``, and all
    confirmed families in order, ``licences``.  Null
    and empty texts have none.  Rows without an id have none; rows that repeat
    an id share the findings of all of them.
    """
    model = train(docs) if model is None else model
    told = F.array(*[F.lit(w) for w in model.words()])
    w = paragraphs(docs.where("doc_id is not null")).select("doc_id", "place", words(F.col("line")).alias("w")).where(F.arrays_overlap("w", told))
    scored = w.select("doc_id", "place", "w", model.known(_grams("w")).alias("grams")).where(F.size("grams") > 0)
    scored = model.with_probabilities(scored)
    best = F.array_max(F.slice("p", 2, len(FAMILIES)))
    families = F.array(*[F.lit(f) for f in FAMILIES])
    likely = scored.select("doc_id", "place", "w", best.alias("probability"),
                           F.element_at(families, (F.array_position(F.slice("p", 2, len(FAMILIES)), best)).cast("int")).alias("family"))
    likely = materialize(likely.where(F.col("probability") > model.least), label="licence-paragraphs")
    texts = notices(docs.sparkSession).groupBy("family").agg(F.collect_list(F.struct("run", "runs")).alias("texts"))
    shares = F.transform("texts", lambda t: F.size(F.array_intersect(t["runs"], F.element_at("own", t["run"]))) / F.size(t["runs"]))
    # No notice that holds a word of the line reaches further than its own length.
    reach = max(len(t.split()) for own in NOTICES.values() for t in own) + 8
    lines = docs.where("doc_id is not null").select("doc_id", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    place, after = F.col("place").cast("int"), F.greatest(F.size("lines") - F.col("place").cast("int") - 1, F.lit(0))
    before = words(F.array_join(F.slice("lines", F.lit(1), place), "\n"))
    behind = words(F.array_join(F.slice("lines", place + 2, after), "\n"))
    near = likely.join(lines, "doc_id").where(F.size("lines") > place)
    # Rows that repeat an id: the line is that of the row whose words it has.
    near = near.where(words(F.element_at("lines", place + 1)) == F.col("w")).withColumns({"before": before, "behind": behind})
    start = F.greatest(F.size("before") - reach, F.lit(0)) + 1
    near = near.withColumn("w", F.concat(F.slice("before", start, F.lit(reach)), "w", F.slice("behind", F.lit(1), F.lit(reach))))
    near = near.select("doc_id", "place", "w", "probability", "family").dropDuplicates(["doc_id", "place", "w"])
    checked = near.withColumn("own", F.array(*[_runs(F.col("w"), F.lit(k)) for k in (1, 2, 3)])).join(texts, "family")
    checked = checked.withColumn("confirmed", F.array_max(shares) >= TEMPLATE_SHARE)
    first = F.min(F.when(F.col("confirmed"), F.struct((-F.col("probability")).alias("p"), "place", "family")))
    found = checked.groupBy("doc_id").agg(first.alias("first"), F.count("*").alias("n"), F.count_if("confirmed").alias("n_confirmed"),
                                          F.max("probability").alias("probability"),
                                          F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("licences"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")
    return out.select(
        "doc_id", F.coalesce("first.family", F.when(F.col("n") > 0, "unknown"), F.lit("none")).alias("licence"),
        F.coalesce(-F.col("first.p"), F.col("probability")).alias("probability"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"))
