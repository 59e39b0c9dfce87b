"""Licence scans: a trained paragraph classifier, confirmed by template comparison, with DataFrame functions only.

Paragraphs (lines) are bags of word unigrams and bigrams. A multinomial logistic regression, fitted by Spark, gives
each licence family and ``unknown`` a probability; a family is taken only above a probability that was set on
paragraphs known to be none, and only if the paragraph holds most of the word triples of one of its templates.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.session import materialised

UNKNOWN = "unknown"
# Short notices by which texts name their licence, by family.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "You should have received a copy of the GNU Lesser General Public License along with this library", "SPDX-License-Identifier: LGPL-2.1-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
}
# Paragraphs with licence words that grant nothing, and words too common to tell anything alone.
OTHERS = [
    "The driver lost his license after the second offence.", "She released a new version of the software this week.", "All rights reserved.",
    "The company sells licences for its software under commercial terms.", "A work of general interest to the public.", "The file was modified by another person.",
    "Version 2.0 of the program adds a source form.", "The public library is free to use.", "Permission to enter was granted to the visitors.", "The copy you received is free of errors.",
    "Apache helicopters were seen over the city.", "Students at MIT built the machine.", "The foundation published its yearly report.", "Conditions were met and the forms were sent.",
    "International law covers this extent of work.", "The document identifies the terms of use.", "You may not use this door except in an emergency.", "Creative people need common ground and attribution.",
]
STOPWORDS = "a an the of to in and or is are be by for it its this that with at on as you not any all may was were has have had he she they we i from under".split()


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})", " "), " +"), lambda w: w != "")


def grams(w: Column) -> Column:
    """Distinct words but the commonest, and distinct pairs of neighbours that hold another word."""
    common = lambda c: c.isin(STOPWORDS)
    single = F.filter(w, lambda c: ~common(c))
    pairs = F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.when(~common(a) | ~common(b), F.concat_ws(" ", a, b))), lambda p: p.isNotNull() & p.contains(" "))
    return F.array_distinct(F.concat(single, pairs))


def triples(w: Column) -> Column:
    """Distinct runs of three words; fewer words are one run."""
    return F.when(F.size(w) < 3, F.array(F.array_join(w, " "))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, paragraph (its place from 0) and words, for every line that is not empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tkey"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "line"))
    return rows.select("id", "tkey", "paragraph", words(F.col("line")).alias("w"))


#: What the corpus' lines weigh together in the fit, however many there are; a template line weighs 8, one of ``OTHERS`` 1.
CORPUS_WEIGHT = 1000.0
BANDS = 16_384


def clean_lines(docs: DataFrame, vocabulary: list[str], triples_known: list[str], text_col: str = "text") -> DataFrame:
    """grams and n: which sets of known grams the lines of all documents hold, and how many lines hold each.

    To a model over known grams, lines of one set are the same row, so counting loses nothing. Lines that share a word triple with a template are
    left out, since they may state a licence.
    """
    listed = sorted({w for g in vocabulary for w in g.split(" ") if w not in STOPWORDS})
    each = docs.filter(F.col(text_col).isNotNull()).select(F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    each = each.select(F.explode(F.array(words(F.col("line")))).alias("w"))  # generated, so that no expression below splits a line again
    some = F.arrays_overlap("w", F.array(*map(F.lit, listed)))
    kept = each.filter(~some | ~F.arrays_overlap(triples(F.col("w")), F.array(*map(F.lit, triples_known))))
    held = F.when(some, F.array_sort(F.array_intersect(grams(F.col("w")), F.array(*map(F.lit, vocabulary))))).otherwise(F.array().cast("array<string>"))
    return kept.select(held.alias("grams")).groupBy("grams").agg(F.count(F.lit(1)).alias("n"))


def train(spark: SparkSession, docs: DataFrame, clean_rate: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """Weights by gram and family, and the least probability of a family.

    Learned from the templates, from ``OTHERS`` and from every line of the corpus that shares no word triple with a template. Half of
    the sets of grams (by hash) are kept out of the fit; the least probability is the first multiple of ``1 / BANDS``, one half or above,
    where ``clean_rate`` of their lines that hold a known gram stay unknown.
    """
    known = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in OTHERS], "family string, line string")
    known = known.select("family", words(F.col("line")).alias("w")).withColumn("grams", grams(F.col("w")))
    named = known.filter(F.col("family") != UNKNOWN)
    all_triples = [r.t for r in named.select(F.explode(triples(F.col("w"))).alias("t")).distinct().collect()]
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=8192).fit(named)
    clean = materialised(clean_lines(docs, counted.vocabulary, all_triples, text_col), "licence-clean")
    held = (F.size("grams") > 0) & (F.pmod(F.xxhash64("grams"), F.lit(2)) == 1)
    lines = clean.filter(~held).agg(F.sum("n")).first()[0] or 1
    rows = known.select("family", "grams", F.when(F.col("family") == UNKNOWN, F.lit(1.0)).otherwise(F.lit(8.0)).alias("weight")).union(
        clean.filter(~held).select(F.lit(UNKNOWN), "grams", F.col("n") * F.lit(CORPUS_WEIGHT / lines)))
    label = F.array_position(F.array(*map(F.lit, [UNKNOWN, *TEMPLATES])), F.col("family")).cast("double") - 1
    fit = rows.withColumn("label", label)
    model = LogisticRegression(family="multinomial", regParam=0.002, maxIter=80, weightCol="weight").fit(counted.transform(fit))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    table = [(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(counted.vocabulary)] + [(None, [float(x) for x in bias])]
    weights = materialised(spark.createDataFrame(table, T.StructType([T.StructField("gram", T.StringType()), T.StructField("w", T.ArrayType(T.DoubleType()))])).coalesce(1), "licence-weights")
    by = F.floor(F.col("p") * BANDS).alias("band")
    scored = _scored(clean.filter(held).select("grams", "n", F.explode("grams").alias("gram")), weights, ["grams", "n"])
    return weights, _least({r.band: r.n for r in scored.groupBy(by).agg(F.sum("n").alias("n")).collect()}, clean_rate)


def _least(bands: dict[int, int], clean_rate: float) -> float:
    """The first band edge, one half or above, with at most ``1 - clean_rate`` of all lines in the bands from it on."""
    spare, above = (1 - clean_rate) * sum(bands.values()), 0
    for band in range(BANDS, BANDS // 2 - 1, -1):
        above += bands.get(band, 0)
        if above > spare:
            return (band + 1) / BANDS
    return 0.5


def probabilities(lines: DataFrame, weights: DataFrame) -> DataFrame:
    """id, tkey, paragraph, family and p: the most likely licence family of each line that holds a known gram.

    Every gram holds a word that is not one of the commonest, so lines without such a word of the templates need not be
    expanded; they score by the bias alone, which is unknown's.
    """
    table = weights.filter("gram is not null")
    vocabulary = [r.word for r in table.select(F.explode(F.split("gram", " ")).alias("word")).distinct().collect() if r.word not in STOPWORDS]
    some = lines.filter(F.arrays_overlap("w", F.array(*map(F.lit, vocabulary))))
    return _scored(some.select("id", "tkey", "paragraph", F.explode(grams(F.col("w"))).alias("gram")), weights, ["id", "tkey", "paragraph"])


def _scored(each: DataFrame, weights: DataFrame, by: list[str]) -> DataFrame:
    """The likeliest family and its probability for the rows ``by``, given one row for each of their grams."""
    bias = weights.filter("gram is null").first()["w"]
    each = each.join(F.broadcast(weights.filter("gram is not null")), "gram")  # the templates' grams: fixed
    classes = [UNKNOWN, *TEMPLATES]
    sums = each.groupBy(*by).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(classes))])
    z = F.array(*[F.col(f"s{k}") + F.lit(float(bias[k])) for k in range(len(classes))])
    scored = sums.select(*by, z.alias("z")).withColumn("top", F.array_max("z")).withColumn("families", F.slice("z", 2, len(TEMPLATES)))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    family = F.element_at(F.array(*map(F.lit, TEMPLATES)), F.array_position("families", F.array_max("families")).cast("int"))
    return scored.select(*by, family.alias("family"), (F.exp(F.array_max("families") - F.col("top")) / total).alias("p"))


def scan(docs: DataFrame, weights: DataFrame, least: float, overlap: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tkey, paragraph, family, p and confirmed (share of a template's triples) for every line that states a licence.

    Lines whose family stays below ``least``, or that hold less than ``overlap`` of every template of the family, are unknown and not
    reported. NULL and empty texts have no lines; rows of one id and text are the same lines and reported once.
    """
    lines = paragraphs(docs, id_col, text_col)
    likely = materialised(probabilities(lines, weights).filter(F.col("p") >= least), "licence-lines")
    templates = docs.sparkSession.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, line string")
    templates = F.broadcast(templates.select("family", triples(words(F.col("line"))).alias("t")))  # fixed
    named = [F.col(c).alias(f"_{c}") for c in ("id", "tkey", "paragraph")]
    ids = likely.select(*named, "family", "p")
    again = docs.join(likely.select(F.col("tkey").alias("_k")).distinct(), F.xxhash64(F.col(text_col)) == F.col("_k"), "left_semi")
    back = paragraphs(again, id_col, text_col).join(ids, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey")) & (F.col("paragraph") == F.col("_paragraph")))
    shares = back.withColumn("mine", triples(F.col("w"))).join(templates, "family").withColumn("share", F.size(F.array_intersect("mine", "t")) / F.size("t"))
    return (shares.groupBy("id", "tkey", "paragraph", "family", "p").agg(F.max("share").alias("confirmed")).filter(F.col("confirmed") >= overlap)
            .select(F.col("id").alias("doc_id"), "tkey", "paragraph", "family", "p", "confirmed"))
