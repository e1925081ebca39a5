"""Licence scan by a trained paragraph classifier. DataFrame and Spark ML operations only.

A paragraph is a line with a word in it. Its 1-, 2- and 3-word n-grams, hashed, go through a
multinomial logistic regression over licence families and "none". It is trained here, on word
windows of the notices below and on a bounded sample of the table's own paragraphs: of the
``negative_documents`` distinct texts of smallest hash, the ``negative_paragraphs`` distinct
paragraphs (as words) of smallest hash, less those like a template. Nobody has labelled these;
that they are unlike every template is what makes them "none". The sample depends on the rows
alone, not on their order, and so does the model, which is fitted in one task on sorted rows.
All paragraphs are scanned. A held-out part of both sets the least probability at which a family is named (the smallest with the asked precision); what is
likely a licence but below it is "unknown". A named family is confirmed by comparison with its
templates: with too few word pairs in common it is "unknown" too, with next to none no licence.

Defined results: a null or empty text has no paragraphs; each row is scanned by itself, also
repeated ones and those without an id; an empty table gives no rows; further columns are not
carried.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import staged

N_FEATURES = 1 << 13
NEGATIVE_DOCUMENTS, NEGATIVE_PARAGRAPHS = 4000, 20_000
PRECISION, LEAST_SIMILARITY, UNKNOWN_SIMILARITY = 0.99, 0.5, 0.1
NONE, UNKNOWN = "none", "unknown"
#: Notices as their publishers word them.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file'
        " except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        ' software and associated documentation files (the "Software"), to deal in the Software'
        " without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms"
        " of the GNU General Public License as published by the Free Software Foundation",
        "either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are"
        " permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0"
        " International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No part of this work may be reproduced without written permission of the publisher.",
    ),
}
FAMILIES = (*TEMPLATES, NONE)


def _words(text: Column) -> Column:
    """Lower-cased words; digits become one sign, so that years and versions are alike."""
    same = F.regexp_replace(F.lower(text), r"\p{N}+", "0")
    return F.array_remove(F.split(same, r"[^\p{L}\p{N}]+"), "")


def _runs(n: int) -> Column:
    return F.when(
        F.size("words") >= n,
        F.transform(
            F.sequence(F.lit(0), F.size("words") - n),
            lambda i: F.concat_ws(" ", *[F.get("words", i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<string>"))


def _grams(df: DataFrame) -> DataFrame:
    pairs = _runs(2)
    return df.withColumn("pairs", F.array_distinct(pairs)).withColumn(
        "grams", F.concat("words", "pairs", _runs(3))
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, words) of each line with a word; lines are numbered from 0."""
    lines = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.select("doc_id", "paragraph", _words(F.col("line")).alias("words")).filter(
        F.size("words") > 0
    )


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(FAMILIES.index(f), t) for f, texts in TEMPLATES.items() for t in texts]
    df = spark.createDataFrame(rows, "label int, template string")
    return _grams(df.select("label", "template", _words(F.col("template")).alias("words")))


def _positives(spark: SparkSession) -> DataFrame:
    """Every window of at least half of a template's words, and of three at least."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - F.greatest(F.ceil(n / 2), F.lit(3)).cast("int"), F.lit(0)))
    windows = _templates(spark).select(
        "label", "template", "words", F.explode(starts).alias("start")
    )
    least = F.greatest(F.ceil(n / 2), F.lit(3)).cast("int")
    lengths = F.sequence(F.least(least, n - F.col("start")), n - F.col("start"))
    return windows.select(
        "label", F.explode(lengths).alias("length"), "words", "start"
    ).select("label", F.slice("words", F.col("start") + 1, F.col("length")).alias("words"))


def _similarity(sentences: Column, pairs: Column) -> Column:
    """The largest share of word pairs in common with a template, of the shorter of the two."""
    shares = F.transform(
        sentences,
        lambda s: F.size(F.array_intersect(s, pairs))
        / F.greatest(F.least(F.size(s), F.size(pairs)), F.lit(1)),
    )
    return F.array_max(shares)


def _least_hashes(df: DataFrame, column: str, n: int) -> DataFrame:
    """The rows with the ``n`` smallest hashes of a column; rows equal in it stay together."""
    # hashes alone are sorted: the rows stay where they are until the last hash is known
    order = F.xxhash64(column)
    hashes = df.filter(F.col(column).isNotNull()).select(order.alias("h")).distinct()
    last = hashes.orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return df.filter(F.col(column).isNotNull() & (order <= F.lit(last)))


def sample(docs: DataFrame, n_documents: int, n_paragraphs: int) -> DataFrame:
    """(words, pairs) of the paragraphs that may be negatives, each once."""
    chosen = _least_hashes(docs, "text", n_documents).dropDuplicates(["text"])
    found = staged(paragraphs(chosen).select("words").distinct(), "paragraphs")
    # written, so that a filter on the word pairs sees them made once
    return staged(_grams(_least_hashes(found, "words", n_paragraphs)).drop("grams"), "sampled")


def train(
    docs: DataFrame,
    negative_documents: int = NEGATIVE_DOCUMENTS,
    negative_paragraphs: int = NEGATIVE_PARAGRAPHS,
) -> tuple[PipelineModel, float]:
    """The classifier and the least probability at which a family is named."""
    spark = docs.sparkSession
    every = _templates(spark).groupBy(F.lit(1).alias("one")).agg(F.collect_list("pairs").alias("all"))
    sampled = sample(docs, negative_documents, negative_paragraphs).withColumn("one", F.lit(1))
    negatives = (
        sampled.join(F.broadcast(every), "one")
        .filter(_similarity(F.col("all"), F.col("pairs")) < 0.25)
        .select(F.lit(FAMILIES.index(NONE)).alias("label"), "words")
    )
    # single template words alone are no licence: each is a negative too
    alone = _templates(spark).select(
        F.lit(FAMILIES.index(NONE)).alias("label"), F.explode("words").alias("w")
    ).distinct().select("label", F.array("w").alias("words"))
    examples = _positives(spark).unionByName(negatives).unionByName(alone)
    rows = _grams(examples).select(F.col("label").cast("double").alias("label"), "grams")
    # a bounded number of rows in one order: sums of doubles are the same in every run
    rows = staged(rows.repartition(1).sortWithinPartitions("label", "grams"), "examples")
    held_out = F.pmod(F.xxhash64("grams"), F.lit(4)) == 0
    stages = [
        HashingTF(inputCol="grams", outputCol="features", numFeatures=N_FEATURES, binary=True),
        LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, elasticNetParam=0.0),
    ]
    model = Pipeline(stages=stages).fit(rows.filter(~held_out))
    scored = staged(_scored(model, rows.filter(held_out)).select("label", "best", "p"), "held-out")
    named = scored.filter(F.col("best") != FAMILIES.index(NONE))
    grid = named.select("label", "best", "p", F.explode(F.sequence(F.lit(50), F.lit(95), F.lit(5))).alias("cut"))
    sure = (
        grid.filter("100 * p >= cut")
        .groupBy("cut")
        .agg(F.avg((F.col("label") == F.col("best")).cast("double")).alias("precision"))
        .filter(F.col("precision") >= PRECISION)
        .agg(F.min("cut"))
        .first()[0]
    )
    return model, (sure or 95) / 100


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the likeliest class other than none if a licence is likelier than none."""
    out = model.transform(df).withColumn("all_p", vector_to_array("probability"))
    none = FAMILIES.index(NONE)
    families = F.slice("all_p", 1, none)
    out = out.withColumn("p_none", F.get("all_p", F.lit(none)))
    out = out.withColumn("p", F.array_max(families))
    best = F.array_position(families, F.col("p")).cast("int") - 1
    return out.withColumn("best", F.when(F.col("p_none") >= 0.5, F.lit(none)).otherwise(best))


def scan(docs: DataFrame, model: PipelineModel, least: float) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity) of each paragraph with a licence."""
    spark = docs.sparkSession
    none = FAMILIES.index(NONE)
    # a column that is not deterministic keeps the filter from being evaluated below the model
    scored = _scored(model, _grams(paragraphs(docs))).withColumn(
        "above", F.monotonically_increasing_id()
    )
    scored = scored.filter((F.col("best") != none) & (F.col("above") >= 0))
    names = spark.createDataFrame(list(enumerate(FAMILIES)), "best int, name string")
    known = (
        _templates(spark)
        .groupBy(F.col("label").alias("best"))
        .agg(F.collect_list("pairs").alias("sentences"))
        .join(names, "best")
    )
    compared = scored.join(F.broadcast(known), "best").withColumn(
        "similarity", _similarity(F.col("sentences"), F.col("pairs"))
    )
    sure = (F.col("p") >= least) & (F.col("similarity") >= LEAST_SIMILARITY)
    # without any likeness to a template the paragraph is noise to the classifier
    return compared.filter(F.col("similarity") >= UNKNOWN_SIMILARITY).select(
        "doc_id",
        "paragraph",
        F.when(sure, F.col("name")).otherwise(UNKNOWN).alias("family"),
        F.col("p").alias("probability"),
        "similarity",
    )
