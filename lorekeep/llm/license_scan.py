"""Licence families of paragraphs by a trained sparse n-gram classifier and a template comparison."""

from __future__ import annotations

import random
from dataclasses import dataclass
from math import exp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# Short notices of well-known licence families.
TEMPLATES = (
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "You can redistribute it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright; released under CC0 1.0 Universal public domain dedication."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
)
NONE = "none"
WORD_BREAK = "[^a-z0-9]+"
#: Background paragraphs that the classifier is fitted on, at most; they are the smallest by hash.
BACKGROUND_ROWS = 2000
VARIANTS = 12
SEED = 7
#: n-grams of the model, at most.
VOCABULARY = 4096
#: Share of held-out notices that the threshold of the unknown class must let pass.
RECALL = 0.98
#: Share of a template's words that a paragraph must hold to confirm a family.
CONFIRM = 0.75
#: Words of the longest template: a wrapped notice has no more of them in its first line, nor after it.
LONGEST = max(len(text.split()) + 4 for _, text in TEMPLATES)
#: Rows with notices in single lines that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: str) -> Column:
    """Lower-case ASCII words and numbers of a column."""
    return F.filter(F.split(ascii_lower(F.col(text)), WORD_BREAK), lambda w: w != "")


def grams(column: str) -> Column:
    """Words and word pairs."""
    pairs = F.expr(f"CASE WHEN size({column}) < 2 THEN cast(array() AS array<string>) ELSE transform(sequence(0, size({column}) - 2), i -> concat({column}[i], ' ', {column}[i + 1])) END")
    return F.array_distinct(F.concat(F.col(column), pairs))


@dataclass(frozen=True)
class Model:
    """Weights by n-gram and family, the intercepts, and the probability below which a paragraph is unknown."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    intercepts: tuple[float, ...]
    threshold: float

    def probabilities(self, found: list[str]) -> dict[str, float]:
        """Of a paragraph's n-grams; the driver's copy of what scan() computes, for calibration and tests."""
        sums = [b + sum(self.weights[g][i] for g in found if g in self.weights) for i, b in enumerate(self.intercepts)]
        parts = [exp(s - max(sums)) for s in sums]
        return {f: p / sum(parts) for f, p in zip(self.families, parts, strict=True)}


def variants() -> list[tuple[str, str]]:
    """(family, text): each template with words dropped and with foreign words around it."""
    rng, found = random.Random(SEED), []
    others = "the file page work author text site this content about from 2019 2024 inc ltd and contributors".split()
    for family, text in TEMPLATES:
        found.append((family, text))
        for _ in range(VARIANTS):
            kept = [w for w in text.split() if rng.random() > 0.06] or text.split()
            found.append((family, " ".join([*rng.choices(others, k=rng.randint(0, 4)), *kept, *rng.choices(others, k=rng.randint(0, 4))])))
    return found


def notices(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    literal = [F.struct(F.lit(f).alias("family"), F.lit(t).alias("paragraph")) for f, t in rows]
    return spark.range(1).select(F.explode(F.array(*literal)).alias("r")).select("r.*")


def paragraphs(docs: DataFrame) -> DataFrame:
    """row_key (hash of doc_id and text), place, paragraph: the non-blank lines of every text."""
    lines = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("place", "paragraph"))
    return lines.filter(F.trim("paragraph") != "")


def wrapped(docs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """row_key, place, words: for every line that its block goes on after, its last LONGEST words and the next LONGEST.

    A block ends at a line without words (blank, or a comment leader alone) and at a line that is a notice by itself
    (confirmed: row_key, places). Leaders and other marks are no words, so whatever way a notice is wrapped, one of
    these windows holds all of it.
    """
    few = F.broadcast(confirmed) if confirmed.count() <= BROADCAST_ROWS else confirmed
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").filter(F.instr("text", "\n") > 0).join(few, "row_key", "left")
    by_line = F.transform(F.split(ascii_lower(F.col("text")), "\n"), lambda line: F.filter(F.split(line, WORD_BREAK), lambda w: w != ""))
    rows = rows.select("row_key", "places", by_line.alias("lines")).withColumn("lines", F.expr("transform(lines, (l, i) -> CASE WHEN array_contains(places, i) THEN cast(array() AS array<string>) ELSE l END)"))
    after = (
        f"aggregate(slice(lines, i + 2, {LONGEST}), struct(cast(array() AS array<string>) AS w, true AS on),"
        f" (a, x) -> CASE WHEN a.on AND size(x) > 0 AND size(a.w) < {LONGEST} THEN struct(concat(a.w, x) AS w, true AS on) ELSE struct(a.w AS w, false AS on) END).w"
    )
    at = "filter(sequence(0, size(lines) - 1), i -> size(lines[i]) > 0 AND size(get(lines, i + 1)) > 0)"
    found = f"transform({at}, i -> struct(i AS place, concat(slice(lines[i], greatest(1, size(lines[i]) - {LONGEST - 1}), {LONGEST}), slice({after}, 1, {LONGEST})) AS words))"
    return rows.select("row_key", F.explode(F.expr(found)).alias("r")).select("row_key", "r.place", "r.words")


def fit(docs: DataFrame, background_rows: int = BACKGROUND_ROWS) -> Model:
    """Fits the classifier on the templates' variants and a bounded sample of background paragraphs.

    Background paragraphs that hold CONFIRM of a template's words are left out of the sample. n-grams that occur in
    more than one background paragraph in a hundred carry no evidence and are no features; the elastic net makes the
    rest sparse. Every fourth variant is held out and sets the threshold of the unknown class.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    everything = paragraphs(docs.select("doc_id", "text")).select("paragraph", F.xxhash64("paragraph").alias("h"))
    least = everything.select("h").distinct().orderBy("h").limit(background_rows)  # of 8 bytes a paragraph, not of texts
    background = everything.join(F.broadcast(least), "h", "left_semi").groupBy("h").agg(F.min("paragraph").alias("paragraph")).select("paragraph")
    background = background.withColumn("words", F.array_distinct(words("paragraph")))
    for _, text in TEMPLATES:
        own = sorted({w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()})
        share = F.size(F.array_intersect("words", F.array(*map(F.lit, own)))) / len(own)
        background = background.filter(share < CONFIRM)
    made = variants()
    held_out, used = made[3::4], [x for i, x in enumerate(made) if i % 4 != 3]
    rows = notices(spark, used).unionByName(background.select(F.lit(NONE).alias("family"), "paragraph"))
    rows = stored(rows.withColumn("words", words("paragraph")).withColumn("grams", grams("words")).drop("words"), "licence-training")
    common = rows.filter(F.col("family") == NONE).select(F.explode("grams").alias("g")).groupBy("g").count().filter(F.col("count") > background_rows // 100)
    common = [r[0] for r in common.orderBy("g").limit(200_000).collect()]  # of a bounded sample
    rows = rows.withColumn("grams", F.array_except("grams", F.array(*map(F.lit, common))) if common else F.col("grams"))
    vectors = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(rows.filter(F.col("family") != NONE))
    families = (NONE, *sorted({f for f, _ in TEMPLATES}))
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    # the background as a whole weighs as much as two families, however many rows it has
    weight = F.when(F.col("family") != NONE, 1.0).otherwise(2 * len(used) / (len(families) - 1) / max(1, rows.filter(F.col("family") == NONE).count()))
    data = vectors.transform(rows).select("features", label.alias("label"), weight.alias("weight")).coalesce(1).cache()
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, elasticNetParam=0.5, maxIter=80, standardization=False).fit(data)
    data.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    weights = {g: tuple(float(w) for w in matrix[:, i]) for i, g in enumerate(vectors.vocabulary) if any(matrix[:, i])}
    model = Model(families, weights, tuple(map(float, fitted.interceptVector)), 0.0)
    tests = notices(spark, held_out).withColumn("words", words("paragraph")).select("family", grams("words").alias("grams")).collect()
    right = sorted(model.probabilities(r["grams"])[r["family"]] for r in tests)
    return Model(families, weights, model.intercepts, max(0.3, right[int(len(right) * (1 - RECALL))]))


def judged(candidates: DataFrame, model: Model) -> DataFrame:
    """row_key, place, best (p, family), ok (confirmed), like (licence-like) of word lists (row_key, place, words) with a word of the model."""
    spark = candidates.sparkSession
    triggers = sorted({rarest(g) for g in model.weights})
    candidates = candidates.filter(F.arrays_overlap("words", F.array(*map(F.lit, triggers)).cast("array<string>")))
    parts = [F.struct(F.lit(g).alias("gram"), F.array(*map(F.lit, w)).alias("w")) for g, w in sorted(model.weights.items())]
    weights = spark.range(1).select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    grammed = candidates.select("row_key", "place", F.array_distinct("words").alias("own"), F.explode(grams("words")).alias("gram"))
    hits = grammed.join(F.broadcast(weights), "gram")
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(len(model.families))]
    scored = hits.dropDuplicates(["row_key", "place", "gram"]).groupBy("row_key", "place").agg(F.first("own").alias("own"), *sums)
    logits = [F.col(f"s{i}") + F.lit(b) for i, b in enumerate(model.intercepts)]
    top = F.greatest(*logits)
    total = sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top))
    best = F.greatest(*[F.struct(F.round(F.exp(x - top) / total, 6).alias("p"), F.lit(f).alias("family")) for f, x in zip(model.families, logits, strict=True)])
    scored = scored.withColumn("best", best)
    confirmed = F.lit(False)
    for family, text in TEMPLATES:
        own = sorted({w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()})
        share = F.size(F.array_intersect("own", F.array(*map(F.lit, own))))
        confirmed = confirmed | ((F.col("best.family") == family) & (share >= CONFIRM * len(own)))
    sure = (F.col("best.family") != NONE) & (F.col("best.p") >= model.threshold)
    return scored.select("row_key", "place", "best", (sure & confirmed).alias("ok"), (F.col("best.family") != NONE).alias("like"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row's licence family, from its lines and from notices wrapped over several; needs doc_id and text, reads no other column.

    A line or window of lines (see wrapped) is a paragraph here; its n-grams meet the model's weights in an equi-join (the weights are at most VOCABULARY rows, so they are
    broadcast); only paragraphs with a word of the model get that far. The softmax names a family, or the unknown class
    below the calibrated threshold, and a template of that family must be held to CONFIRM of its words.

    Returns doc_id, n_paragraphs (lines), n_license (confirmed lines and wrapped notices), n_unknown (licence-like lines
    that were not confirmed by themselves), family
    (that of the surest confirmed paragraph; ties: the first paragraph; else null), families (all of them, sorted and
    comma-joined; else empty) and confidence (six decimals; else 0). Null and empty texts have no paragraphs; rows with
    equal doc_id and text get equal results; an empty table gives an empty one. Texts are scanned whole.
    """
    model = model or fit(docs)
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")), F.lit(0)).cast("long").alias("n_paragraphs"))
    rows = rows.withColumn("n_paragraphs", F.greatest("n_paragraphs", F.lit(0).cast("long")))
    texts = docs.select("doc_id", "text")
    lines = stored(judged(paragraphs(texts).withColumn("words", words("paragraph")), model), "licence-lines")
    confirmed = lines.filter("ok").groupBy("row_key").agg(F.collect_set("place").alias("places"))
    # a wrapped notice is held by several windows in a row: the first counts
    blocks = stored(judged(wrapped(texts, confirmed), model), "licence-blocks").filter("ok")  # stored: a filter below would repeat the softmax
    before = F.lag("place").over(W.partitionBy("row_key", "best.family").orderBy("place"))
    blocks = blocks.withColumn("counts", F.coalesce(F.col("place") - before > 1, F.lit(True)))
    everything = lines.withColumn("counts", F.col("ok")).unionByName(blocks)
    found = everything.groupBy("row_key").agg(
        F.count_if("counts").alias("n_license"),
        F.count_if(F.col("like") & ~F.col("ok")).alias("n_unknown"),
        F.max_by("best", F.when(F.col("ok"), F.struct("best.p", -F.col("place")))).alias("best"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("best.family")))), ",").alias("families"),
    )
    none = F.lit(0).cast("long")
    return rows.join(found, "row_key", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n_license", none).alias("n_license"), F.coalesce("n_unknown", none).alias("n_unknown"),
        F.col("best.family").alias("family"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("best.p", F.lit(0.0)).alias("confidence"),
    )


def rarest(gram: str) -> str:
    """The word of an n-gram that stands for it in the first look: the longest."""
    return max(gram.split(" "), key=lambda w: (len(w), w))
