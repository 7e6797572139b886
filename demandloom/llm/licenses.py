"""Licence scan by a trained paragraph classifier.

A text is one sequence of words: line breaks, blank lines and comment marks are no words, so wrapped notices are found like
those in one line. Its paragraph windows (24 words, every 12 words) become sparse sets of the 1- and 2-grams that notices
have, and an L1-regularised multinomial logistic regression tells the licence families and an unknown class apart. It
is trained on whole notices, also with words left out, that stand in windows of the corpus's own text; on windows of the
corpus without a notice; and on near misses, a third of a notice in such a window. A family is predicted for a window if its
probability is at least what one in a thousand held-out windows of the corpus reaches, so that the unknown class is
calibrated on the corpus. A prediction is confirmed by comparison with the notices of that family: a passage is the shortest
stretch about the window that holds the most 3-grams of a notice within its reach, and 60 % of them at least. Where
passages of two families share words, the likest is taken. All of it is DataFrame functions and MLlib; no Python
runs on the executors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.session import stored

# Usual notices of licence families.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "Licensed under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
}

NAMES = list(NOTICES)
SPAN, STRIDE = 24, 12  # words of a window, and from one to the next
SAMPLE_DOCUMENTS = 2000  # default number of documents whose windows may teach the unknown class
SAMPLE_PARAGRAPHS = 8000  # default number of such windows
SAMPLE_TASKS = 32  # over which the sampled documents are dealt
COPIES = 32  # of each notice, all but the first with words left out; every fourth is held out
SHARED = 0.6  # least share of a notice's 3-grams for confirmation
LEAST = 0.02  # least probability of a predicted family, whatever the calibration


def words_of(text: Column) -> Column:
    """Lower-case words: letters and digits, with . + - inside them."""
    parts = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda w: F.btrim(w, F.lit(".+-")))
    return F.filter(parts, lambda w: w != "")


def plain_words(text: str) -> list[str]:
    """``words_of`` for the notices."""
    return [w for x in re.split(r"[^\w.+-]+", text.lower()) if (w := x.strip(".+-"))]


def notice_grams(notice: str) -> list[str]:
    """Distinct word 3-grams of a notice; one of two words is a gram as a whole."""
    words = plain_words(notice)
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))})


def reach(notice: str) -> int:
    """Words within which a notice has to stand."""
    return 2 * len(plain_words(notice)) + 16


MOST = max(reach(n) for v in NOTICES.values() for n in v)
_SPLIT = [plain_words(n) for v in NOTICES.values() for n in v]
SINGLE = sorted({w for ws in _SPLIT for w in ws})
DOUBLE = sorted({f"{a} {b}" for ws in _SPLIT for a, b in zip(ws, ws[1:])})
GRAMS = {k: sorted({g for v in NOTICES.values() for n in v for g in notice_grams(n) if g.count(" ") == k - 1}) for k in (2, 3)}
FIRST = {k: sorted({g.split(" ")[0] for g in grams}) for k, grams in (("double", DOUBLE), (2, GRAMS[2]), (3, GRAMS[3]))}


def marks(words: Column) -> Column:
    """For each word: null if no notice has it, else its place, the word, the pair and the notice gram that start here.

    A gram of two words is no start of one of three, so that a place starts one gram at most.
    """

    def starts(w: Column, gram: Column, first: list[str], grams: list[str]) -> Column:
        return F.when(w.isin(first), F.when(gram.isin(grams), gram))

    def mark(w: Column, i: Column) -> Column:
        double = F.concat_ws(" ", w, F.get(words, i + 1))
        three = F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))
        gram = F.coalesce(starts(w, three, FIRST[3], GRAMS[3]), starts(w, double, FIRST[2], GRAMS[2]))
        return F.when(w.isin(SINGLE), F.struct(i.alias("at"), w.alias("word"), starts(w, double, FIRST["double"], DOUBLE).alias("double"), gram.alias("gram")))

    return F.transform(words, mark)


def _kept(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with one more column, computed once: an explode is not pushed into what uses it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def terms(found: Column) -> Column:
    return F.concat(F.transform(found, lambda m: m["word"]), F.array_compact(F.transform(found, lambda m: m["double"])))


def windows(rows: DataFrame) -> DataFrame:
    """key, low (first word), terms and hits (notice grams within reach) of each window that has a word of a notice.

    ``rows``: key, text. Any other window holds nothing of any notice and is unknown.
    """
    rows = _kept(rows.where("text IS NOT NULL").select("key", "text"), "words", words_of(F.col("text"))).drop("text")
    rows = _kept(rows, "marks", marks(F.col("words"))).drop("words").where(F.exists("marks", lambda m: m.isNotNull()))
    rows = _kept(rows, "licensed", F.exists("marks", lambda m: m["gram"].isNotNull()))

    def window(j: Column) -> Column:
        low = j * STRIDE
        around = F.greatest(low - MOST, F.lit(0))
        hits = F.filter(F.slice("marks", around + 1, low + SPAN + MOST - around), lambda m: m["gram"].isNotNull())
        none = F.array().cast("array<struct<at:int,gram:string>>")
        return F.struct(
            low.alias("low"),
            terms(F.array_compact(F.slice("marks", low + 1, F.lit(SPAN)))).alias("terms"),
            F.when(F.col("licensed"), F.transform(hits, lambda m: F.struct(m["at"].alias("at"), m["gram"].alias("gram")))).otherwise(none).alias("hits"),
        )

    made = F.transform(F.sequence(F.lit(0), F.expr(f"CAST((size(marks) - 1) DIV {STRIDE} AS INT)")), window)
    return rows.select("key", F.explode(made).alias("w")).select("key", "w.*").where(F.size("terms") > 0)


def passages(rows: DataFrame) -> DataFrame:
    """``rows`` (hits, k: family, from 1, and any others) for each passage of a notice of that family: start, end, similarity.

    Passages of one notice from one row do not overlap. Positions are word numbers, from 0.
    """
    spark = rows.sparkSession
    notices = [(k + 1, notice_grams(n), reach(n)) for k, v in enumerate(NOTICES.values()) for n in v]
    rows = rows.join(F.broadcast(spark.createDataFrame(notices, "k int, own array<string>, reach int")), "k")  # as many rows as notices
    rows = _kept(rows, "held", F.filter("hits", lambda h: F.array_contains("own", h["gram"]))).drop("hits")
    rows = rows.where(F.size(F.array_distinct(F.transform("held", lambda h: h["gram"]))) >= SHARED * F.size("own"))

    def window(h: Column, i: Column) -> Column:
        """From this hit to the last one within reach that brings a gram not seen before."""
        near = F.filter(F.slice("held", i + 1, F.col("reach")), lambda x: x["at"] < h["at"] + F.col("reach"))
        none = F.struct(F.array().cast("array<string>").alias("seen"), h["at"].alias("last"))
        found = F.aggregate(near, none, lambda a, x: F.when(F.array_contains(a["seen"], x["gram"]), a).otherwise(F.struct(F.array_append(a["seen"], x["gram"]).alias("seen"), x["at"].alias("last"))))
        return F.struct(h["at"].alias("start"), found.alias("found"))

    rows = _kept(rows, "windows", F.transform("held", window)).drop("held", "reach")
    kind = "array<struct<start:int,end:int,similarity:double>>"
    made = F.transform("windows", lambda w: F.struct(w["start"].alias("start"), (w["found"]["last"] + F.array_max(F.transform(w["found"]["seen"], lambda g: F.size(F.split(g, " "))))).alias("end"), (F.size(w["found"]["seen"]) / F.size("own")).alias("similarity")))
    rows = _kept(rows, "made", F.filter(made, lambda w: w["similarity"] >= SHARED).cast(kind)).drop("windows", "own").where(F.size("made") > 0)

    def best(kept: Column, w: Column) -> Column:
        """Of windows that overlap, the likest, then the shortest."""
        last = F.element_at(kept, -1)
        better = (w["similarity"] > last["similarity"]) | ((w["similarity"] == last["similarity"]) & (w["end"] - w["start"] < last["end"] - last["start"]))
        return F.when((F.size(kept) == 0) | (w["start"] >= F.get(kept, F.size(kept) - 1)["end"]), F.array_append(kept, w)).when(better, F.array_append(F.slice(kept, F.lit(1), F.size(kept) - 1), w)).otherwise(kept)

    rows = rows.withColumn("p", F.explode(F.aggregate("made", F.array().cast(kind), best))).drop("made")
    return rows.select(*[c for c in rows.columns if c != "p"], "p.*")


@dataclass(frozen=True)
class Classifier:
    """Class 0 is unknown, then the families in order; ``least``: the probability that predicts a family."""

    features: CountVectorizerModel
    model: LogisticRegressionModel
    least: float

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (terms) with probabilities, an array from class 0 on."""
        scored = self.model.transform(self.features.transform(rows))
        return scored.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def _vocabulary() -> CountVectorizerModel:
    return CountVectorizerModel.from_vocabulary([*SINGLE, *DOUBLE], inputCol="terms", outputCol="features").setBinary(True)


def _background(docs: DataFrame, documents: int, paragraphs: int) -> DataFrame:
    """Windows (words) of a sample of whole texts, without those that hold a notice."""
    texts = docs.where("text IS NOT NULL").select("text", F.xxhash64("text").alias("h"))
    last = texts.select("h").distinct().orderBy("h").limit(documents).agg(F.max("h").alias("h")).select("h").scalar()  # hashes travel, not texts
    some = texts.where(F.col("h") <= last).groupBy("h").agg(F.any_value("text").alias("text")).repartition(SAMPLE_TASKS, "h")
    rows = _kept(some, "all", words_of(F.col("text"))).drop("text").where(F.size("all") > 0)
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"CAST((size(all) - 1) DIV {SPAN} AS INT)")), lambda j: F.slice("all", j * SPAN + 1, F.lit(SPAN)))
    rows = rows.select(F.explode(cut).alias("words"))
    rows = _kept(rows.orderBy(F.xxhash64("words", F.lit(1))).limit(paragraphs).repartition(SAMPLE_TASKS, F.xxhash64("words")), "marks", marks(F.col("words")))
    hit = F.array_compact(F.transform("marks", lambda m: m["gram"]))
    own = F.array(*[F.array(*map(F.lit, notice_grams(n))) for v in NOTICES.values() for n in v])
    noted = F.exists(own, lambda g: F.size(F.array_intersect(g, F.col("hit"))) >= SHARED * F.size(g))
    return _kept(rows, "hit", hit).where((F.size("hit") == 0) | ~noted).select("words")


def _examples(spark: SparkSession, unknown: DataFrame) -> DataFrame:
    """label, terms, part (0: to learn from, 1: held out), natural (a window of the corpus as it is)."""
    notices = [(float(k + 1), n) for k, v in enumerate(NOTICES.values()) for n in v]
    rows = spark.createDataFrame([(m, label, n) for m, (label, n) in enumerate(notices)], "m int, label double, line string")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("all", words_of(F.col("line")))
    whole = F.filter("all", lambda w, i: (F.col("copy") == 0) | (F.pmod(F.xxhash64(F.col("copy"), i, w), F.lit(10)) > 0))
    third = F.ceil(F.size("all") / 3).cast("int")
    begin = F.pmod(F.xxhash64("copy", "m"), F.size("all") - third + 1).cast("int")
    near = rows.where(F.size("all") >= 8).select("m", "copy", F.lit(0.0).alias("label"), F.slice("all", begin + 1, third).alias("notice"))
    rows = rows.select("m", "copy", "label", whole.alias("notice")).unionByName(near)
    # a long notice is seen in windows, as in a text: the copy's number says which part
    parts = F.greatest(F.ceil((F.size("notice") - SPAN) / STRIDE), F.lit(0)).cast("int") + 1
    rows = rows.withColumn("notice", F.slice("notice", F.pmod(F.col("copy"), parts) * STRIDE + 1, F.lit(SPAN)))
    slots = len(notices) * COPIES
    beside = unknown.groupBy(F.pmod(F.xxhash64("words"), F.lit(slots)).cast("int").alias("slot")).agg(F.min("words").alias("beside"))
    rows = rows.withColumn("slot", F.col("m") * COPIES + F.col("copy")).join(beside, "slot", "left").withColumn("beside", F.coalesce("beside", F.array().cast("array<string>")))
    room = SPAN - F.size("notice")
    before = F.pmod(F.xxhash64("slot"), room + 1).cast("int")
    rows = rows.select("label", F.concat(F.slice("beside", F.lit(1), before), "notice", F.slice("beside", before + 1, room - before)).alias("words"), (F.col("copy") % 4 == 3).cast("int").alias("part"), F.lit(False).alias("natural"))
    rows = rows.unionByName(unknown.select(F.lit(0.0).alias("label"), "words", F.pmod(F.xxhash64("words", F.lit(2)), F.lit(2)).cast("int").alias("part"), F.lit(True).alias("natural")))
    rows = _kept(rows, "marks", F.array_compact(marks(F.col("words")))).drop("words")
    return rows.select("label", terms(F.col("marks")).alias("terms"), "part", "natural")


def train(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_paragraphs: int = SAMPLE_PARAGRAPHS) -> Classifier:
    """Classifier of windows; the samples bound what of ``docs`` (text) teaches the unknown class.

    A family needs the probability that one in a thousand held-out windows of the corpus reaches, but no more than 99 in a
    hundred held-out notices have, and no less than LEAST.
    """
    rows = stored(_examples(docs.sparkSession, stored(_background(docs, sample_documents, sample_paragraphs), "background")), "examples")
    features = _vocabulary()
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, elasticNetParam=1.0, standardization=False).fit(features.transform(rows.where("part = 0")).select("label", "features"))
    seen = Classifier(features, model, 0.0).probabilities(rows.where("part = 1"))
    family = F.array_max(F.slice("probabilities", 2, len(NAMES)))
    own = F.get("probabilities", F.col("label").cast("int"))
    unknown = seen.where("natural").agg(F.percentile_approx(family, 0.999, 100_000).alias("p")).first().p
    known = seen.where("label > 0").agg(F.percentile_approx(own, 0.01, 100_000).alias("p")).first().p
    return Classifier(features, model, max(LEAST, min(unknown or 0.0, known)))


def scan(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_paragraphs: int = SAMPLE_PARAGRAPHS, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, license, n_notices, families, probability, similarity for each row of ``docs`` (doc_id, text).

    ``license``: the family of the surest confirmed passage, null if there is none; then n_notices is 0, families empty and the
    scores null. Passages of one family that overlap are one notice. A null or empty text has none. Rows of one doc_id (or
    without any) share their notices. Ties go to the greater similarity, then the first name. An empty table gives an empty
    one; extra columns are left out. The samples bound what teaches the unknown class, not what is scanned.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    classifier = classifier or train(docs, sample_documents, sample_paragraphs)
    # a row of the table is told apart, as positions are its own
    keyed = docs.select(F.struct("doc_id", F.monotonically_increasing_id().alias("row")).alias("key"), "text")
    scored = classifier.probabilities(windows(keyed))
    predicted = F.filter(F.transform(F.slice("probabilities", 2, len(NAMES)), lambda p, i: F.struct((i + 1).alias("k"), p.alias("probability"))), lambda x: x["probability"] >= classifier.least)
    predicted = scored.select("key", "low", "hits", F.explode(predicted).alias("x")).select("key", "low", "hits", "x.*").where(F.size("hits") > 0)
    sure = passages(predicted).where((F.col("start") < F.col("low") + SPAN) & (F.col("end") > F.col("low")))
    sure = sure.groupBy("key", "k", "start", "end").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
    near = F.collect_list(F.struct("k", "start", "end", "similarity")).over(Window.partitionBy("key").orderBy("start").rangeBetween(-MOST - 3, MOST + 3))
    likelier = F.exists("near", lambda x: (x["k"] != F.col("k")) & (x["start"] < F.col("end")) & (x["end"] > F.col("start")) & (x["similarity"] > F.col("similarity")))
    sure = sure.withColumn("near", near).where(~likelier)
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    islands = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end"))), none, lambda a, x: F.struct(F.when(x["start"] >= a["end"], a["n"] + 1).otherwise(a["n"]).alias("n"), F.greatest(a["end"], x["end"]).alias("end")), lambda a: a["n"])
    sure = sure.groupBy("key", "k").agg(islands.alias("n"), F.max(F.struct("probability", "similarity")).alias("top"), F.max("similarity").alias("similarity"))
    sure = sure.select("key.doc_id", F.element_at(F.array(*map(F.lit, NAMES)), F.col("k")).alias("family"), "n", "top", "similarity")
    best = F.max_by("family", F.struct("top", -F.array_position(F.array(*map(F.lit, sorted(NAMES))), F.col("family"))))
    found = sure.groupBy("doc_id").agg(best.alias("license"), F.sum("n").alias("n_notices"), F.sort_array(F.collect_set("family")).alias("families"), F.max("top.probability").alias("probability"), F.max("similarity").alias("similarity")).withColumnRenamed("doc_id", "of")
    joined = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), "probability", "similarity")
