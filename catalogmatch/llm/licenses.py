"""License scans: a trained paragraph classifier with template comparison, in DataFrame and Spark ML functions only.

A paragraph is a stretch between empty lines; comment leaders are taken off its lines and its line breaks are spaces.
Paragraphs are read in windows of ``WINDOW`` words that overlap. Features are word n-grams of a vocabulary learnt from
variants of the notices, each with a telling word: one of the notices that at most ``TELLING`` of all different windows of
the corpus hold, licences left out. A window without telling words has no features at all, so such windows are one training
row that counts for all of them, and only the others are scored. A sparse multinomial logistic regression over the families and
an unknown class is trained on variants of the notices (words left out, half of them amid prose) against all different
windows of the corpus, which weigh ``PROSE`` rows together at most, and sentences that merely speak of licences. A first pass
over all texts finds those with a window that is likelier a licence than the calibrated threshold. Their windows and single lines are then classified by family and compared with the notices of all families: each
family is confirmed of whose notices enough stands there, with the version it names, and no family alike fits as well. Windows and lines of no
confirmed family count as unconfirmed.

The threshold of the unknown class comes from the quarter of the corpus windows that the model has not seen and from families
that a second model was trained without.

Results in special cases: null and empty texts have no findings; repeated rows give equal results; of equal lines each
counts; an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import re
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogmatch.llm.common import sized, table, written

MAX_GRAM = 2
TELLING = 0.01
#: Training rows that the corpus windows weigh together at most: they are all learnt from, but do not outweigh the notices.
PROSE = 2_000
#: Words of a window, and from where to where the next begins.
WINDOW, STEP = 384, 256
#: Notices by family.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("ISC", "SPDX-License-Identifier: ISC"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, EUPL, version 1.2."),
    ("EUPL-1.2", "SPDX-License-Identifier: EUPL-1.2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under the Creative Commons CC0 1.0 Universal dedication."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved."),
    ("proprietary", "No part of this publication may be reproduced without the prior written permission of the copyright owner."),
    (
        "MIT",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    ),
    ("MIT", "or MIT license"),
    ("Apache-2.0", "or Apache License, Version 2.0"),
    (
        "LGPL-3.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("Artistic-2.0", "SPDX-License-Identifier: Artistic-2.0"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
]
#: Families whose notices resemble each other; of each such group one is confirmed in a window at most.
ALIKE = {"gnu": ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0"), "bsd": ("BSD-3-Clause", "BSD-2-Clause"), "cc": ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
#: Of two families of a group whose similarities lie so near, none is confirmed.
MARGIN = 0.02
#: Sentences with licence words that name no licence.
OTHER = [
    "She renewed her driving license at the office last week.",
    "The license plate of the car was covered with mud.",
    "You need a fishing licence before you go to the lake.",
    "The board revoked the license of the restaurant.",
    "Copyright law differs between countries.",
    "They asked for permission to enter the building.",
    "The warranty of the machine ends after two years.",
    "A creative idea from the commons of the village.",
    "The apache helicopter landed near the village.",
    "Redistribution of wealth was the topic of the debate.",
    "The general public was free to use the library.",
    "All the rights of the people were reserved for the court.",
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *dict.fromkeys(f for f, _ in NOTICES)]
#: Leaders of comment lines.
LEADER = r"(?m)^[\x20\t]*(?:/{2,}|/?\*+/?|#+|;+|-{2,}|%+|<!--|>+|dnl\b|REM\b)"
EMPTY = r"\n[\x20\t\r]*(?:\n[\x20\t\r]*)+"
#: What stands between words: ``[^a-z0-9.-]+|\.(?![0-9])``, its class written as ranges, which the JVM matches faster.
BETWEEN = r"[\x00-,/:-`{-\x{10FFFF}]+|\.(?![0-9])"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: F.length(w) > 0)


def _grams(words: Column, most: int = MAX_GRAM, least: int = 1) -> Column:
    """Distinct word n-grams."""
    ends = lambda n: (F.slice(words, k + 1, F.greatest(F.lit(0), F.size(words) - n + 1)) for k in range(n))
    whole = lambda n: words if n == 1 else functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(" "), y)), ends(n))
    of = lambda n: F.when(F.size(words) >= n, whole(n)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in range(least, most + 1))))


def _literal_rows(spark: SparkSession, rows: list[tuple[str, str]], a: str, b: str) -> DataFrame:
    """A small table of fixed strings."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in rows))))


def _windows(words: Column) -> Column:
    """Slices of ``WINDOW`` words, each ``STEP`` after the one before; shorter paragraphs are one."""
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - WINDOW) / STEP)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(words, k * STEP + 1, F.lit(WINDOW)))


def _holds(telling: list[str] | None) -> Column:
    """Whether ``words`` hold a telling word."""
    return F.arrays_overlap("words", F.array(*map(F.lit, telling))) if telling else F.size("words") > 0


def paragraph_windows(docs: DataFrame, text_col: str = "text", telling: list[str] | None = None) -> DataFrame:
    """(key, words) of every window of every paragraph (that holds a telling word, if these are given); ``key`` is equal for equal texts."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), LEADER, "")
    parts = docs.select(_key(text_col).alias("key"), F.explode(F.split(text, EMPTY)).alias("part"))
    whole = parts.select("key", _words(F.col("part")).alias("words"))
    if telling:  # a filter before the windows cuts the words once more: it pays where few paragraphs pass
        whole = whole.where(_holds(telling))
    return whole.select("key", F.explode(_windows(F.col("words"))).alias("words")).where(_holds(telling))


def _key(text_col: str) -> Column:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.xxhash64(text).alias("h"), F.crc32(text).alias("c"), F.length(text).alias("n"))


def paragraphs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, first, last, words): the paragraphs' windows and their single lines, with the lines they cover (from 0)."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), LEADER, "")
    texts = docs.select(_key(text_col).alias("key"), text.alias("text")).groupBy("key").agg(F.min("text").alias("text"))
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("line", "one"))
    upto = Window.partitionBy("key").orderBy("line")
    lines = lines.withColumn("words", _words(F.col("one"))).withColumn("part", F.count_if(F.trim(F.col("one"), F.lit(" \t\r")) == "").over(upto)).where("size(words) > 0")
    lines = written(lines.select("key", "part", "line", "words"), "license-lines")
    whole = lines.groupBy("key", "part").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("x"))  # one paragraph's words
    whole = whole.where("size(x) > 1").select("key", F.col("x")[0]["line"].alias("first"), F.element_at("x", -1)["line"].alias("last"), F.flatten("x.words").alias("words"))
    both = lines.select("key", F.col("line").alias("first"), F.col("line").alias("last"), "words").unionByName(whole)
    return both.select("key", "first", "last", F.explode(_windows(F.col("words"))).alias("words"))


def _variants(notices: DataFrame, n: int) -> DataFrame:
    """Each notice ``n`` times: once whole, else with every word left out with a chance of 1 in 8."""
    rows = notices.select("family", _words(F.col("text")).alias("words"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    keep = F.filter("words", lambda w, i: (F.col("variant") == 0) | (F.pmod(F.xxhash64(w, i, "variant"), F.lit(8)) > 0))
    return rows.select("family", "variant", keep.alias("words"))


def _notice_words() -> list[str]:
    """The different words of the notices."""
    return sorted({w for _, text in NOTICES for w in _cut(text)})


def _cut(text: str) -> list[str]:
    """``_words`` of a notice."""
    return [w for w in re.split(r"[^a-z0-9.-]+|\.(?![0-9])", text.lower()) if w]


def _pairs(text: str) -> list[tuple[str, str]]:
    """The different pairs of words of a notice."""
    return list(dict.fromkeys(itertools.pairwise(_cut(text))))


def _key_words() -> list[str]:
    """Words of which a window holds one if half of any notice's pairs stand in it: fewer than half of the pairs have none, long words first."""
    keys: set[str] = set()
    for _, text in NOTICES:
        pairs = _pairs(text)
        while 2 * len(left := [x for x in pairs if keys.isdisjoint(x)]) >= len(pairs):
            keys.add(max((w for x in left for w in x), key=lambda w: (len(w), w)))
    return sorted(keys)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _corpus_windows(docs: DataFrame, text_col: str, around: int) -> DataFrame:
    """(h, fold, held, around) of all different windows that are no licence: the notices' words in them, and the words of some.

    Of windows only their hash and the notices' words are shuffled. The words of about ``around`` or more windows stay, dealt by hash over
    the corpus.
    """
    every = max(1, docs.count() // (2 * around))
    may_be = F.when(_holds(_key_words()), F.col("words")).otherwise(_strings([]))  # most windows need no comparison
    rows = paragraph_windows(docs, text_col).select(F.xxhash64("words").alias("h"), F.col("words").alias("all"), may_be.alias("words"))
    rows = _compared(rows, None).where("similarity < 0.5")
    held = F.array_join(F.array_intersect("all", _strings(_notice_words())), " ")
    kept = F.when(F.pmod(F.xxhash64("h"), F.lit(every)) == 0, F.col("all"))
    rows = rows.select("h", _fold(F.col("h")).alias("fold"), held.alias("held"), kept.alias("around"))
    return written(rows.dropDuplicates(["h"]), "license-corpus")


def _fold(h: Column) -> Column:
    """A quarter of the windows, fold 3, is not learnt from."""
    return F.pmod(F.xxhash64(h, F.lit(1)), F.lit(4)).cast("int")


def _training_rows(corpus: DataFrame, variants: int) -> DataFrame:
    """(family, variant, words, grams): variants of the notices, half of them amid prose, and of the sentences that name no licence.

    Each that stands amid prose needs one window around it, so that their number is fixed.
    """
    spark = corpus.sparkSession
    known = _variants(_literal_rows(spark, NOTICES, "family", "text"), variants)
    other = _variants(_literal_rows(spark, [(UNKNOWN, x) for x in OTHER], "family", "text"), variants)
    prose = corpus.where("size(around) > 0").orderBy("h").limit(_mixed(variants)).select("around", (F.row_number().over(Window.orderBy("h")) - 1).alias("n"))
    prose = written(prose, "license-prose")
    count = max(1, prose.count())
    amid = known.withColumn("n", F.pmod(F.xxhash64("family", "words", "variant"), F.lit(count))).join(prose, "n", "left")
    at = F.pmod(F.xxhash64("words", "variant", F.lit(1)), F.lit(48)).cast("int")
    mixed = F.concat(F.slice("around", 1, at), "words", F.slice("around", at + 1, F.lit(160)))
    known = amid.select("family", "variant", F.when((F.col("variant") % 2 == 1) & F.col("around").isNotNull(), mixed).otherwise(F.col("words")).alias("words"))
    return written(known.unionByName(other).withColumn("grams", _grams(F.col("words"))), "license-rows")


def _mixed(variants: int) -> int:
    """The variants of notices that stand amid prose."""
    return len(NOTICES) * (variants // 2)


def _telling_words(corpus: DataFrame) -> list[str]:
    """Words of the notices that few of the corpus windows hold."""
    most = TELLING * corpus.count()
    often = corpus.select(F.explode(F.split("held", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > most)
    often = {r.word for r in often.collect()}  # words of the notices
    return [w for w in _notice_words() if len(w) > 1 and w not in often]


class Licenses(NamedTuple):
    """A fitted scan. ``windows`` (key, h, grams) are those of the corpus that hold a telling word, with their n-grams of the vocabulary."""

    vocabulary: CountVectorizerModel
    model: LogisticRegressionModel
    threshold: float
    telling: list[str]
    windows: DataFrame


def fit_licenses(docs: DataFrame, text_col: str = "text", variants: int = 24) -> Licenses:
    """Learns from all windows of ``docs``: which words tell, the negatives and the threshold."""
    corpus = _corpus_windows(docs, text_col, _mixed(variants))
    rows = _training_rows(corpus, variants)
    telling = _telling_words(corpus)
    learnt = CountVectorizer(inputCol="grams", outputCol="features", minDF=6, vocabSize=1 << 15, binary=True).fit(rows.where(F.col("family") != UNKNOWN))
    kept = [g for g in learnt.vocabulary if not set(telling).isdisjoint(g.split(" "))]
    vocabulary = CountVectorizerModel.from_vocabulary(kept, inputCol="grams", outputCol="features").setBinary(True)
    windows = paragraph_windows(docs, text_col, telling).select("key", F.xxhash64("words").alias("h"), _grams(F.col("words")).alias("grams"))
    windows = written(windows.select("key", "h", F.array_intersect(_strings(sorted(kept)), F.col("grams")).alias("grams")), "license-windows")

    # all windows of the corpus by their features; those without a telling word have none
    with_words = corpus.select("h", "fold").join(windows.dropDuplicates(["h"]).select("h", "grams"), "h", "left")
    prose = with_words.groupBy("fold", F.coalesce("grams", _strings([])).alias("grams")).agg(F.count("*").alias("n"))
    total = corpus.count()
    prose = prose.select(F.lit(UNKNOWN).alias("family"), F.col("fold").alias("variant"), "grams", F.col("n").alias("times"), (F.col("n") * min(1.0, PROSE / max(1, total))).alias("weight"))
    others = F.when(F.col("family") == UNKNOWN, F.lit(max(1, round(total / PROSE)))).otherwise(1).cast("long")
    rows = rows.select("family", "variant", "grams", others.alias("times"), F.lit(1.0).alias("weight")).unionByName(prose)
    label = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")).cast("double") - 1
    features = written(vocabulary.transform(rows.withColumn("label", label)).select("family", "variant", "times", "weight", "label", "features"), "license-features")
    learn = lambda part: LogisticRegression(maxIter=60, regParam=2e-3, family="multinomial", weightCol="weight").fit(part)
    seen = features.where("variant % 4 <> 3")
    model = learn(seen)
    left_out = FAMILIES[2::3]
    partial = learn(seen.where(~F.col("family").isin(left_out)))
    likely = 1 - F.element_at(vector_to_array("probability"), 1)
    unseen = model.transform(features.where((F.col("variant") % 4 == 3) & (F.col("family") == UNKNOWN)))
    strange = partial.transform(features.where(F.col("family").isin(left_out) & (F.col("variant") == 0)))
    high = unseen.agg(F.percentile(F.round(likely, 4), F.lit(0.995), F.col("times"))).first()[0] or 0.5  # 10,001 values at most
    top = strange.agg(F.percentile(F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES))), F.lit(0.5))).first()[0] or 0.5
    return Licenses(vocabulary, model, min(0.9, max(0.5, high, top)), telling, windows)


def _compared(rows: DataFrame, family: str | None = "family") -> DataFrame:
    """``rows`` (words) with the largest share of a notice (of that family, or of any) that stands in the words."""
    spark = rows.sparkSession
    notices = _literal_rows(spark, NOTICES, "of", "text").select("of", _grams(_words(F.col("text")), 2, 2).alias("notice"))
    notices = notices.groupBy(F.col("of") if family else F.lit(None).cast("string").alias("of")).agg(F.collect_list("notice").alias("notices"))
    share = F.array_max(F.transform("notices", lambda n: F.size(F.array_intersect(n, F.col("pairs"))) / F.size(n)))
    share = F.when(F.size("pairs") > 0, share).otherwise(0.0)
    some = sorted({f"{a} {b}" for _, text in NOTICES for a, b in _pairs(text)})  # few of a window's pairs are in any notice
    joined = rows.withColumn("pairs", F.array_intersect(_strings(some), _grams(F.col("words"), 2, 2))).join(F.broadcast(notices), F.col(family) == F.col("of") if family else F.lit(True))  # a row per family, or one
    return joined.withColumn("similarity", share).drop("pairs", "notices", "of")


def _confirmed(rows: DataFrame, least: float) -> DataFrame:
    """``rows`` (words) with the families whose notices stand in the words, and the largest share of any notice.

    The notices of all families are compared. Versions and numbers of clauses must be in the words exactly; among families that are alike
    the best one counts, and none if another is within ``MARGIN``.
    """
    group = F.coalesce(*(F.when(F.col("of").isin(*families), name) for name, families in ALIKE.items()), F.col("of"))
    notices = _literal_rows(rows.sparkSession, NOTICES, "of", "text").withColumn("n", _words(F.col("text")))
    numbers = F.filter("n", lambda w: w.rlike(r"^[0-9][0-9.]*(-clause)?$"))
    notices = notices.select(F.struct("of", group.alias("group"), _grams(F.col("n"), 2, 2).alias("pairs"), numbers.alias("numbers")).alias("x")).agg(F.collect_list("x").alias("notices"))
    rows = rows.withColumn("pairs", _grams(F.col("words"), 2, 2)).join(F.broadcast(notices), F.lit(True))  # one row
    share = lambda n: F.size(F.array_intersect(n["pairs"], F.col("pairs"))) / F.size(n["pairs"])
    told = lambda n: F.when(F.size(F.array_except(n["numbers"], F.col("words"))) == 0, share(n)).otherwise(0.0)
    rows = rows.withColumn("told", F.transform("notices", lambda n: F.struct(told(n).alias("share"), n["of"].alias("of"), n["group"].alias("group"))))
    good = F.filter("told", lambda x: x["share"] >= least)
    rival = lambda x: F.exists("good", lambda y: (y["group"] == x["group"]) & (y["of"] != x["of"]) & (y["share"] >= x["share"] - MARGIN))
    kept = F.filter("good", lambda x: ~rival(x))
    rows = rows.withColumn("good", good).withColumn("families", F.array_distinct(F.transform(kept, lambda x: x["of"])))
    return rows.withColumn("similarity", F.array_max(F.transform("told", lambda x: x["share"]))).drop("pairs", "notices", "told", "good")


def license_findings(docs: DataFrame, text_col: str = "text", least_similarity: float = 0.6) -> DataFrame:
    """(key, first, last, family, probability, similarity, confirmed) of the windows and lines that are likely licences."""
    vocabulary, model, threshold, telling, windows = fit_licenses(docs, text_col)
    grams = lambda rows: vocabulary.transform(rows.withColumn("grams", _grams(F.col("words")))).drop("grams")
    likely = 1 - F.element_at(vector_to_array("probability"), 1)
    first = model.transform(vocabulary.transform(windows)).where(likely >= threshold).select("key").distinct()
    first = sized(written(first, "license-keys"))
    chosen = docs.join(first, _key(text_col) == F.col("key"), "left_semi")
    scored = model.transform(grams(paragraphs(chosen, text_col).where(_holds(telling)))).where(likely >= threshold)
    scored = scored.select("key", "first", "last", "words", vector_to_array("probability").alias("p")).withColumn("probability", F.array_max(F.slice("p", 2, len(FAMILIES))))
    named = scored.withColumn("family", F.element_at(F.array(*map(F.lit, FAMILIES[1:])), F.array_position(F.slice("p", 2, len(FAMILIES)), F.col("probability")).cast("int")))
    rows = _confirmed(named, least_similarity)
    some = F.size("families") > 0
    return rows.withColumn("family", F.explode(F.when(some, F.col("families")).otherwise(F.array("family")))).select("key", "first", "last", "family", "probability", "similarity", some.alias("confirmed"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_notices, licenses, n_unconfirmed, lines) of every row.

    A notice is a confirmed line, or a confirmed paragraph none of whose lines is confirmed for its family; ``lines`` are
    the line numbers (from 0) or ranges of the notices. Unconfirmed are paragraphs and lines where nothing is confirmed.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = license_findings(docs).groupBy("key", "first", "last", "family").agg(F.max("confirmed").alias("confirmed"))
    found = written(found, "license-findings")
    single = found.where("first = last AND confirmed").select("key", F.col("first").alias("line"), F.col("family").alias("of"))
    inside = (found["key"] == single["key"]) & (F.col("line") >= F.col("first")) & (F.col("line") <= F.col("last"))
    spread = found.where("first < last")
    spread = spread.where("confirmed").join(single, inside & (F.col("of") == F.col("family")), "left_anti").unionByName(spread.where("NOT confirmed").join(single, inside, "left_anti"))
    kept = found.where("first = last").unionByName(spread)
    yes = F.col("confirmed")
    place = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = F.transform(F.array_sort(F.collect_set(F.when(yes, F.struct("first", "last", place.alias("place"))))), lambda x: x["place"])
    per_text = kept.groupBy("key").agg(
        F.count_if(yes).alias("n_notices"),
        F.array_join(F.array_sort(F.collect_set(F.when(yes, F.col("family")))), ",").alias("licenses"),
        F.count_if(~yes).alias("n_unconfirmed"),
        F.array_join(listed, ",").alias("lines"),
    )
    per_text = sized(written(per_text, "license-per-text"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id", _key("text").alias("key")).join(per_text, "key", "left").select(
        "doc_id", zero("n_notices"), F.coalesce("licenses", F.lit("")).alias("licenses"), zero("n_unconfirmed"), F.coalesce("lines", F.lit("")).alias("lines")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of every document."""
    return license_report(table(spark, sf_dir, "documents"))
