"""Licence notices by a trained passage classifier, with templates to confirm what it says.

Texts are cut at blank lines into paragraphs, comment marks at the starts of lines are taken off and wrapped lines joined. The
classifier sees every paragraph; one of over ``WINDOW`` words is seen through windows of that many, each half over the one before. Word n-grams
(one to three words) of the labelled table's vocabulary make a sparse vector, and a multinomial logistic regression with an L1 share gives chances of the licence families, of
``unknown`` (about a licence, of no known family) and of ``none``; a window counts as about a licence when ``none`` has less than even chances. Such
a window's sentences are scored once more by themselves, so that a paragraph may name several families. The classifier is trained on the labelled table: the templates, cut and framed in
several ways by rule, sentences that only use such words, and ordinary ones. A held-out part of that table sets the temperature of the chances and
the least chance at which a family is believed; below it a passage is ``unknown``. A believed family is confirmed when the
window contains enough of the word pairs of one of the family's templates, else it is ``unknown`` too.

Only DataFrame, SQL and ``pyspark.ml`` functions of the JVM are used. The labelled table has a few hundred rows whatever the input.

Null and empty texts have no passages. Rows with a null doc_id and repeated rows give their own rows. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.common import text_of

UNKNOWN, NONE = "unknown", "none"
CONFIRMED = 0.5
WINDOW = 48  # words
# Comment marks and white space at the start of a line, and what closes a comment at its end.
MARKS = r"(?m)^[ \t\r]*(?:(?:/\*+|\*+/|//+!?|\*+|#+|;+|--+|%+|>+|<!--+|\.\.(?= )|dnl\b|(?:rem|REM)\b)[ \t\r]*)*|(?=[ \t\r*-])[ \t\r]*+(?:\*+/|--+>)?[ \t\r]*+$"

# Notices as their licences word them.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License 2.0", "Apache-2.0", "License: Apache 2.0", "under the terms of the Apache 2.0 license",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "MIT", "MIT License", "License: MIT", "Distributed under the MIT terms", "Lizenz: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GPL-3.0", "GPLv3", "GPLv2", "License: GPL", "Released under the GPL", "GNU General Public License",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "LGPL-2.1", "LGPLv3", "Released under the LGPL", "GNU Lesser General Public License",
    ),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "AGPL-3.0", "AGPLv3", "Released under the AGPL", "GNU Affero General Public License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD License", "BSD-3-Clause", "BSD 2-Clause", "Distributed under the BSD 3-Clause terms",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "MPL 2.0", "Under the terms of the MPL 2.0", "Released under the MPL", "Mozilla Public License",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Available under the Creative Commons Attribution License.",
        "CC BY 4.0", "CC BY 3.0", "Released under CC BY 4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "This work is released under the Creative Commons Attribution-ShareAlike 4.0 International Public License",
        "CC BY-SA 4.0", "CC BY-SA 3.0", "Released under CC BY-SA 4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Available under the Creative Commons Attribution-NonCommercial License.",
        "CC BY-NC 4.0", "CC BY-NC 3.0", "Released under CC BY-NC 4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and dedicated this work to the public domain.",
        "Released into the public domain under CC0 1.0 Universal.",
        "This work is marked with CC0 1.0 Universal, a public domain dedication by Creative Commons.",
        "CC0", "CC0 1.0", "Released under CC0",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright 2020 by the authors, all rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
ORDINARY = (
    "", "one", "The work was done by the end of the year and the results are in the file.",
    "This is the first of two parts, and it is free of charge for any person who may use it.",
    "You can use the following list of conditions to find the source of the problem, with or without help.",
    "The author of this book has made a copy of all the notes, and they are available at the library.",
    "It is not possible to say under which terms the company will deal with the public in the future.",
    "To the extent possible the project will be published in the form of a report for the foundation.",
    "The software is used in binary form by any of the users, and the version may not be the same.",
    "They were by the river for a long time, and no part of the day was lost to the general public.",
    "All of the rights of the people are in the law, subject to what the state can do.",
    "See the details on our site for the next version, 2.0 or 3.0, of the program.",
    "def main(args): return [x for x in args if x is not None]", "1 2 3 4 5 6 7 8 9 10 2.0 3.0 4.0",
    "The international community and the creative people of the commons met in the house by the park.",
    "She put the documentation and other materials in the distribution box; the clause about it came later.",
    "The patient was seen by the doctor in the clinic and given a new medicine, with the following plan.",
)
# Sentences about licences of no known family, and sentences that only use such words.
OTHERS = {
    UNKNOWN: (
        "Licensed under the Example Community License.",
        "Released under a custom license, see the terms on our site.",
        "Use of this software is governed by the license agreement between you and the company.",
        "This file is distributed under the terms of the vendor license.",
        "Copyright 2021 the authors of this work.",
        "The software is provided as is, without warranty of any kind.",
        "Licensed for personal use only.", "Licensed under the Sample Public Agreement.", "Licensed under the Vendor Covenant, version 1.",
        "Redistribution is allowed under the conditions of the agreement.",
        "ISC", "ISC License", "Released under the ISC terms", "WTFPL", "Released under the WTFPL", "EPL-2.0", "Eclipse Public License 2.0",
        "Unlicense", "This is free and unencumbered software under the Unlicense", "You may not sublicense the work",
        "Lizenz", "Dieses Werk steht unter einer freien Lizenz", "Veröffentlicht unter der Lizenz des Herstellers", "Zlib license", "Artistic License 2.0",
    ),
    NONE: (
        "The driver had lost his license the year before.",
        "She asked for permission to leave the room early.",
        "The table was reserved for two people near the window.",
        "Every new car has a warranty of two years.",
        "Apache helicopters were seen over the valley.",
        "The licensed pharmacist explained how to take the medicine.",
        "He studied copyright law for a term and then gave it up.",
        "They redistributed the food among the villages.",
        "A fishing licence costs ten euros in this region.",
        "The police had a warrant to search the house.",
        "The park is in the public domain of the city.",
        "Mozilla held a conference in the spring.",
        "He was shy and reserved, and rarely spoke.",
        "Without permission nobody enters the laboratory.",
        "Her licence plate was covered in mud.",
        "The doctor is licensed to practise in two states.",
        "He studied physics at MIT and works at a software company.", "Wir fahren mit der Bahn nach Hause.", "Er kam mit dem Hund und mit den Kindern.", "Von und mit ihr war die Rede.", "Das ist ein Haus mit Garten, und mit Blick auf den Park.", "Researchers at MIT published the results.",
        *ORDINARY,
    ),
}
FRAMES = (
    "{}", "note that {}", "{} see also the notes below", "# {}", "// {} for more please ask", "in short {} thank you",
    "They met in the house by the park. {} The results are in the report of the year.", "The patient was given the following plan, {} and it was not the same",
)


@dataclass
class LicenseModel:
    vocabulary: CountVectorizerModel
    classifier: LogisticRegressionModel
    classes: list[str]
    temperature: float
    least: float
    held_out_accuracy: float


def words(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def _grams(df: DataFrame, col: str = "passage") -> DataFrame:
    """Adds ``__g``, the words and word groups of ``col``, whose start and end count as words."""
    tokens = df.withColumn("__w", F.concat(F.array(F.lit("^")), words(F.col(col)), F.array(F.lit("$"))))
    return tokens.withColumn("__g", F.concat("__w", ngrams(F.col("__w"), 2), ngrams(F.col("__w"), 3))).drop("__w")


def _once(col: Column, then) -> Column:
    """``then`` of ``col``, which is worked out once however often ``then`` reads it."""
    return F.element_at(F.transform(F.array(col), then), 1)


def _known_grams(df: DataFrame, vocabulary: list[str], col: str = "passage") -> DataFrame:
    """Adds ``__g`` as :func:`_grams` does, without the groups that hold a word of no entry of ``vocabulary``: the vectorizer passes those over, and they are most of a text."""
    known = sorted({word for entry in vocabulary for word in entry.split(" ")})
    # Unknown words are null, and so is every group that holds one.
    found = F.transform(F.array_remove(F.split(F.lower(col), "[^a-z0-9]+"), ""), lambda w: F.when(w.isin(known), w))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    groups = lambda w, p: F.concat(w, p, F.zip_with(p, F.slice(w, 3, F.size(w)), joined))
    every = _once(F.concat(F.array(F.lit("^")), found, F.array(F.lit("$"))), lambda w: _once(F.zip_with(w, F.slice(w, 2, F.size(w)), joined), lambda p: groups(w, p)))
    return df.withColumn("__g", F.array_compact(every))


def _inline(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A small table from literals."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def labelled_table(spark: SparkSession) -> DataFrame:
    """Rows (passage, family, held): every sentence in every frame, some frames held out, and long ones by halves."""
    rows = []
    for family, texts in [*TEMPLATES.items(), *OTHERS.items()]:
        for k, text in enumerate(texts):
            rows += [(frame.format(text), family, (i + k) % 3 == 2) for i, frame in enumerate(FRAMES)]
            parts = text.split()
            if len(parts) > 14:
                half = len(parts) // 2
                rows += [(" ".join(p), family, False) for p in (parts[: half + 3], parts[half - 3 :])]
    return _inline(spark, rows, "passage", "family", "held")


def _chances(df: DataFrame, model: LogisticRegressionModel, temperature: float) -> DataFrame:
    """Adds ``chances``, the softmax of the scores over the temperature."""
    scored = model.transform(df).withColumn("__s", vector_to_array("rawPrediction"))
    # Greatest and total would else be worked out again for each class.
    scaled = scored.withColumn("__s", _once(F.array_max("__s"), lambda most: F.transform("__s", lambda x: F.exp((x - most) / temperature))))
    total = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x)
    chances = _once(total, lambda n: F.transform("__s", lambda x: x / n))
    return scaled.withColumn("chances", chances).drop("__s", "rawPrediction", "probability", "prediction", "features")


def fit(labelled: DataFrame) -> LicenseModel:
    """Train on the rows not held out; set temperature and least chance on the others."""
    classes = [r["family"] for r in labelled.select("family").distinct().orderBy("family").collect()]
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family"))
    rows = _grams(labelled.withColumn("label", (number - 1).cast("double")))
    vocabulary = CountVectorizer(binary=True, inputCol="__g", outputCol="features").fit(rows.filter("not held"))
    table = vocabulary.transform(rows).cache()
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.1).fit(table.filter("not held"))
    losses = []
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0):
        held = _chances(table.filter("held"), model, temperature)
        mine = F.element_at("chances", F.col("label").cast("int") + 1)
        losses.append((held.agg(F.avg(-F.log(F.greatest(mine, F.lit(1e-9))))).first()[0], temperature))
    temperature = min(losses)[1]
    held = _judged(_chances(table.filter("held"), model, temperature), classes).select("family", "found", "chance", "about")
    steps = [k / 20 for k in range(4, 17)]
    named = lambda t: F.when(~F.col("about"), NONE).when(F.col("chance") >= t, F.col("found")).otherwise(UNKNOWN)
    scores = held.agg(*(F.avg((named(t) == F.col("family")).cast("double")).alias(f"t{i}") for i, t in enumerate(steps))).first()
    accuracy, least = max((s, -t) for s, t in zip(scores, steps))
    table.unpersist()
    return LicenseModel(vocabulary, model, classes, temperature, -least, accuracy)


def _judged(df: DataFrame, classes: list[str]) -> DataFrame:
    """Adds whether the passage is ``about`` a licence, and if so the likeliest class but ``none`` (``found``) and its ``chance``."""
    pairs = F.zip_with("chances", F.array(*map(F.lit, classes)), lambda c, n: F.struct(c.alias("chance"), n.alias("found")))
    none = F.element_at("chances", classes.index(NONE) + 1) if NONE in classes else F.lit(0.0)
    best = F.when(none < 0.5, F.array_max(F.filter(pairs, lambda p: p["found"] != NONE)))
    return df.withColumn("__best", best).select("*", "__best.*", (none < 0.5).alias("about")).drop("__best")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, paragraph, lines): without comment marks and blank lines; ``paragraph`` counts from 0."""
    bare = F.regexp_replace(F.regexp_replace(text_of(text_col), "\r\n?", "\n"), MARKS, "")
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(F.split(F.btrim(bare, F.lit("\n")), r"\n{2,}")).alias("paragraph", "lines"))
    return cut.filter("lines <> ''")


def windows(rows: DataFrame) -> DataFrame:
    """Instead of ``lines``: ``passage``, a paragraph's lines joined, or every ``WINDOW`` words of it from each half of that; ``start``, the words before it; and ``counted``, the words of each line."""
    bare = F.transform(F.split("lines", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")))
    by_line = F.transform(bare, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, r"\s+")))
    kept = [c for c in rows.columns if c != "lines"]
    half = WINDOW // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("__t") - WINDOW) / half)).cast("int"))
    # The text goes no further, as there are many windows to a long paragraph.
    cut = rows.select(*kept, by_line.alias("__l")).select(*kept, F.transform("__l", lambda x: F.size(x)).alias("counted"), F.flatten("__l").alias("__t"))
    return cut.select(*kept, "counted", F.explode_outer(F.transform(starts, lambda i: F.struct((i * half).alias("start"), F.array_join(F.slice("__t", i * half + 1, WINDOW), " ").alias("passage")))).alias("__c")).select(
        *kept, "counted", "__c.*"
    )


def _scored(df: DataFrame, model: LicenseModel) -> DataFrame:
    """The rows that are about a licence, with ``found`` and ``chance``."""
    features = model.vocabulary.transform(_known_grams(df, model.vocabulary.vocabulary)).drop("__g")
    judged = _judged(_chances(features, model.classifier, model.temperature), model.classes)
    # By way of an outer explode: a plain filter would be moved below the steps that make it, and they would run twice, word groups nested.
    hit = F.explode_outer(F.when(F.col("about"), F.array(F.struct("found", "chance")))).alias("__hit")
    return judged.select(*df.columns, hit).filter("__hit is not null").select(*df.columns, "__hit.*")


def scan_licenses(docs: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, paragraph, place, passage, family, believed, chance, similarity), one per family and paragraph about a licence.

    ``believed`` is the classifier's family; ``family`` is the same where a template confirms it, else ``unknown``, which is
    given only where the paragraph has no confirmed family. ``place`` is the line of the paragraph, from 0, in which the passage begins.
    """
    spark = docs.sparkSession
    about = _scored(windows(paragraphs(docs, id_col, text_col).withColumn("__row", F.monotonically_increasing_id())), model).drop("found", "chance")
    # A window that is about a licence, and its sentences.
    about = about.withColumn("__s", F.split("passage", r"(?<=[.!?;])(?<!\b[vV]\.) +"))
    sentences = F.col("__s")
    offsets = F.transform(sentences, lambda x, i: F.struct(x.alias("passage"), F.aggregate(F.slice(sentences, 1, i), F.col("start"), lambda n, y: n + F.size(F.split(y, " "))).alias("start")))
    units = F.concat(F.array(F.struct("passage", "start")), F.when(F.size(sentences) > 1, offsets).otherwise(F.array().cast("array<struct<passage:string,start:int>>")))
    parts = about.withColumn("__u", F.explode_outer(units)).select("doc_id", "__row", "paragraph", "counted", "__u.*")
    believed = F.when(F.col("chance") >= model.least, F.col("found")).otherwise(UNKNOWN)
    rows = _scored(parts, model).withColumn("believed", believed).withColumn("chance", F.round("chance", 6))
    # Word pairs; of a template of one word, the word.
    grams = lambda w: F.when(F.size(w) > 1, F.array_distinct(ngrams(w, 2))).otherwise(w)
    templates = _inline(spark, [(f, t) for f, texts in TEMPLATES.items() for t in texts], "believed", "template")
    templates = templates.groupBy("believed").agg(F.collect_list(grams(words(F.col("template")))).alias("__t"))
    tokens = rows.withColumn("__w", words(F.col("passage")))
    mine = tokens.withColumn("__p", F.concat("__w", ngrams(F.col("__w"), 2))).join(F.broadcast(templates), "believed", "left")  # a row per family
    # A word alone, such as MIT, says something only where there is hardly anything else.
    fits = lambda t: F.lit(1.0) - ((F.size(t) == 1) & ~t[0].contains(" ") & (F.size("__w") > 3)).cast("double")
    share = F.transform("__t", lambda t: fits(t) * F.size(F.array_intersect(t, F.col("__p"))) / F.size(t))
    close = F.coalesce(F.round(F.array_max(share), 6), F.lit(0.0))
    judged = mine.withColumn("similarity", close).withColumn("family", F.when(close >= CONFIRMED, F.col("believed")).otherwise(UNKNOWN))
    # The best passage of each family of a paragraph; the shorter one where they are alike.
    best = F.struct("similarity", "chance", (-F.length("passage")).alias("short"), (-F.col("start")).alias("first"), "passage", "believed", "doc_id", "paragraph", "counted")
    found = judged.groupBy("__row", "family").agg(F.max(best).alias("b"))
    kept = found.groupBy("__row").agg(F.collect_list(F.struct("family", "b")).alias("all"))
    known = F.filter("all", lambda x: x["family"] != UNKNOWN)
    out = kept.select(F.explode(F.when(F.size(known) > 0, known).otherwise(F.col("all"))).alias("x")).select("x.family", "x.b.*")
    # The line that holds the passage's first word.
    place = F.aggregate("counted", F.struct(F.lit(0).alias("line"), F.lit(0).alias("n")), lambda s, c: F.struct((s["line"] + (s["n"] + c <= -F.col("first")).cast("int")).alias("line"), (s["n"] + c).alias("n")), lambda s: s["line"])
    return out.select(F.col("doc_id").alias(id_col), "paragraph", place.alias("place"), "passage", "family", "believed", "chance", "similarity")
