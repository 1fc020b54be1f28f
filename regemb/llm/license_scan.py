"""License scan by a trained paragraph classifier (operator 5), DataFrame functions only.

* **Paragraphs** are stretches of words that hold at least ``MIN_TEMPLATE`` of
  the two-word n-grams of a template, in whatever lines they lie (a wrapped
  notice is one paragraph, from ``line_no`` to ``last_line``; of stretches that
  share a word the one closest to its template stays), and the lines that no
  such stretch touches.  Words are runs of letters and digits in lower case;
  the features of a paragraph are its one-, two- and three-word n-grams, hashed
  to ``SLOTS`` slots.
* **Training.**  Multinomial logistic regression (``pyspark.ml``, elastic net, so
  the weights are sparse) on the family templates, on paragraphs made from
  them (each template with leading and trailing words cut off and with plain
  text around it) and, as the class *unknown*, on notices of licences outside
  the families, on licence talk of no family and on a bounded sample of the
  corpus' own lines (``SAMPLE_LINES``, the smallest by hash).
* **Calibration.**  The temperature of the softmax is chosen by log-likelihood
  over a fixed grid on paragraphs whose templates are not trained on: the last
  template of each family with three, every fourth notice of the unknown
  class.  A paragraph whose best family stays below ``MIN_PROBABILITY`` is
  unknown.
* **Confirmation.**  A predicted family counts only if the paragraph holds at
  least ``MIN_TEMPLATE`` of the two-word n-grams of one of its templates, that
  template's naming words (:data:`NAMES`), and no word that names another
  licence: a notice that differs by such a word is another licence's.

Lines without any cue word (:func:`cue_words`) hold too few n-grams of every
template to be confirmed; they are not scored and give no row.

A line of more than ``WINDOW`` words without a possible notice is scored by
that one of its windows (every ``STEP`` words) that holds most two-word
n-grams of templates.  Every possible notice of a line has its own row.

Null or empty texts have no paragraphs.  Null ids stay null.  Repeated rows
give repeated results.  An empty table gives an empty result (the model then
has only the built-in unknown paragraphs).  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regemb.llm.base import drawn, id_and_text, stored

SLOTS = 4096
SAMPLE_LINES = 2000
WINDOW = 64             # words scored at once; the longest template has 29
STEP = 32
MIN_PROBABILITY = 0.5
MIN_TEMPLATE = 0.6
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)

# Short notices by which licences are named, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this "
        "file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0"],
    "mit": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without "
        "restriction",
        "SPDX-License-Identifier: MIT"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later",
        "This library is free software; you can redistribute it and/or modify it under the "
        "terms of the GNU Lesser General Public License"],
    "bsd": [
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License"],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": [
        "Released into the public domain under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related "
        "rights to this work"],
    "all-rights-reserved": [
        "Copyright, all rights reserved",
        "No part of this publication may be reproduced without prior written permission"],
}
# Talk about licences that names no family.
UNKNOWN = [
    "Please read the license before you install the program",
    "You need a driving license to rent the car", "The license fee is due every year",
    "Ask the public library for permission to copy", "This software is provided with a manual",
    "Terms and conditions may change without notice", "Free software was the topic of the talk",
    "Version 2.0 of the program was released under pressure",
    "Apache helicopters flew over the base", "He studied at MIT for four years",
    "The Mozilla foundation opened a new office", "Creative work is common at school",
    "The author has written two books", "Source code and binary files are kept apart",
]
# Short notices of licences outside the families.
OTHERS = {
    "epl": ["This program is made available under the terms of the Eclipse Public License 2.0",
            "Licensed under the Eclipse Public License, version 2.0"],
    "zlib": ["Released under the zlib license",
             "This project is licensed under the terms of the Zlib license"],
    "ecl": ["Licensed under the Educational Community License, Version 2.0"],
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0",
                 "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 "
                 "International License"],
    "cc-by-nc-sa": ["Licensed under CC BY-NC-SA 4.0",
                    "This work is licensed under a Creative Commons "
                    "Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nc-nd": ["Licensed under CC BY-NC-ND 4.0"],
    "isc": ["Released under the ISC License"],
    "boost": ["Distributed under the Boost Software License, Version 1.0"],
    "artistic": ["Licensed under the terms of the Artistic License 2.0"],
    "cddl": ["Subject to the terms of the Common Development and Distribution License"],
    "eupl": ["Licensed under the European Union Public Licence, version 1.2"],
    "ofl": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "unlicense": ["Released under the Unlicense into the public domain"],
}
# Words that name a licence.
NAMES = {
    "apache-2.0": "apache", "mit": "mit", "gpl": "general gpl", "lgpl": "lesser lgpl", "bsd": "bsd",
    "mpl": "mozilla mpl", "cc-by-nc": "nc noncommercial", "cc-by-sa": "sa sharealike",
    "cc-by": "by attribution", "cc0": "cc0", "all-rights-reserved": "reserved",
}
OTHER_NAMES = ("eclipse epl zlib educational affero agpl nd noderivatives isc boost artistic cddl "
               "union eupl sil font unlicense")
UNKNOWN_CLASS = "unknown"
FAMILIES = [UNKNOWN_CLASS, *TEMPLATES]
_FILL = ["the", "and", "of", "see", "also", "note", "file", "page", "readme", "text"]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def words(line: Column) -> Column:
    """Words of a paragraph, as an array."""
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(w: str, n: int) -> Column:
    """n-grams of the word array column ``w``."""
    size = F.size(w) - (n - 1)
    if n == 1:
        return F.col(w)
    return F.when(size > 0, F.transform(
        F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
        lambda i: F.array_join(F.slice(F.col(w), i, F.lit(n)), " "))
    ).otherwise(F.array().cast("array<string>"))


def slots(w: str) -> Column:
    """Distinct slots (1-based) of the one-, two- and three-word n-grams."""
    return F.array_distinct(F.transform(
        F.concat(grams(w, 1), grams(w, 2), grams(w, 3)),
        lambda g: (F.pmod(F.xxhash64(g), F.lit(SLOTS)) + 1).cast("int")))


def training_paragraphs() -> list[tuple[str, str, bool]]:
    """``(family, paragraph, held out)`` made from the fixed templates; held-out ones by template."""
    out = []
    none = [t for texts in OTHERS.values() for t in texts] + UNKNOWN
    for family, texts in [*TEMPLATES.items(), (UNKNOWN_CLASS, none)]:
        for at, text in enumerate(texts):
            held = (at % 4 == 3 if family == UNKNOWN_CLASS
                    else len(texts) > 2 and at == len(texts) - 1)
            w = words_of(text)
            shapes = [w, w, w[1:], w[:-1], w[: max(3, len(w) * 3 // 4)], w[len(w) // 4:]]
            shapes += [[*_FILL[i:i + 3], *w, *_FILL[i + 2:i + 5]] for i in range(0, 6, 2)]
            out += [(family, " ".join(s), held) for s in shapes]
    return out


def named(family: str, template: str) -> list[str]:
    """Words of a template that name its family."""
    return [w for w in NAMES[family].split() if w in words_of(template)]


def foreign(family: str) -> list[str]:
    """Words that name another licence and stand in no template of the family."""
    own = {w for t in TEMPLATES[family] for w in words_of(t)} | set(NAMES[family].split())
    every = {w for names in [*NAMES.values(), OTHER_NAMES] for w in names.split()}
    return sorted(every - own - {"by"})


def lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, line)`` of every line of every text."""
    return (id_and_text(docs)
            .select("doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "line")))


def windows(w: Column) -> Column:
    """Word windows that overlap by half; the words themselves where they fit into one."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / STEP), F.lit(0))
                        .cast("int"))
    return F.transform(starts, lambda i: F.slice(w, i * STEP + 1, F.lit(WINDOW)))


def one_window(line: str) -> Column:
    """The line, or one of its windows if it is longer than that."""
    return F.when(F.length(line) < 2 * WINDOW, F.col(line)).otherwise(F.element_at(F.transform(
        F.array(words(F.col(line))), lambda w: F.when(
            F.size(w) <= WINDOW, F.col(line)).otherwise(F.array_join(F.slice(
                w, (F.pmod(F.xxhash64(F.col(line)), F.ceil((F.size(w) - WINDOW) / STEP) + 1)
                    * STEP + 1).cast("int"), F.lit(WINDOW)), " "))), 1))


def cue_words() -> set[str]:
    """Words without any of which no template can be confirmed.

    For every template words are added, long ones first, until its two-word
    n-grams that hold none of them are fewer than confirmation needs.
    """
    cues: set[str] = set()
    for texts in TEMPLATES.values():
        for text in texts:
            w = words_of(text)
            pairs = {(w[i], w[i + 1]) for i in range(len(w) - 1)}
            for word in sorted(set(w), key=lambda x: (x in _COMMON, -len(x), x)):
                if sum(not cues & set(p) for p in pairs) < MIN_TEMPLATE * len(pairs):
                    break
                cues.add(word)
    return cues


# Words too common to look for unless nothing else is left.
_COMMON = {"the", "and", "for", "any", "are", "you", "may", "not", "can", "this", "that", "with",
           "without", "under", "into", "of", "or", "to", "in", "is", "it", "a", "by"}


def cue_pattern() -> str:
    """Matches the lines that hold a cue word."""
    return (r"(?iu)(?<![\p{L}\p{N}])(?:" + "|".join(sorted(cue_words()))
            + r")(?![\p{L}\p{N}])")


class Classifier:
    """Weights by slot and family, and the softmax temperature."""

    def __init__(self, spark: SparkSession, docs: DataFrame):
        made = spark.createDataFrame(training_paragraphs(),
                                     "family string, line string, held boolean")
        # distinct lines of the smallest hashes; the cut keeps what one task sorts from
        # growing with the number of tasks (a document has a line or more)
        cut = 3.0 * SAMPLE_LINES / max(1, docs.count())
        own = (lines(docs).where((F.length("line") > 0) & (drawn("line") <= cut))
               .select(one_window("line").alias("line"))
               .where(~F.col("line").rlike(cue_pattern())).distinct()
               .orderBy(drawn("line"), "line").limit(SAMPLE_LINES)
               .select(F.lit(UNKNOWN_CLASS).alias("family"), "line",
                       (F.pmod(F.xxhash64("line"), F.lit(4)) == 3).alias("held")))
        index = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1
        rows = (made.union(own).withColumn("w", words(F.col("line")))
                .where(F.size("w") > 0)
                .withColumn("s", slots("w")).withColumn("label", index.cast("double")))
        rows = stored(rows.select("s", "label", "held",
                                  F.col("s").cast("array<string>").alias("seen")), "license-rows")
        vocabulary = CountVectorizer(inputCol="seen", outputCol="features", vocabSize=SLOTS,
                                     binary=True).fit(rows)
        model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5,
                                   maxIter=40, standardization=False) \
            .fit(vocabulary.transform(rows.where("not held")).coalesce(1))
        self.weights = np.zeros((len(FAMILIES), SLOTS))
        at = [int(v) - 1 for v in vocabulary.vocabulary]
        self.weights[:model.numClasses, at] = model.coefficientMatrix.toArray()
        self.intercepts = np.zeros(len(FAMILIES))
        self.intercepts[:model.numClasses] = model.interceptVector.toArray()
        self.temperature = self._temperature(rows.where("held").select("s", "label"))

    def _temperature(self, held: DataFrame) -> float:
        """Best temperature for the held-out paragraphs, a few hundred by construction."""
        rows = held.collect()
        z = np.array([self.intercepts + self.weights[:, np.array(r["s"], int) - 1].sum(1)
                      for r in rows]).reshape(-1, len(FAMILIES))
        label = np.array([int(r["label"]) for r in rows], int)

        def loss(t: float) -> float:
            u = z / t
            top = u.max(1)
            return float(np.mean(top + np.log(np.exp(u - top[:, None]).sum(1))
                                 - u[np.arange(len(u)), label]))
        return min(TEMPERATURES, key=loss) if len(rows) else 1.0

    def margins(self, s: str) -> Column:
        """Margins by family of a slot array: one lookup per slot and family."""
        def margin(k: int) -> Column:
            table = F.split(F.lit(",".join(f"{v:.6g}" for v in self.weights[k])), ",") \
                     .cast("array<double>")
            return F.aggregate(F.col(s), F.lit(float(self.intercepts[k])),
                               lambda a, i: a + F.element_at(table, i))
        return F.array(*map(margin, range(len(FAMILIES))))


def template_share(two: Column, family: str) -> Column:
    """Largest share of a template's two-word n-grams that the paragraph holds."""
    return F.greatest(*_shares(two, family), F.lit(0.0))


def _shares(two: Column, family: str) -> list[Column]:
    out = []
    for text in TEMPLATES[family]:
        w = words_of(text)
        own = sorted({" ".join(w[i:i + 2]) for i in range(len(w) - 1)})
        out.append(F.size(F.array_intersect(two, F.array(*map(F.lit, own)))) / len(own))
    return out


def agrees(w: Column, two: Column, family: str) -> Column:
    """Whether a template of the family confirms a paragraph of these words."""
    ok = F.lit(False)
    for text, share in zip(TEMPLATES[family], _shares(two, family), strict=True):
        holds = share >= MIN_TEMPLATE
        for name in named(family, text):
            holds = holds & F.array_contains(w, name)
        ok = ok | holds
    return ok & ~F.arrays_overlap(w, F.array(*map(F.lit, foreign(family))))


def _templates() -> Column:
    """Two-word n-grams of every template, and how many words a notice made from it may span."""
    out = []
    for texts in TEMPLATES.values():
        for text in texts:
            w = words_of(text)
            own = sorted({" ".join(w[i:i + 2]) for i in range(len(w) - 1)})
            out.append(F.struct(F.array(*map(F.lit, own)).alias("own"),
                                F.lit(len(own)).alias("n"),
                                F.lit(len(w) + len(w) // 2).alias("reach")))
    return F.array(*out)


def _stretch(o: Column, h: Column, j: Column) -> Column:
    """The words from hit ``j`` on that hold most of a template, as few as possible.

    Fields sort better stretches first.
    """
    near = F.transform(F.filter(F.slice(o["hits"], j + 1, o["reach"]),
                                lambda x: x["p"] < h["p"] + o["reach"]), lambda x: x["g"])
    found = F.array_distinct(near)
    last = F.get(o["hits"], j + F.array_position(near, F.element_at(found, -1)).cast("int") - 1)
    return F.struct((-F.size(found) / o["n"]).alias("minus_share"),
                    (-F.size(found)).alias("minus_found"),
                    (last["p"] - h["p"]).alias("length"), h["p"].alias("first"),
                    (last["p"] + 1).alias("last"), h["line"].alias("line_no"),
                    last["next_line"].alias("last_line"))


def _apart(found: Column) -> Column:
    """The best stretches of which no two share a word."""
    def meets(a: Column, b: Column) -> Column:
        return (a["first"] <= b["last"]) & (b["first"] <= a["last"])
    return F.aggregate(F.array_sort(found), F.slice(found, 1, 0), lambda kept, x: F.when(
        F.exists(kept, lambda k: meets(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def units(docs: DataFrame) -> DataFrame:
    """``(doc_id, line_no, last_line, w)``: possible notices, then the other lines with a cue word.

    Notices are looked for in the words of the whole text, whatever lines they
    lie in, all inside the row.
    """
    pairs = sorted({" ".join(words_of(t)[i:i + 2]) for texts in TEMPLATES.values()
                    for t in texts for i in range(len(words_of(t)) - 1)})
    rows = (id_and_text(docs).where(F.col("text").rlike(cue_pattern()))
            .select("doc_id", F.split("text", r"\r\n|\n|\r").alias("lines"))
            .withColumn("tokens", F.flatten(F.transform("lines", lambda line, i: F.transform(
                words(line), lambda w: F.struct(w.alias("w"), i.alias("line")))))))

    def pair(t: Column, i: Column) -> Column:
        follow = F.get("tokens", i + 1)
        return F.struct(i.alias("p"), t["line"].alias("line"), follow["line"].alias("next_line"),
                        F.concat(t["w"], F.lit(" "), follow["w"]).alias("g"))
    hits = F.filter(F.transform("tokens", pair), lambda h: F.coalesce(
        h["g"].isin(pairs), F.lit(False)))
    rows = rows.withColumn("hits", hits)
    per_template = F.filter(F.transform(_templates(), lambda t: F.struct(
        F.filter("hits", lambda h: F.array_contains(t["own"], h["g"])).alias("hits"),
        t["n"].alias("n"), t["reach"].alias("reach"))),
        lambda o: F.size(F.array_distinct(F.transform(o["hits"], lambda h: h["g"])))
        >= MIN_TEMPLATE * o["n"])
    found = F.flatten(F.transform(per_template, lambda o: F.filter(
        F.transform(o["hits"], lambda h, j: _stretch(o, h, j)),
        lambda x: x["minus_share"] <= -MIN_TEMPLATE)))
    rows = rows.withColumn("found", found).withColumn("notices", _apart(F.col("found")))
    notices = F.transform("notices", lambda x: F.struct(
        x["line_no"].alias("line_no"), x["last_line"].alias("last_line"),
        F.transform(F.slice("tokens", x["first"] + 1, x["last"] - x["first"] + 1),
                    lambda t: t["w"]).alias("w")))
    def fullest(w: Column) -> Column:
        best = F.array_max(F.transform(windows(w), lambda v, i: F.struct(
            F.size(F.filter(F.transform(v, lambda x, k: F.concat_ws(" ", x, F.get(v, k + 1))),
                            lambda g: g.isin(pairs))).alias("n"),
            (-i).alias("minus_at"), v.alias("v"))))
        return F.when(F.size(w) <= WINDOW, w).otherwise(best["v"])
    others = F.transform(F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: x["line"].rlike(cue_pattern()) & ~F.exists("notices", lambda k: (
            k["line_no"] <= x["i"]) & (x["i"] <= k["last_line"]))),
        lambda x: F.struct(x["i"].alias("line_no"), x["i"].alias("last_line"),
                           F.element_at(F.transform(F.array(words(x["line"])), fullest), 1)
                           .alias("w")))
    return rows.select("doc_id", F.inline(F.concat(notices, others)))


def scan(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, line_no, family, probability, template_share, confirmed, last_line`` of every unit."""
    rows = (units(docs).withColumn("s", slots("w"))
            .withColumn("z", classifier.margins("s"))
            .withColumn("e", F.transform("z", lambda v: F.exp(
                (v - F.array_max("z")) / classifier.temperature)))
            .withColumn("p", F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
            .withColumn("best", F.element_at(
                F.array(*map(F.lit, FAMILIES)),
                F.array_position("z", F.array_max("z")).cast("int")))
            .withColumn("two", grams("w", 2)))
    share, agreed = F.lit(0.0), F.lit(False)
    for family in TEMPLATES:
        mine = F.col("best") == family
        share = F.when(mine, template_share(F.col("two"), family)).otherwise(share)
        agreed = F.when(mine, agrees(F.col("w"), F.col("two"), family)).otherwise(agreed)
    return (rows.withColumn("share", share).withColumn("agreed", agreed)
            .select("doc_id", "line_no",
                    F.when(F.col("p") >= MIN_PROBABILITY, F.col("best"))
                     .otherwise(UNKNOWN_CLASS).alias("family"),
                    F.col("p").alias("probability"), F.col("share").alias("template_share"),
                    ((F.col("p") >= MIN_PROBABILITY) & (F.col("best") != UNKNOWN_CLASS)
                     & F.col("agreed")).alias("confirmed"), "last_line"))
