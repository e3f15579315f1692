"""Licence scan: a trained paragraph classifier, confirmed by template comparison. DataFrame functions only.

A notice may be wrapped: from each line on, words are read across the lines of its paragraph (up to a line without any
word). From each three-gram of any template that begins in that line, the words up to the last of its three-grams within reach
are a candidate.
A multinomial logistic regression over a candidate's word one- and two-grams (which of them it holds, scaled to length one, so
that neither a long candidate nor a repeated word counts more) names its family: the likeliest one. It is trained on the
families' template paragraphs, whole and with parts left out, against lines of a bounded sample of the corpus as the class of
unknown texts. The family's probability against that of unknown texts must reach a threshold: the split-conformal quantile of
`ALPHA` over held-out unknown lines (with fewer than 1 / ALPHA of them their maximum), but never above what the whole templates
themselves have, so that a corpus whose own lines look like licences can't silence known notices. A template of the family that
the classifier named must then confirm it: `least` of the template's three-grams are in the candidate.

Families with similar templates (GPL 2 and 3) are rivals: where their passages overlap, only the one that holds more of its
template counts. Others don't keep each other out, so a line may have several families.

Not found: families without a template below, and texts of which less than `least` of a template is there, so a notice's
other sentences are no passages of their own. BSD licences of 2 and 3 clauses begin alike and are named by the latter.

Only texts with a trigger word are read: for each template, words that together stand in more than 1 - least of its
three-grams, so that a text without any of them cannot hold enough of it.

Rows: null and empty texts have no paragraphs. Repeated rows and null doc_ids are scanned like any other row. An empty table
gives an empty result. Other columns are not read. Very long lines are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import materialize

#: Documents, those with the lowest hashes of their ids, whose lines are examples of unknown paragraphs.
SAMPLE = 400
FEATURES = 1 << 13
LEAST = 0.8
#: Share of unknown lines that may pass the classifier, before templates confirm.
ALPHA = 0.001
UNKNOWN = "unknown"

#: Notices of common licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "apache-1.1": [
        "Licensed under the Apache License, Version 1.1.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
    ],
    "bsd-2-clause": [
        "Licensed under the BSD 2-Clause License.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ],
    "bsl-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "epl-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nd-4.0": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "cc-by-nc-sa-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-nd-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "cc0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
    ],
}
#: Lower-case words: letters, digits and inner points and hyphens, so "4.0" and "by-nc" are words.
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"))


def _runs(w: Column, n: int) -> Column:
    """Runs of n words, joined by spaces."""
    run = w
    for i in range(1, n):
        run = F.zip_with(run, F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(run, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))


def template_words(template: str) -> list[str]:
    return re.findall(WORD, template.lower())


def template_grams(template: str) -> list[str]:
    """A template's distinct word three-grams."""
    w = template_words(template)
    return sorted({" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))})


def rivals(templates: dict[str, list[str]]) -> dict[str, str]:
    """The first family of each group whose templates share half of their three-grams or more."""
    top = {f: f for f in templates}
    grams = {f: [set(template_grams(t)) for t in ts] for f, ts in templates.items()}
    for f in templates:
        for g in templates:
            if top[f] != top[g] and any(2 * len(a & b) >= min(len(a), len(b)) for a in grams[f] for b in grams[g]):
                top = {x: top[f] if y == top[g] else y for x, y in top.items()}
    return top


def triggers(templates: dict[str, list[str]], least: float) -> set[str]:
    """Words of which any line that holds `least` of a template's three-grams has one: a template's longest words first,
    until they stand in more than 1 - least of its three-grams."""
    out: set[str] = set()
    for template in (t for ts in templates.values() for t in ts):
        w = template_words(template)
        grams = list({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
        chosen: set[str] = set()
        for word in sorted(set(w), key=lambda x: (-len(x), x)):
            if sum(bool(chosen & set(g)) for g in grams) > (1 - least) * len(grams):
                break
            chosen.add(word)
        out |= chosen
    return out


def _examples(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """Template paragraphs: whole, and without each fifth of their words."""
    rows = []
    for family, ts in templates.items():
        for t in ts:
            w = t.split()
            rows.append((family, t))
            rows += [(family, " ".join(w[: len(w) * i // 5] + w[len(w) * (i + 1) // 5 :])) for i in range(5) if len(w) > 5]
    return spark.createDataFrame(rows * 3, "family string, paragraph string")


def featurised(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import HashingTF, Normalizer

    w = df.withColumn("__words", words(F.col("paragraph")))
    held = HashingTF(inputCol="__grams", outputCol="__held", numFeatures=FEATURES, binary=True).transform(w.withColumn("__grams", F.concat("__words", _runs(F.col("__words"), 2))))
    return Normalizer(inputCol="__held", outputCol="features").transform(held).drop("__grams", "__held")


def train(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, sample: int = SAMPLE):
    """(model, families by class number, probability asked for)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    # Tasks send hashes of their first documents; texts of the chosen ones only are read then, one of equal rows.
    hashed = docs.select(F.xxhash64("doc_id").alias("h1"), F.xxhash64("text").alias("h2"), "text").where("text is not null")
    chosen = hashed.select("h1", "h2").orderBy("h1", "h2").limit(sample).distinct()
    found = hashed.join(F.broadcast(chosen), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    lines = found.select(F.explode(F.split("text", "\n")).alias("paragraph"))
    # Lines that hold a template are no examples of unknown ones.
    held = F.lit(False)
    for t in (t for ts in templates.values() for t in ts):
        held = held | (holds(words(F.col("paragraph")), t) >= 0.5)
    # Nor are lines of a wrapped one.
    runs = _runs(words(F.col("paragraph")), 3)
    held = held | ((F.size(runs) > 0) & (2 * F.size(F.array_intersect(runs, F.array(*map(F.lit, _all_grams(templates))))) >= F.size(F.array_distinct(runs))))
    unknown = lines.where(~held).withColumn("held_out", F.pmod(F.xxhash64("paragraph"), F.lit(3)) == 0)
    unknown = materialize(unknown.select(F.lit(UNKNOWN).alias("family"), "paragraph", "held_out"), "unknown")
    families = [UNKNOWN, *sorted(templates)]
    label = F.element_at(F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(float(i)))]), F.col("family"))
    rows = _examples(spark, templates).union(unknown.where("not held_out").select("family", "paragraph")).withColumn("label", label)
    model = LogisticRegression(maxIter=40, regParam=1e-3).fit(featurised(rows.coalesce(1)).select("label", "features"))
    scores = lambda df: model.transform(featurised(df)).select(F.array_max(_against_unknown(vector_to_array("probability"))).alias("p"))
    seen = scores(unknown.where("held_out")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("p"), asc=False).alias("p")).first()
    whole = spark.createDataFrame([(t,) for ts in templates.values() for t in ts], "paragraph string")
    known = scores(whole).agg(F.min("p").alias("p")).first()["p"]
    # The quantile's rank from the top: of n + 1 exchangeable lines at most ALPHA lie above it.
    above = min(seen["n"], int((seen["n"] + 1) * ALPHA) + 1) - 1
    return model, families, min(seen["p"][above] if seen["n"] else 0.0, known)


def _all_grams(templates: dict[str, list[str]]) -> list[str]:
    return sorted({g for ts in templates.values() for t in ts for g in template_grams(t)})


def _against_unknown(p: Column) -> Column:
    """Each family's probability where it and the class of unknown texts are the only ones."""
    return F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: x / (x + p[0]))


def holds(w: Column, template: str) -> Column:
    """Share of a template's word three-grams among those of a paragraph's words."""
    grams = template_grams(template)
    return F.size(F.array_intersect(_runs(w, 3), F.array(*map(F.lit, grams)))) / len(grams)


#: Place of a word: line and number in it.
LINE = 1 << 32


def passages(docs: DataFrame, templates: dict[str, list[str]], least: float) -> DataFrame:
    """Candidates: row (a number for the row of docs), doc_id, family, share, lo and hi (places of the first and last word),
    paragraph (the words)."""
    pattern = "(?i)(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in sorted(triggers(templates, least))) + ")(?![a-z0-9])"
    # So many three-grams are read from a notice's first one on, some for words put in between.
    reach = {t: len(template_grams(t)) * 5 // 4 + 1 for ts in templates.values() for t in ts}
    most = max(reach.values()) + 2

    def read(lines: Column) -> Column:
        """For each line with a word: its number, its number of words, and words and their places from there on."""

        def at(w: Column, i: Column) -> Column:
            after = F.slice(lines, i + 2, F.lit(most))
            blank = F.array_position(F.transform(after, F.size), F.lit(0)).cast("int")
            after = F.when(blank > 0, F.slice(after, 1, blank - 1)).otherwise(after)
            placed = F.transform(after, lambda x, k: F.transform(F.slice(x, 1, most), lambda y, n: F.struct(y.alias("word"), ((i + k + 1).cast("long") * LINE + n).alias("place"))))
            here = F.transform(w, lambda y, n: F.struct(y.alias("word"), (i.cast("long") * LINE + n).alias("place")))
            return F.struct(F.size(w).alias("first"), F.concat(here, F.slice(F.flatten(placed), 1, most)).alias("read"))

        return F.filter(F.transform(lines, at), lambda x: x["first"] > 0)

    some = docs.where(F.regexp_like("text", F.lit(pattern))).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.transform(F.split("text", "\n"), words).alias("lines"))
    # As an element, so that the lines' words are computed once.
    rows = some.select("row", "doc_id", F.explode(F.flatten(F.transform(F.array("lines"), read))).alias("x"))
    w = rows.select("row", "doc_id", "x.first", "x.read", _runs(F.col("x.read.word"), 3).alias("grams"))
    w = w.where(F.arrays_overlap(F.slice("grams", 1, F.col("first")), F.array(*map(F.lit, _all_grams(templates)))))

    def found(family: str, template: str) -> Column:
        """From each of the template's three-grams that begin in the first line."""
        grams = template_grams(template)
        of = F.array(*map(F.lit, grams))

        def passage(at: Column) -> Column:
            near = F.slice("grams", at + 1, F.lit(reach[template]))
            held = F.array_intersect(near, of)
            last = F.array_max(F.transform(held, lambda g: F.array_position(near, g))).cast("int")
            return F.struct(F.lit(family).alias("family"), (F.size(held) / len(grams)).alias("share"), at.alias("lo"), (at + last + 1).alias("hi"))

        begins = F.transform(F.slice("grams", 1, F.col("first")), lambda g, i: F.when(F.array_contains(of, g), i))
        return F.filter(F.transform(F.array_compact(begins), passage), lambda x: x["share"] >= least)

    hits = F.flatten(F.array(*[found(f, t) for f, ts in templates.items() for t in ts]))
    out = w.select("row", "doc_id", "read", F.explode(hits).alias("x"))
    place = lambda at: F.element_at("read", F.col(at) + 1)["place"]
    paragraph = F.array_join(F.slice("read.word", F.col("x.lo") + 1, F.col("x.hi") - F.col("x.lo") + 1), " ")
    return out.select("row", "doc_id", "x.family", "x.share", place("x.lo").alias("lo"), place("x.hi").alias("hi"), paragraph.alias("paragraph"))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Licence notices of docs (doc_id, text): doc_id, line (from 0, the first of the notice), family, probability,
    template_share."""
    from pyspark.ml.functions import vector_to_array

    model, families, asked = train(docs, templates)
    scored = model.transform(featurised(passages(docs, templates, least)))
    numbers = F.create_map(*[F.lit(x) for i, f in enumerate(families[1:], 1) for x in (f, i)])
    groups = F.create_map(*[F.lit(x) for pair in rivals(templates).items() for x in pair])
    every = _against_unknown(vector_to_array("probability"))
    named = (F.element_at(numbers, F.col("family")) == F.array_position(every, F.array_max(every))) & (F.array_max(every) >= asked)
    kept = scored.where(named).select("row", "doc_id", "family", "lo", "hi", "share", F.array_max(every).alias("p"), F.element_at(groups, F.col("family")).alias("rivals"))
    # The one with most of its template first; those that overlap it go, and a family's others in its line.
    best = F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("short"), "lo", (-F.col("p")).alias("unlike"), "hi", "family")))
    some = kept.groupBy("row", "rivals").agg(F.first("doc_id").alias("doc_id"), best.alias("best"))
    apart = lambda acc, x: F.when(F.exists(acc, lambda y: ((y["lo"] <= x["hi"]) & (x["lo"] <= y["hi"])) | ((y["family"] == x["family"]) & (F.shiftright(y["lo"], 32) == F.shiftright(x["lo"], 32)))), acc).otherwise(F.concat(acc, F.array(x)))
    out = some.select("doc_id", F.explode(F.aggregate("best", F.slice("best", 1, 0), apart)).alias("x"))
    return out.select("doc_id", F.shiftright("x.lo", 32).cast("int").alias("line"), "x.family", (-F.col("x.unlike")).alias("probability"), (-F.col("x.short")).alias("template_share"))
