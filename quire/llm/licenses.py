"""License scan by MinHash bands over overlapping windows, with DataFrame functions only.

Texts and templates are runs of five words (shingles). Both are cut into windows of WINDOW
shingles that overlap by half, and each window gets BANDS minhash values, a band of one row
each. A template of which a window of the text holds a share J (Jaccard) is retrieved with
probability 1 - (1 - J)^BANDS: 0.9998 for one shingle among the eight of a window, the
worst case of a one-line notice, and 1 - 4e-26 for the six of ten of a longer one whose
windows are cut at other places. A retrieved template then is verified exactly: of its
shingles, as words, at least threshold must occur in the text.

A text is only windowed if it has a word of every-template's screen: words that hit more
than 1 - threshold of the template's shingles, so that no text without them can pass the
verification. The templates' values are broadcast; their number is bounded by the list of
templates (MAX_TEMPLATE_WORDS, checked). Texts of retrieved pairs are read again; nothing
else of them is shuffled.

A template of fewer than five words is one shingle of its own length: a screen by a regular
expression that means these words in a row finds all its places, in the pass over the texts,
without windows or a shuffle. A license can have such a notice beside its template.

Defined results: one row per (document, license) found, of notice and template the template
where both are met; null texts, and templates without a word, have none. Empty tables give empty results; repeated rows
repeated ones, as often as the id is in the table.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.words import with_texts

WORDS, WINDOW, STRIDE, BANDS = 5, 8, 4, 64
MAX_TEMPLATE_WORDS = 200_000

#: Wording of common public license notices.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "Copyright holder. All rights reserved. No part of this work may be reproduced",
}

#: Notices of fewer than five words, under the license that they stand for.
NOTICES = {"All-rights-reserved": "All rights reserved."}


def _word_list(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def screen_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every text that has threshold of a template's shingles has at least one.

    Chosen greedily among all templates: the word that hits most shingles still to be hit,
    until more than 1 - threshold of each template's shingles are; of equals the longest.
    """
    sets = {}
    for name, text in templates.items():
        w = _word_list(text)
        sets[name] = {tuple(w[i : i + WORDS]) for i in range(len(w) - WORDS + 1)}
    chosen: list[str] = []
    for own in sets.values():
        open_ = {s for s in own if not set(s) & set(chosen)}
        while own and len(own) - len(open_) <= (1 - threshold) * len(own) + 1e-9:
            hits = Counter(w for s in open_ for w in set(s) if len(w) > 3) or Counter(w for s in open_ for w in set(s))
            longest = max(hits, key=lambda w: (min(hits[w], (1 - threshold) * len(own)), len(w), w))
            chosen.append(longest)
            open_ = {s for s in open_ if longest not in s}
    return chosen


def word_array(text: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _with_shingles(rows: DataFrame) -> DataFrame:
    """rows (words, ...) with shingles: each run of five words as a string; only rows that have one."""
    rows = rows.filter(F.size("words") >= WORDS)
    return rows.withColumn("shingles", F.transform(F.sequence(F.lit(1), F.size("words") - WORDS + 1), lambda i: F.array_join(F.slice("words", i, WORDS), " ")))


# explode_outer below: for a plain explode, Spark infers a filter on the array's size and pushes it,
# with all that makes the array, under the projections that compute it once.


def _with_bands(rows: DataFrame) -> DataFrame:
    """rows (shingles, ...) with bands: the distinct minhash values of all windows; a value tells its band."""
    rows = rows.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    last = F.greatest(F.lit(0), F.ceil((F.size("hashes") - WINDOW) / STRIDE)).cast("int")
    rows = rows.withColumn("windows", F.transform(F.sequence(F.lit(0), last), lambda w: F.slice("hashes", w * STRIDE + 1, WINDOW)))
    bands = F.sequence(F.lit(1), F.lit(BANDS))
    values = F.transform(bands, lambda b: F.transform("windows", lambda w: F.array_min(F.transform(w, lambda h: F.xxhash64(h, b)))))
    return rows.withColumn("bands", F.array_distinct(F.flatten(values))).drop("hashes", "windows")


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license_id, words of the templates."""
    if sum(len(_word_list(t)) for t in templates.values()) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words in all aren't broadcast; scan with parts of the list")
    rows = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in templates.items()))
    return spark.range(1).select(F.inline(rows)).select("license_id", word_array(F.col("text")).alias("words"))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, containment, start_word, end_word: templates whose shingles occur in the whole text by threshold or more.

    start_word and end_word: from the first to the last shingle of the template in the text, in words.
    """
    notices = NOTICES if templates is None else {k: v for k, v in templates.items() if 0 < len(_word_list(v)) < WORDS}
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if len(_word_list(v)) >= WORDS}
    short = _find_notices(docs, notices, templates, threshold, id_col, text_col)
    long = _find_templates(docs, templates, notices, threshold, id_col, text_col)
    return short if long is None else long if short is None else long.unionByName(short)


def _notice_pattern(notice: str) -> str:
    """A regular expression for the notice's words in a row, in lower-cased text."""
    return r"(?<![\p{L}\p{N}_])" + r"[^\p{L}\p{N}_]+".join(_word_list(notice)) + r"(?![\p{L}\p{N}_])"


def _places(pairs: DataFrame) -> DataFrame:
    """pairs (shingles, wanted, ...) with common, containment and places of the common shingles."""
    pairs = pairs.withColumn("common", F.array_intersect("wanted", "shingles")).withColumn("containment", F.size("common") / F.size("wanted"))
    return pairs.withColumn("places", F.transform("common", lambda s: F.array_position("shingles", s)))


def _find_notices(docs: DataFrame, notices: dict[str, str], templates: dict[str, str], threshold: float, id_col: str, text_col: str) -> DataFrame | None:
    """Rows of find_licenses for texts with a notice; None without notices."""
    found = None
    for license_id, notice in notices.items():
        pattern = _notice_pattern(notice)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text")).filter(F.col("text").rlike(pattern))
        start = F.size(word_array(F.split("text", pattern, 2)[0]))
        rows = rows.select("doc_id", F.lit(license_id).alias("license_id"), start.alias("at"), word_array(F.col("text")).alias("words"))
        wanted = sorted({" ".join(w[i : i + WORDS]) for w in [_word_list(templates.get(license_id, ""))] for i in range(len(w) - WORDS + 1)})
        whole = F.size("words") >= WORDS
        shingles = F.when(whole, F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - WORDS + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, WORDS), " "))).otherwise(F.array().cast("array<string>"))
        if wanted:
            rows = _places(rows.withColumn("shingles", shingles).withColumn("wanted", F.array(*map(F.lit, wanted))))
            met = F.col("containment") >= threshold
            containment, start, end = F.when(met, F.col("containment")).otherwise(1.0), F.when(met, F.array_min("places") - 1).otherwise(F.col("at")), F.when(met, F.array_max("places") - 1 + WORDS).otherwise(F.col("at") + len(_word_list(notice)))
        else:
            containment, start, end = F.lit(1.0), F.col("at"), F.col("at") + len(_word_list(notice))
        rows = rows.select("doc_id", "license_id", containment.alias("containment"), start.cast("int").alias("start_word"), end.cast("int").alias("end_word"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _find_templates(docs: DataFrame, templates: dict[str, str], notices: dict[str, str], threshold: float, id_col: str, text_col: str) -> DataFrame | None:
    """Rows of find_licenses for texts without the license's notice; None without templates but with notices."""
    if not templates and notices:
        return None
    known = _with_shingles(template_table(docs.sparkSession, templates)).withColumn("wanted", F.array_distinct("shingles"))
    screen = "|".join(sorted(set(screen_words(templates, threshold))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.filter(F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{screen})(?![\p{{L}}\p{{N}}_])"))
    windowed = _with_bands(_with_shingles(rows.select("doc_id", word_array(F.col("text")).alias("words")))).select("doc_id", F.explode_outer("bands").alias("band"))
    index = _with_bands(known).select("license_id", F.explode_outer("bands").alias("band"))
    retrieved = windowed.join(F.broadcast(index), "band").select("doc_id", "license_id").distinct()
    texts = with_texts(docs, retrieved.groupBy("doc_id").agg(F.collect_set("license_id").alias("retrieved")), id_col=id_col, text_col=text_col)  # a text's licenses
    both = [F.when(F.lower("text").rlike(_notice_pattern(v)), F.lit(k)) for k, v in notices.items() if k in templates]
    noticed = F.array_compact(F.array(*both)).cast("array<string>").alias("noticed")  # found by notice
    verify = _with_shingles(texts.select("doc_id", "retrieved", word_array(F.col("text")).alias("words"), noticed)).select("doc_id", "shingles", "noticed", F.explode_outer("retrieved").alias("license_id"))
    pairs = _places(verify.filter(~F.array_contains("noticed", F.col("license_id"))).join(F.broadcast(known.select("license_id", "wanted")), "license_id")).filter(F.col("containment") >= threshold)
    return pairs.select("doc_id", "license_id", "containment", (F.array_min("places") - 1).cast("int").alias("start_word"), (F.array_max("places") - 1 + WORDS).cast("int").alias("end_word"))
