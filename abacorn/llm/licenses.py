"""Licence scans: sparse TF-IDF cosine to templates, then nearest-ancestor directory inheritance. DataFrame functions only.

A file's passages are its lines and its paragraphs (between blank lines); each is a sparse vector of term frequency times inverse document
frequency, over the terms of the templates and all other words at one fixed weight. The inverse document frequencies of the template terms are
counted over all files. The cosine to every template's vector decides; a passage of cosine LEAST or more names the file's own licence (best
cosine, then template name). A licence file is one with a licence file's name or of which one licence passage is more than half.
A file without a licence of its own inherits that of the licence file in the nearest directory above it, found by joining the paths of the
distinct directories and their ancestors with the directories of licence files.

No passage is dropped that could pass, however long: one of cosine LEAST must share with its template a term of the prefix, the template's terms
by falling weight without the tail whose norm is below LEAST; only such passages are scored, each in time proportional to its length (and the sorting of its
words). The templates are a fixed small table.

Defined cases: null, empty and blank texts have no licence of their own but may inherit; a null path inherits nothing. Among licence files of
one directory the smallest (licence, path) counts. Each row of files gives one row, repeated rows too; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacorn.llm.common import BROADCAST_BYTES, broadcast_if_small, materialise

#: Licence headers and the openings of licence files, by SPDX-like name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]
LEAST = 0.7
#: Limit for a broadcast of rows of three paths, each counted as 16 bytes and taken to be up to 160 long.
TEXT_BYTES = BROADCAST_BYTES // 10
#: A licence file's names.
NAMES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|copyright)([._-][^/]*)?$"
SPLIT = "[^\\p{L}\\p{N}]+"


def terms(text: str) -> list[str]:
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def inverse_frequencies(files: DataFrame) -> dict[str, float]:
    """ln((1 + n) / (1 + files with the term)) + 1 of every template term, over all files; as many numbers as the templates have terms."""
    vocabulary = sorted({t for _, text in TEMPLATES for t in terms(text)})
    held = files.select(F.array_intersect(_tokens(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary))).alias("found"))
    n = files.count()
    counts = {r["term"]: r["count"] for r in held.select(F.explode("found").alias("term")).groupBy("term").count().collect()}
    return {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in vocabulary}


def vectors(idf: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """(licence, unit vector) of each template."""
    out = []
    for name, text in TEMPLATES:
        words = terms(text)
        weight = {t: words.count(t) * idf[t] for t in dict.fromkeys(words)}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        out.append((name, {t: w / norm for t, w in weight.items()}))
    return out


def prefixes(unit: list[tuple[str, dict[str, float]]]) -> set[str]:
    """Terms of which a passage of cosine LEAST with some template must hold one."""
    out = set()
    for _, vector in unit:
        tail = 0.0
        for term, w in sorted(vector.items(), key=lambda x: (x[1], x[0])):
            tail += w * w
            if tail >= LEAST * LEAST - 1e-9:
                out.add(term)
    return out


def own_licences(files: DataFrame) -> DataFrame:
    """files without their text, with licence and cosine (of the best passage), chars, and licence_chars (of the longest licence passage)."""
    idf = inverse_frequencies(files)
    unit, other = vectors(idf), 1.0 + math.log(2)
    asked = F.array(*map(F.lit, sorted(prefixes(unit))))
    weights = F.create_map(*(F.lit(x) for t, w in sorted(idf.items()) for x in (t, w)))
    text = F.coalesce("text", F.lit(""))
    passages = F.array_union(F.split(text, "\n"), F.split(text, "\n[ \t\r]*\n"))
    split = F.transform(passages, lambda x: F.struct(F.length(x).alias("chars"), _tokens(x).alias("tokens")))
    asking = F.filter(split, lambda x: F.arrays_overlap(x["tokens"], asked))
    # the only pass over the texts; from here on there are the few passages that may pass
    rows = materialise(files.select(*(c for c in files.columns if c != "text"), F.length(text).alias("chars"), asking.alias("_asking")), "asking")
    rated = F.transform("_asking", lambda x: _rate(x["tokens"], x["chars"], unit, weights, other))
    rated = materialise(rows.withColumn("_rated", F.when(F.size("_asking") > 0, rated)).drop("_asking"), "rated")
    good = F.filter(F.coalesce("_rated", F.array().cast(rated.schema["_rated"].dataType)), lambda x: x["cosine"] >= LEAST)
    start = F.struct(F.lit(0.0).alias("cosine"), F.lit(None).cast("string").alias("licence"), F.lit(0).alias("chars"))
    best = F.aggregate(good, start, lambda a, x: _better(a, x))
    out = rated.withColumn("_best", best).withColumn("licence_chars", F.aggregate(good, F.lit(0), lambda a, x: F.greatest(a, x["chars"])))
    has = F.col("_best.licence").isNotNull()
    return out.select("*", F.col("_best.licence").alias("licence"), F.when(has, F.round("_best.cosine", 6)).alias("cosine")).drop("_best", "_rated")


def _better(a: Column, x: Column) -> Column:
    higher = (x["cosine"] > a["cosine"]) | ((x["cosine"] == a["cosine"]) & (x["licence"] < a["licence"]))
    return F.struct(F.when(higher, x["cosine"]).otherwise(a["cosine"]).alias("cosine"), F.when(higher, x["licence"]).otherwise(a["licence"]).alias("licence"), F.when(higher, x["chars"]).otherwise(a["chars"]).alias("chars"))


def _rate(tokens: Column, chars: Column, unit: list[tuple[str, dict[str, float]]], weights: Column, other: float) -> Column:
    """(cosine, licence, chars) of a passage's best template."""
    tables = [(name, F.create_map(*(F.lit(x) for t, w in sorted(vector.items()) for x in (t, w)))) for name, vector in unit]
    start = F.struct(F.lit(0.0).alias("cosine"), F.lit(None).cast("string").alias("licence"), F.lit(0).alias("chars"))
    weigh = lambda t: F.coalesce(F.element_at(weights, t), F.lit(other))

    def longer(a: Column, t: Column) -> Column:
        """A word after the sorted ones before it: its k-th occurrence adds k * k - (k - 1) * (k - 1) squares of its weight to the norm's square."""
        k = F.when(t == a["last"], a["k"] + 1).otherwise(1)
        return F.struct(t.alias("last"), k.alias("k"), (a["square"] + (2 * k - 1) * weigh(t) * weigh(t)).alias("square"))

    nothing = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("k"), F.lit(0.0).alias("square"))
    norm = F.sqrt(F.aggregate(F.array_sort(tokens), nothing, longer)["square"])
    known = F.filter(tokens, lambda t: F.map_contains_key(weights, t))

    def options(v: Column) -> Column:
        return F.array(*(F.struct((_dot(v["known"], weights, table) / v["norm"]).alias("cosine"), F.lit(name).alias("licence"), chars.alias("chars")) for name, table in tables))

    # an array of one element binds what is worked out once to a name
    return F.aggregate(F.transform(F.array(F.struct(norm.alias("norm"), known.alias("known"))), options)[0], start, lambda a, x: _better(a, x))


def _dot(known: Column, weights: Column, table: Column) -> Column:
    """The sum over occurrences of template words."""
    return F.aggregate(known, F.lit(0.0), lambda a, t: a + F.element_at(weights, t) * F.coalesce(F.element_at(table, t), F.lit(0.0)))


def directory(path: Column) -> Column:
    """The directory of a path, "" at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), ""))


def scan(files: DataFrame) -> DataFrame:
    """A row for each row of files (path, text, and doc_id if there is one): licence, cosine, origin (own, inherited or none), from_path."""
    files = files.select(*(c for c in ("doc_id",) if c in files.columns), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = materialise(own_licences(files).withColumn("_dir", directory(F.col("path"))), "own")
    file = (F.col("path").rlike(NAMES) | (2 * F.col("licence_chars") > F.col("chars"))) & F.col("licence").isNotNull() & F.col("path").isNotNull()
    homes = materialise(own.where(file).groupBy("_dir").agg(F.min(F.struct("licence", "path")).alias("_home")), "homes")
    asks = own.where(F.col("licence").isNull() & F.col("_dir").isNotNull()).select("_dir").distinct()
    parts = F.split("_dir", "/")
    ups = F.sequence(F.lit(0), F.when(F.col("_dir") == "", 0).otherwise(F.size(parts)))
    above = asks.select("_dir", F.explode(F.transform(ups, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("up")))).alias("a")).select("_dir", "a.depth", "a.up")
    nearest = above.join(homes.withColumnRenamed("_dir", "up"), "up").groupBy("_dir").agg(F.max(F.struct("depth", "_home")).alias("_found"))
    nearest = materialise(nearest.select("_dir", "_found._home"), "nearest")
    out = own.join(broadcast_if_small(nearest, TEXT_BYTES), "_dir", "left")
    has = F.col("licence").isNotNull()
    origin = F.when(has, "own").when(F.col("_home").isNotNull(), "inherited").otherwise("none")
    keep = [c for c in files.columns if c != "text"]
    return out.select(*keep, F.coalesce("licence", "_home.licence").alias("licence"), "cosine", origin.alias("origin"), F.when(has, F.col("path")).otherwise(F.col("_home.path")).alias("from_path"))
