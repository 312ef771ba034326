"""Licences of files: notices and licence files compared with templates, then inherited from the nearest directory above.

A template and a passage are sparse vectors of term weights: term count times inverse document frequency. A passage is a
line or sentence of a file, a run of consecutive ones (notices are wrapped over lines), or the whole of a licence file. Only passages that hold enough of a template's weight in its rarest terms
can reach the limit, so only those are compared (prefix filter for the cosine).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pastward.llm.work import Work, text_mark

LIMIT = 0.75
MOST_TERMS = 5000
PARTS = 32
TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense|notice)[^/]*$"

# fixed values: opening words and usual notices of public licences
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "CC0 1.0 Universal"),
}


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(template, licence, terms) of the given texts; as many rows as texts."""
    rows = [(f"{name}/{k}", name, text) for name, texts in sorted(templates.items()) for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template string, licence string, text string").select("template", "licence", terms(F.col("text")).alias("terms"))


def _weights(work: Work, said: DataFrame, templates: DataFrame) -> tuple[DataFrame, float]:
    """(term, idf) of all template terms, and the idf of a term that no file holds.

    Document frequencies count every file; a file sends a row for each template term that it holds.
    """
    vocabulary = templates.select(F.explode("terms").alias("term")).distinct()
    listed = [r["term"] for r in vocabulary.limit(MOST_TERMS + 1).collect()]
    if len(listed) > MOST_TERMS:
        raise ValueError(f"templates have at most {MOST_TERMS} different terms")
    files = said.count()
    held = said.select(F.explode(F.array_intersect("terms", F.array(*map(F.lit, listed)).cast("array<string>"))).alias("term"))
    held = held.groupBy("term").agg(F.count("*").alias("n"))
    idf = F.log((F.lit(float(files)) + 1) / (F.coalesce("n", F.lit(0)) + 1)) + 1
    return work.put(vocabulary.join(held, "term", "left").select("term", idf.alias("idf"))), math.log(files + 1.0) + 1


def _vectors(templates: DataFrame, weights: DataFrame) -> DataFrame:
    """(template, licence, term, w): unit vectors of the templates."""
    tf = templates.select("template", "licence", F.explode("terms").alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    w = tf.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, "template").select("template", "licence", "term", (F.col("w") / F.col("norm")).alias("w"))


def key_terms(vectors: DataFrame, limit: float) -> list[str]:
    """Terms one of which every passage holds whose cosine with a template is ``limit`` or more.

    Of a unit vector, the lightest terms of a total squared weight below ``limit`` squared cannot reach it alone; the others of each
    template are its key terms. As many as the templates have terms at most.
    """
    total = F.aggregate(F.filter(F.col("all"), lambda x: (x["w"] < F.col("w")) | ((x["w"] == F.col("w")) & (x["term"] <= F.col("term")))), F.lit(0.0), lambda a, x: a + x["w"] * x["w"])
    each = vectors.groupBy("template").agg(F.collect_list(F.struct("term", "w")).alias("all")).select("all", F.inline("all"))
    return [r["term"] for r in each.where(total >= limit * limit * (1 - 1e-9)).select("term").distinct().orderBy("term").collect()]


def passages(files: DataFrame, keys: Column, most: int) -> DataFrame:
    """(path, mark, at, pieces, terms): what is compared of files.

    A piece is a line, or a sentence of it; pieces without terms are left out. Passages are single pieces (pieces 1), runs of
    two or more consecutive ones of ``most`` terms together at most (at is the first), and licence files as a whole (at -1,
    pieces 0). Marks of comments are no terms. Only passages with one of the terms in ``keys`` are given.
    """
    text = F.coalesce("text", F.lit(""))

    def of(pieces: Column) -> Column:
        return F.filter(F.transform(pieces, lambda s, i: F.struct(i.alias("at"), terms(s).alias("terms"))), lambda x: F.size(x["terms"]) > 0)

    cut = files.select("path", "mark", _bound(F.split(text, r"\n|(?<=[.!?;])\s+"), of).alias("cut"), terms(text).alias("all"))
    # the pieces from each one on that fit together, where any has a key
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("terms"))

    def reach(cut: Column) -> Column:
        def fitting(i: Column) -> Column:
            def more(acc: Column, x: Column) -> Column:
                total = acc["terms"] + F.size(x["terms"])
                return F.struct((acc["n"] + F.when(total <= most, 1).otherwise(0)).alias("n"), total.alias("terms"))

            return F.slice(cut, i + 1, F.greatest(F.aggregate(F.slice(cut, i + 1, F.lit(max(most, 1))), start, more)["n"], F.lit(1)))

        firsts = F.filter(F.sequence(F.lit(0), F.size(cut) - 1), lambda i: F.exists(fitting(i), lambda x: F.arrays_overlap(x["terms"], keys)))
        return F.when(F.size(cut) > 0, F.transform(firsts, fitting))

    runs = cut.select("path", "mark", F.explode(_bound(F.col("cut"), reach)).alias("run"))
    ends = runs.select("path", "mark", "run", F.explode(F.sequence(F.lit(1), F.size("run"))).alias("pieces"))
    said = F.flatten(F.slice(F.col("run.terms"), F.lit(1), F.col("pieces")))
    rows = ends.select("path", "mark", F.col("run")[0]["at"].alias("at"), "pieces", said.alias("terms"))
    whole = cut.where(F.col("path").rlike(LICENCE_FILE)).select("path", "mark", F.lit(-1).alias("at"), F.lit(0).alias("pieces"), F.col("all").alias("terms"))
    return rows.unionByName(whole).where(F.arrays_overlap("terms", keys))


def own_licences(files: DataFrame, templates: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(path, mark, licence, cosine, at) of the files with a passage like a template: the most alike, ties by place and name."""
    work = Work(files.sparkSession)
    keyed = files.select("path", text_mark(F.col("text")).alias("mark"), "text")
    said = keyed.select("path", "mark", "text", terms(F.col("text")).alias("terms"))
    weights, rare = _weights(work, said, templates)
    vectors = work.put(_vectors(templates, weights))
    keys = F.array(*map(F.lit, key_terms(vectors, limit))).cast("array<string>")
    longest = templates.agg(F.max(F.size("terms"))).first()[0] or 0
    # with terms of equal weight, a longer run that holds a whole template stays below the limit
    found = passages(said.where(F.arrays_overlap("terms", keys)), keys, math.ceil(longest / limit**2))
    place = ["path", "mark", "at", "pieces"]
    tf = found.select(*place, F.explode("terms").alias("term")).groupBy(*place, "term").agg(F.count("*").alias("tf"))
    weighed = tf.join(F.broadcast(weights), "term", "left")  # at most MOST_TERMS rows, vectors as many per template
    weighed = work.put(weighed.select(*place, "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("w")))
    norms = weighed.groupBy(*[F.col(c).alias(f"of_{c}") for c in place]).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(vectors.withColumnRenamed("w", "tw"), "term").groupBy(*place, "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    same = dots["path"].eqNullSafe(norms["of_path"]) & (dots["mark"] == norms["of_mark"]) & (dots["at"] == norms["of_at"]) & (dots["pieces"] == norms["of_pieces"])
    alike = dots.join(norms, same).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("cosine") >= limit)
    best = F.max(F.struct("cosine", (-F.col("at")).alias("before"), "licence"))
    out = alike.groupBy("path", "mark").agg(best.alias("b"))
    return out.select("path", "mark", "b.licence", "b.cosine", (-F.col("b.before")).alias("at"))


def parent(path: Column) -> Column:
    """The directory of a path, without a slash at its end; of the root's own entries it is empty."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def directories(path: Column) -> Column:
    """All directories above a path as (directory, depth), the root (empty, 0) included; null for a null path."""
    parts = F.filter(F.split(parent(path), "/"), lambda p: p != "")
    return F.when(path.isNotNull(), F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above"), k.alias("depth"))))


def scan(files: DataFrame, templates: DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """The licence of each file: path, mark (tells apart different texts with one path), licence, how, cosine, source.

    ``files`` has path and text. how is ``own`` (a notice or the licence file itself), ``inherited`` (from a licence file in the
    nearest directory above; ``source`` is that directory) or null. One row for each row of ``files``; repeated rows get equal
    results. Null and empty texts have no notice but inherit; a null path neither has a directory nor gives one. Of several
    licence files in a directory the most alike counts, ties by name. Paths are split at slashes; a leading one is ignored.
    Other columns are not read.
    """
    spark = files.sparkSession
    templates = template_table(spark) if templates is None else templates
    work = Work(spark)
    keyed = files.select("path", text_mark(F.col("text")).alias("mark"))
    own = work.put(own_licences(files, templates, limit))
    givers = own.where(F.col("path").rlike(LICENCE_FILE)).select(F.element_at(directories(F.col("path")), -1)["above"].alias("above"), "licence", "cosine")
    givers = givers.groupBy("above").agg(F.max(F.struct("cosine", "licence")).alias("given"))
    dirs = keyed.select(F.element_at(directories(F.col("path")), -1)["above"].alias("dir")).where("dir is not null").distinct()
    above = dirs.select("dir", F.inline(directories(F.concat("dir", F.lit("/x")))))
    # one directory may hold most files or lie above most directories, so both are dealt out by a part of their hash too
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    above = above.withColumn("part", F.pmod(F.xxhash64("dir"), F.lit(PARTS)).cast("int"))
    nearest = above.join(givers.withColumn("part", parts), ["above", "part"]).groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("g"))
    part = F.pmod(F.xxhash64("path", "mark"), F.lit(PARTS)).cast("int")
    nearest = nearest.withColumn("part", parts)
    rows = keyed.withColumn("dir", F.element_at(directories(F.col("path")), -1)["above"]).withColumn("part", part).join(nearest, ["dir", "part"], "left")
    mine = own.select(F.col("path").alias("of_path"), F.col("mark").alias("of_mark"), F.col("licence").alias("own"), F.col("cosine").alias("own_cosine"))
    rows = rows.join(mine, rows["path"].eqNullSafe(mine["of_path"]) & (rows["mark"] == mine["of_mark"]), "left")
    has, given = F.col("own").isNotNull(), F.col("g").isNotNull()
    return rows.select(
        "path",
        "mark",
        F.coalesce("own", "g.given.licence").alias("licence"),
        F.when(has, "own").when(given, "inherited").alias("how"),
        F.coalesce("own_cosine", "g.given.cosine").alias("cosine"),
        F.when(~has & given, F.col("g.above")).alias("source"),
    )
