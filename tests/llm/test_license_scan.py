from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pastward.llm import catalog
from pastward.llm import license_scan as op

TERM = re.compile(op.TERM)


def plain(files):
    """(path, licence, how, cosine, source) by comparing every sentence with every template."""
    terms = lambda s: TERM.findall((s or "").lower())
    df = Counter(t for _, x in files for t in set(terms(x)))
    idf = lambda t: math.log((len(files) + 1) / (df[t] + 1)) + 1 if t in vocabulary else math.log(len(files) + 1) + 1
    templates = [(name, Counter(terms(t))) for name, texts in op.TEMPLATES.items() for t in texts]
    vocabulary = {t for _, c in templates for t in c}

    def cosine(a, b):
        wa, wb = ({t: n * idf(t) for t, n in x.items()} for x in (a, b))
        norm = math.sqrt(sum(v * v for v in wa.values()) * sum(v * v for v in wb.values()))
        return round(sum(v * wb.get(t, 0) for t, v in wa.items()) / norm, 9) if norm else 0

    own = {}
    for path, text in files:
        said = [(i, s) for i, s in enumerate(re.split(r"\n|(?<=[.!?;])\s+", text or ""))]
        if path and re.search(op.LICENCE_FILE, path):
            said.append((-1, text or ""))
        best = max(((c, -i, name) for i, s in said for name, t in templates if (c := cosine(Counter(terms(s)), t)) >= op.LIMIT), default=None)
        own[path, text] = best
    givers = {}
    folder = lambda p: tuple(x for x in p.split("/")[:-1] if x)
    for (path, _), best in own.items():
        if best and path and re.search(op.LICENCE_FILE, path):
            d = folder(path)
            givers[d] = max(givers.get(d, (0, "")), (best[0], best[2]))
    out = []
    for path, text in files:
        best = own[path, text]
        if best:
            out.append((path, best[2], "own", best[0], None))
            continue
        d = folder(path) if path is not None else None
        while d is not None and d not in givers:
            d = d[:-1] if d else None
        out.append((path, givers[d][1], "inherited", givers[d][0], "/".join(d)) if d is not None else (path, None, None, None, None))
    return sorted(out, key=repr)


FILES = [
    ("a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("a/b/c/x.py", "import this\nprint(1)"),
    ("a/b/LICENSE.txt", "Apache License\nVersion 2.0, January 2004\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("a/y.py", "# the header\n# SPDX-License-Identifier: GPL-3.0-or-later\ncode()"),
    ("a/z.py", "words of a licence that is no licence at all"),
    ("/c/d/e.txt", "Prose. Licensed under the Apache License, Version 2.0. More prose of many other words here"),
    ("c/d/f.txt", "This work is licensed under the GNU General Public License, version 3."),
    ("c/d/g.txt", "the public and the general work on the terms of this and that version of it"),
    ("c/d/h.txt", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."),
    ("c/NOTICE", "nothing of use"),
    ("top.txt", None),
    ("a/empty.txt", ""),
    (None, "Released under the MIT License."),
    (None, None),
    ("a/b/c/x.py", "import this\nprint(1)"),
    ("a/b/c/long.py", "word " * 60000 + "\nReleased under the MIT License."),
]


def found(df):
    return sorted((tuple(r) for r in df.drop("mark").collect()), key=repr)


def test_equals_plain_version(spark):
    files = spark.createDataFrame([(*f, "x", 1) for f in FILES], "path string, text string, licence string, dir int")
    expected = plain(FILES)
    assert {r[2] for r in expected} == {"own", "inherited", None}
    assert found(op.scan(files)) == expected


def test_a_licence_file_at_the_root_covers_all(spark):
    files = [("LICENSE", "Released under the MIT License."), ("x", "a"), ("p/q/r", "b")]
    got = found(op.scan(spark.createDataFrame(files, "path string, text string")))
    assert [(r[0], r[1], r[2]) for r in got] == [("LICENSE", "MIT", "own"), ("p/q/r", "MIT", "inherited"), ("x", "MIT", "inherited")]


def test_empty_tables_and_too_many_terms(spark, monkeypatch):
    none = spark.createDataFrame([], "path string, text string")
    assert found(op.scan(none)) == []
    files = spark.createDataFrame([("a", "Released under the MIT License.")], "path string, text string")
    assert found(op.scan(files, op.template_table(spark, {"X": ("",)}))) == [("a", None, None, None, None)]
    monkeypatch.setattr(op, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        op.scan(files)


def test_the_query_has_licence_files_and_files_that_inherit(spark, tmp_path):
    notices = ["Released under the MIT License.", "Licensed under CC BY 4.0", "SPDX-License-Identifier: GPL-2.0-only"]
    docs = [(i, f"Some words {i}.\n" + (notices[i % 3] if random.Random(i).random() < 0.5 else "no more"), f"s{i % 5}" if i % 7 else None, "en" if i % 3 else "de") for i in range(400)]
    docs += [(None, "a", "s1", "en"), (-22, notices[0], "s1", "en"), (77, notices[1], "s1", "en"), (40_001, None, "s1", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["op3_license_scan"](spark, str(tmp_path))
    files = [tuple(r) for r in df.select(catalog.file_path(), "text").collect()]
    assert found(got.drop("doc_id")) == plain(files)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows if r.path) == sorted(d[0] for d in docs if d[0] is not None)
    inherited = [r for r in rows if r.how == "inherited"]
    assert len(inherited) > 100 and {r.source.count("/") for r in inherited} == {0, 1, 2, 3}
    assert len({r.source for r in inherited}) > 10
    more = df.where("doc_id >= 0").select((F.col("doc_id") + 20_020).alias("doc_id"), "text", "source", "lang")
    more.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["op3_license_scan"](spark, str(tmp_path)).where("how = 'inherited'").select("source").distinct().count() > len({r.source for r in inherited})


def test_a_null_path_inherits_nothing_from_the_root(spark):
    files = [("LICENSE", "Released under the MIT License."), (None, "a"), ("x", "b")]
    assert found(op.scan(spark.createDataFrame(files, "path string, text string"))) == plain(files)


WRAPPED = {
    "MIT": """# MIT License
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
import os""",
    "BSD-3-Clause": """/*
 * Copyright 2020 Somebody. All rights reserved.
 *
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are
 * met:
 *
 * 1. Redistributions of source code must retain the above copyright
 */
int main;""",
    "GPL-3.0": """// a tool of mine

// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
// This program is distributed in the hope that it will be useful,
code();""",
}


def test_notices_wrapped_over_lines_are_found(spark):
    files = [(f"s/{name}.c", text) for name, text in WRAPPED.items()]
    others = [(f"s/{i}.txt", f"words {i} of the other files and the work in the terms of a version") for i in range(200)]
    got = {r.path: r for r in op.scan(spark.createDataFrame(files + others, "path string, text string")).collect()}
    assert {name: got[f"s/{name}.c"].licence for name in WRAPPED} == {name: name for name in WRAPPED}
    assert all(got[path].licence is None for path, _ in others)


def test_passages_are_all_runs_with_a_key(spark):
    lines = ["a key b", "", "c d. e f", "g", "h i j k", "l m n o p q", "key"]
    df = spark.createDataFrame([("x", 1, "\n".join(lines)), ("LICENSE", 2, "r key\ns"), ("y", 3, ""), ("LICENSE.y", 4, None)], "path string, mark int, text string")
    got = [(r.path, r.at, r.pieces, r.terms) for r in op.passages(df, F.array(F.lit("key")), 7).collect()]
    pieces = [(0, ["a", "key", "b"]), (2, ["c", "d"]), (3, ["e", "f"]), (4, ["g"]), (5, ["h", "i", "j", "k"]), (6, ["l", "m", "n", "o", "p", "q"]), (7, ["key"])]
    want = []
    for i, (at, _) in enumerate(pieces):
        for n in range(1, len(pieces) - i + 1):
            said = [t for _, x in pieces[i : i + n] for t in x]
            if "key" in said and (n == 1 or len(said) <= 7):
                want.append(("x", at, n, said))
    want += [("LICENSE", -1, 0, ["r", "key", "s"]), ("LICENSE", 0, 1, ["r", "key"]), ("LICENSE", 0, 2, ["r", "key", "s"])]
    assert sorted(got) == sorted(want)
