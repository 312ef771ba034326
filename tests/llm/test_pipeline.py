"""The registered queries against their SQL, and the pipeline against plain versions of its stages."""

from __future__ import annotations

import base64
import hashlib
import os
import random

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from pastward.llm import catalog
from tests.llm import brute
from tests.llm.brute import WORD
from tests.llm.test_decontamination import plain as plain_contamination
from tests.llm.test_language import plain as plain_language

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    got = catalog.QUERIES[name](spark, FOLDER)
    expected = con.sql(catalog.ORACLES[name])
    names = sorted(got.columns)
    assert sorted(expected.columns) == names
    order = [expected.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=repr)


def corpus(seed=1):
    rnd = random.Random(seed)
    words = {"en": "the of and tion ther with that hand".split(), "de": "der die und ung sch keit über".split()}

    def text(lang, n):
        return " ".join(rnd.choice(words[lang]) + str(rnd.randint(0, 30)) for _ in range(n))

    items = [(i, text("en", 20)) for i in range(4)]
    passage = text("en", 45)
    rows = []
    for i in range(90):
        lang = rnd.choice(["en", "de"])
        t = text(lang, rnd.randint(5, 150))
        kind = i % 9
        if kind == 1 and rows:
            old = rnd.choice(rows)
            t = " ".join(w if rnd.random() > 0.005 else "changed" for w in (old[1] or "x").split(" "))
        if kind == 2:
            t += "\n" + passage + "\n" + text(lang, 9)
        if kind == 3:
            t += " " + items[rnd.randrange(4)][1]
        if kind == 4:
            t = rnd.choice([None, "", "123 456 !", t])
        rows.append((i, t, lang, f"s{i % 3}", len(t or "")))
    return rows, items


def plain_pipeline(rows, items):
    known = {r[0] for r in plain_language([r[:3] for r in rows]) if r[2] != "und"}
    docs = [(d, t) for d, t, *_ in rows if d in known]
    kept = {r[0] for r in brute.near_dups(docs, percent=80) if r[3]}
    docs = [x for x in docs if x[0] in kept]
    left = []
    seen = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for w in split.values():
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    for d, t in docs:
        w = split[d]
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        left.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    bad = {r[0] for r in plain_contamination(left, items) if r[-1]}
    left = [x for x in left if x[0] not in bad]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    out = []
    for d, t in left:
        ids = library.encode_ordinary(t)
        out.append((d, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    return sorted(out)


def test_pipeline_equals_plain_versions(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = plain_pipeline(rows, items)
    assert 30 < len(expected) < 80
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == expected


def test_every_stage_but_the_last_keeps_the_columns(spark, tmp_path):
    rows, items = corpus(2)
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        assert all(r.n_chars == len(r.text or "") for r in out.collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_near_dedup_stage_links_texts_from_eighty_percent(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for k, changed in enumerate((7, 8, 9, 10, 11, 12)):  # of 100 words, the last ones: similarity 0.86, 0.85, 0.83, 0.81, 0.79, 0.78
        w = [f"w{rnd.randint(0, 10**6)}" for _ in range(100)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:-changed] + [f"x{k}y{i}" for i in range(changed)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in brute.near_dups(rows, percent=80) if r[3])
    assert got == [0, 2, 4, 6, 8, 9, 10, 11] and len([r for r in brute.near_dups(rows) if r[3]]) == 11


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, ids with several texts, and columns named like the operators' own."""
    rows, items = corpus(3)
    own = "row string, rest string, mark int, node long, once string, h int"
    more = ("r", None, 7, None, "o", 1)
    long = " ".join(f"the{i}and of tion ther" for i in range(40_000))
    odd = [(None, "the of and tion ther with that hand " * 3, None, None, None), (500, None, None, "s", None), (501, "", "en", None, 0), (502, long, "en", "s1", len(long))]
    odd += [(503, "ther with that hand of tion " * 4, "en", "s1", 112)] * 3 + [(503, "die und der sch keit ung " * 4, "de", "s1", 96)]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {own}"
    table = [(*r, *more) for r in rows[:50] + odd]
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*items, (None, None), (9, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    counts = [r.doc_id for r in out]
    # without letters: gone; repeated rows: one; an id with two texts is one document for the near-dedup
    assert 500 not in counts and 501 not in counts and counts.count(502) == 1 and 1 <= counts.count(503) <= 2 and None in counts
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
