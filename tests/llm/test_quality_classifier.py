from __future__ import annotations

import random

import numpy as np
import pytest

from pastward.llm import quality_classifier as op

DOCS = "doc_id long, text string, lang string, source string"


def rows(seed, n=600):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        words = [rnd.choice("alpha beta gamma delta the of and to in".split()) for _ in range(rnd.randint(5, 80))]
        if not good:
            words = [w + rnd.choice(["%%%", "###", "&&&"]) if rnd.random() < 0.8 else w for w in words]
        docs.append((i, " ".join(words), rnd.choice(["en", None]), f"s{rnd.randint(0, 3)}"))
        labels.append((i, int(good)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = rows(1)
    given = [x for x in labels if x[0] % 4 == 0]
    out = op.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(given, "doc_id long, quality int")).collect()
    return {r.doc_id: r for r in out}, dict(labels)


def test_held_out_rows_are_told_apart(scored):
    got, truth = scored
    assert sorted(got) == sorted(truth)
    held = [r for r in got.values() if r.held_out]
    assert 120 < len(held) < 280
    assert np.mean([r.kept == bool(truth[r.doc_id]) for r in held]) > 0.97


def test_scores_are_probabilities(scored):
    got, truth = scored
    assert all(0 <= r.score <= 1 and r.kept == (r.score >= 0.5) for r in got.values())
    brier = np.mean([(r.score - truth[r.doc_id]) ** 2 for r in got.values() if r.held_out])
    assert brier < 0.05


def test_pseudo_labels_are_exchanged(spark, monkeypatch):
    docs, labels = rows(2, 300)
    seen = []
    fit = op._fit
    monkeypatch.setattr(op, "_fit", lambda df, view: (seen.append((view, df.count())), fit(df, view))[1])
    op.score(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:100], "doc_id long, quality int"))
    sizes = {v: [n for w, n in seen if w == v] for v in op.VIEWS}
    assert all(len(s) == op.ROUNDS + 1 and s[-1] > s[0] for s in sizes.values())


def test_edge_rows(spark):
    docs = [(1, None, None, None), (2, "", "en", "a"), (None, "x y", "en", "a"), (3, "w " * 100000, "en", "a"), (4, "a", "en", "a"), (4, "a", "en", "a")]
    df = spark.createDataFrame([(*d, 1.0, "q") for d in docs], DOCS + ", score double, label string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in op.score(df, none).collect()] == [0.5] * 6
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (2, None)], "doc_id long, quality int")
    assert {r.score for r in op.score(df, one).collect()} <= {0.5, 1.0}
    assert op.score(df.limit(0), one).collect() == []
    more, labels = rows(3, 200)
    both = df.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(d + 100, *x) for d, *x in more], DOCS))
    got = op.score(both, spark.createDataFrame([(d + 100, q) for d, q in labels], "doc_id long, quality int")).collect()
    assert len(got) == 206 and all(0 <= r.score <= 1 for r in got)


def test_every_source_takes_part(spark, monkeypatch, tmp_path):
    """Verdicts come from all unlabelled rows: of a source of ten rows among thousands every sure one is handed over; checked against a plain draw."""
    monkeypatch.setattr(op, "GIVEN", 60)
    rated = [(i, "en", "big", (-1) ** i * 9.0) for i in range(4000)] + [(5000 + i, None, "rare", 8.0) for i in range(10)] + [(6000, "en", "big", 0.5), (6001, "en", None, None)]
    df = spark.createDataFrame(rated, "doc_id long, lang string, source string, m double")
    got = op._verdicts(op.Work(spark), df, "m", 0).collect()
    assert {r.doc_id for r in got if r.doc_id >= 5000} == {5000 + i for i in range(10)}
    assert all(r.label == (r.doc_id % 2 == 0 or r.doc_id >= 5000) for r in got)
    hashes = {r[0]: r[1] for r in df.selectExpr("doc_id", "pmod(xxhash64(0, 4, doc_id), 1099511627776) / 1099511627776D").collect()}
    sizes = {("big", 1): 2000, ("big", 0): 2000, ("rare", 1): 10}
    plain = {i for i, _, s, m in rated if m is not None and abs(m) > 3 and hashes[i] * sizes[s, int(m > 0)] * 3 < 60}
    assert {r.doc_id for r in got} == plain and 20 < len(got) < 90
