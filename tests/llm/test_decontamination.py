from __future__ import annotations

import random
import re

import pytest

from pastward.llm import decontamination as op
from tests.llm.brute import sha

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=13):
    wanted = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window + 1, 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for x, ids in wanted.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    named.update(str(k) for k in ids if k is not None)
        out.append((doc_id, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def data(seed):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "Été", "日本", "x1", "2"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(1, 13)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 6)):
            w = rnd.choice(items)[1].split()
            lo = rnd.randint(0, 2)
            parts += w[lo:] if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))]
        docs.append((i, "".join(x.upper() + rnd.choice([" ", "-", "\n", "_", "."]) for x in parts)))
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [op.MOST_BROADCAST, 0])
@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_version(spark, monkeypatch, seed, most):
    monkeypatch.setattr(op, "MOST_BROADCAST", most)
    docs, items = data(seed)
    got = op.contamination(*frames(spark, docs, items)).drop("mark").collect()
    assert sorted(map(tuple, got), key=repr) == plain(docs, items)


def test_edge_rows(spark):
    items = [(1, None), (2, ""), (3, "rare words here"), (3, "other words there"), (None, "odd one"), (4, "rare words here"), (4, "rare words here")]
    docs = [(1, None), (2, ""), (None, "so RARE words here"), (3, "odd one"), (4, "odd one " + "pad " * 100), (5, "rare words here"), (5, "rare words here"), (5, "other thing"), (6, "a " * 50000 + "rare words here")]
    d, i = frames(spark, docs, items)
    expected = plain(docs, items)
    assert sorted(map(tuple, op.contamination(d, i).drop("mark").collect()), key=repr) == expected
    wide = d.selectExpr("*", "'m' mark", "1.5 n_words", "text w", "'z' word")
    left = op.without_contaminated(wide, i)
    assert left.columns == wide.columns and left.count() == sum(not r[-1] for r in expected)
    assert op.contamination(d.limit(0), i).collect() == []
    assert {r.contaminated for r in op.contamination(d, i.limit(0)).collect()} == {False}
