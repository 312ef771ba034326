from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pastward.llm import language as op

SCHEMA = "doc_id long, text string, lang string"
WORDS = {"aa": "lal lom opal molap apo lamp".split(), "bb": "tré stix été xist retix sé".split(), "日": "語日 本語 日本語 本".split()}


def grams(text):
    out = Counter()
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
            continue
        padded = f" {word} "
        for n in range(1, op.LONGEST + 1):
            for i in range(len(padded) - n + 1):
                if word and padded[i : i + n].strip():
                    out[padded[i : i + n]] += 1
        word = ""
    return out


def code(gram):
    value = 0
    for c in gram:
        value = (value << 21) | ord(c)
    return int(op.wh.mix(np.array([value], np.uint64))[0] >> np.uint64(12))


def ranked(counts):
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][: op.TOP]


def plain(rows):
    learnt = {}
    for d, t, lang in rows:
        if d is not None and t is not None and lang is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            learnt.setdefault(lang, Counter()).update(grams(t))
    known = sorted((lang, ranked(c)) for lang, c in learnt.items() if c)
    out = []
    for d, t, _ in rows:
        own = ranked(grams(t))
        costs = [sum(min(abs(p.index(g) - r), op.TOP) if g in p else op.TOP for r, g in enumerate(own)) for _, p in known]
        held = d is not None and zlib.crc32(str(d).encode()) % 3 == 1
        if own and known:
            best = min(range(len(costs)), key=lambda i: costs[i])
            out.append((d, held, known[best][0], round(1 - costs[best] / (len(own) * op.TOP), 12)))
        else:
            out.append((d, held, "und", 0.0))
    return sorted(out, key=repr)


def sample(seed, n=200):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice(WORDS[lang]) + rnd.choice([" ", ", ", "\n", "1", "--"]) for _ in range(rnd.randint(1, 30))), lang) for i in range(n) for lang in [rnd.choice(list(WORDS))]]


def found(df):
    return sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 12)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_equals_plain_version_and_is_right(spark, seed):
    rows = sample(seed)
    got = found(op.predict(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows)
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([truth[d] == p for d, held, p, _ in got if held]) > 0.97


def test_edge_rows(spark, monkeypatch):
    rows = sample(3, 40) + [(100, None, "aa"), (101, "", "bb"), (102, "123 ?!", None), (None, "lal lom", "aa"), (103, "LAL LOM OPAL", None), (104, "lom " * 5000, "aa"), (104, "lom " * 5000, "aa"), (105, "ẞİK", "aa"), (106, "", "cc")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA + ", lang_pred string, score double")
    expected = plain(rows)
    assert found(op.predict(df)) == expected
    kept = op.recognised(df)
    assert kept.columns == df.columns and kept.count() == sum(r[2] != "und" for r in expected)
    assert found(op.predict(df.limit(0))) == []
    assert {r.lang_pred for r in op.predict(df.where("doc_id = 100")).collect()} == {"und"}


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(WORDS["bb"]) for _ in range(400)), "ab", None]
    whole = op.gram_counts(texts)
    monkeypatch.setattr(op, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, op.gram_counts(texts)))


def test_the_text_goes_to_the_tasks_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the cat and the dog", "en", 7), (2, None, "en", 8), (4, "le chat et le chien", "fr", 9)], "doc_id long, TEXT string, lang string, `row` long")
    sent = []
    map_in_arrow = type(df).mapInArrow

    def spy(self, *rest, **more):
        sent.append(self.schema.simpleString().lower().count("text:string"))
        return map_in_arrow(self, *rest, **more)

    monkeypatch.setattr(type(df), "mapInArrow", spy)
    kept = op.recognised(df)
    assert sent and set(sent) == {1}
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "the cat and the dog", "en", 7), (4, "le chat et le chien", "fr", 9)]
