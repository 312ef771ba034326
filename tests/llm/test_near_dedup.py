from __future__ import annotations

import random

import numpy as np
import pytest

from pastward.llm import near_dedup as op
from pastward.llm import wordhash as wh
from pastward.llm.components import connected
from pastward.llm.work import Work
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def found(df):
    return sorted((tuple(r) for r in df.drop("mark").collect()), key=repr)


def copies(seed, n=120):
    """Texts edited again and again from few originals, so that links form chains, stars and near misses."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([3, 6, 40, 200]))] for _ in range(8)]
    out = []
    for i in range(n):
        if i < 40:
            t = list(rnd.choice(base))
        else:
            t = rnd.choice(out).split()
        for _ in range(rnd.randint(0, max(1, len(t) // 40))):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        out.append(" ".join(x.upper() if rnd.random() < 0.1 else x for x in t))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rows = copies(seed)
    assert found(op.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85)) == sorted(brute.near_dups(rows), key=repr)


def test_a_base_whose_copies_are_linked_through_it_alone(spark):
    rnd = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = [(99, " ".join(base))]
    for i in range(40):
        t = list(base)
        for k in range(4):
            t[rnd.randrange(300)] = f"x{i}-{k}"
        rows.append((i, " ".join(t)))
    expected = sorted(brute.near_dups(rows), key=repr)
    assert len({r[2] for r in expected}) == 1
    assert found(op.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=85)) == expected


def test_edge_rows(spark):
    long = " ".join(f"x{i % 997}" for i in range(100_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c d e"), (9, "a b c d e"), (9, "a b c d e"), (None, "q r s t u v"), (None, "q r s t u v"), (8, long), (7, long + " y"), (None, None)]
    df = spark.createDataFrame([(*r, 1.0, "m") for r in rows], SCHEMA + ", mark double, component_id string")
    assert found(op.near_duplicates(df, percent=85)) == sorted([(*r[:3], r[0] == r[2]) for r in brute.near_dups(rows)[:-1]] + [(None, 0, None, True)], key=repr)
    left = op.one_of_each(df, percent=85)
    assert left.columns == df.columns
    assert sorted((r[0] for r in left.collect()), key=repr) == sorted([1, 2, 3, 4, 6, 7, None, None], key=repr)
    assert found(op.near_duplicates(spark.createDataFrame([], SCHEMA))) == []


def test_bins_agree_as_often_as_sets():
    rnd = random.Random(3)
    for size in (6, 40, 300, 2000):
        rates = []
        for _ in range(20):
            common = [rnd.getrandbits(64) for _ in range(size)]
            more = [[rnd.getrandbits(64) for _ in range(size // 6)] for _ in range(2)]
            sets = [np.sort(np.array(common + m, np.uint64)) for m in more]
            sign = op.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
            rates.append((sign[0] == sign[1]).mean())
        alike = size / (size + 2 * (size // 6))
        assert abs(np.mean(rates) - alike) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (20, 20), (30, 31), (31, 30)] + [(100 + i, 101 + i) for i in range(40)]
    roots = dict(tuple(r) for r in connected(Work(spark), spark.createDataFrame(edges, "a long, b long")).collect())
    assert roots == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 10: 7, 30: 30, 31: 30} | {100 + i: 100 for i in range(41)}


def test_shingle_sets_of_short_texts():
    data = np.frombuffer(b"a b  A B" + b"x", np.uint8)
    values, first = op.shingle_sets(wh.split_words(data, np.array([0, 8, 8, 9]), lower=True), 5)
    assert first.tolist() == [0, 1, 1, 2] and len(set(values.tolist())) == 2


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    compared, real = [], op._confirmed
    monkeypatch.setattr(op, "_confirmed", lambda texts, pairs, width, percent: compared.append(texts.join(pairs, texts["node"] == pairs["a"]).count()) or real(texts, pairs, width, percent))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 400 + [(2, " ".join([*words[:-1], "end"]))] * 400
    got = op.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert {r.component_id for r in got} == {1} and sum(compared) == 1
