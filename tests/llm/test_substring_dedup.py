from __future__ import annotations

import random

import numpy as np
import pytest

from pastward.llm import substring_dedup as op
from pastward.llm import wordhash as wh
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(seed, n=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ü-x", "日本"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(30, 60))] for _ in range(6)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passages)[rnd.randint(0, 9) :] if rnd.random() < 0.5 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))]
        out.append((i, "".join(w + rnd.choice([" ", "\n", "\t ", "\x0b"]) for w in words)))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % op.PERIOD for a in op.COVER for b in op.COVER} == set(range(op.PERIOD))


@pytest.mark.parametrize("seed", range(3))
def test_equals_plain_version(spark, seed):
    rows = texts(seed)
    assert found(op.repeated_passages(spark.createDataFrame(rows, SCHEMA))) == sorted(brute.substring_dedup(rows, 35), key=repr)


def test_windows_of_the_exact_length_at_every_shift(spark):
    rnd = random.Random(5)
    passage = [f"p{i}" for i in range(35)]
    rows = []
    for i in range(44):
        n = 35 if i % 2 else 34
        rows.append((i, " ".join([f"a{rnd.random()}" for _ in range(i)] + passage[:n] + [f"b{rnd.random()}"])))
    assert found(op.repeated_passages(spark.createDataFrame(rows, SCHEMA))) == sorted(brute.substring_dedup(rows, 35), key=repr)


def test_edge_rows(spark):
    long = " ".join(f"x{i % 97}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, "  \n "), (None, "a b"), (4, long), (5, "one " * 40), (6, " ".join(map(str, range(50)))), (6, " ".join(map(str, range(50)))), (6, " ".join(map(str, range(60, 110))))]
    assert found(op.repeated_passages(spark.createDataFrame(rows, SCHEMA))) == sorted(brute.substring_dedup(rows, 35), key=repr)
    assert found(op.repeated_passages(spark.createDataFrame([], SCHEMA))) == []


def test_columns_are_carried(spark):
    words = " ".join(map(str, range(40)))
    rows = [(1, words + " tail", "m", 1.5), (2, words, None, None), (3, None, "x", 2.0), (4, "a\nb", "y", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, kept_text double")
    out = op.without_repeated_passages(df)
    assert out.columns == df.columns
    assert found(out) == sorted([(1, "tail", "m", 1.5), (2, "", None, None), (3, None, "x", 2.0), (4, "a\nb", "y", 0.0)], key=repr)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    data = np.frombuffer("alpha beta\tgamma  δελτα ".encode() * 50, np.uint8)
    words = wh.split_words(data, np.array([0, len(data)]))
    whole = wh.word_hashes(words, 1)
    monkeypatch.setattr(wh, "BLOCK_BYTES", 16)
    assert (wh.word_hashes(words, 1) == whole).all()
    assert len(set(whole.tolist())) == 4


def test_long_words_that_agree_at_every_base(spark):
    """Words made of a sequence and of its complement, whose polynomials agree modulo 2**64."""
    signs = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = ("".join("ab"[s ^ flip] for s in signs) for flip in (0, 1))
    words = wh.split_words(np.frombuffer(f"{a} {b}".encode(), np.uint8), np.array([0, 2 * 4096 + 1]))
    assert all(len(set(wh.word_hashes(words, seed).tolist())) == 2 for seed in (1, 3, 5))
    rows = [(1, " ".join([a] + [f"w{i}" for i in range(34)])), (2, " ".join([b] + [f"w{i}" for i in range(34)]))]
    assert {r.n_removed for r in op.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
