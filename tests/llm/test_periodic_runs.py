from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from pastward.llm import periodic_runs as op

SCHEMA = "doc_id long, text string"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w):
    """Every maximal stretch of every distance; of equal stretches the smallest distance is the period."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                out.setdefault((s, i - s + q), q)
            i += i == s
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = plain_planted(doc_id, plain_words(text))
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)),
    )


def plain_lyndon(s):
    return [max(j - i for j in range(i + 1, len(s) + 1) if all(s[i:j] < s[k:j] for k in range(i + 1, j))) for i in range(len(s))]


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in op.digests(op.periodic_runs(op.with_planted_runs(docs))).collect()), key=repr)


def texts(seed, n=80):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = []
        for _ in range(rnd.randint(0, 6)):
            unit = [f"w{rnd.randrange(rnd.choice([2, 3, 40]))}" for _ in range(rnd.randint(1, 12))]
            words += unit * rnd.choice([1, 1, 2, 3, 4, 5, 7])
            words += unit[: rnd.randint(0, len(unit))]
        out.append((i, "".join(w + rnd.choice([" ", "\n", "\t "]) for w in words)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_lyndon_lengths_by_their_definition(seed):
    rnd = random.Random(seed)
    for _ in range(200):
        size = rnd.randint(1, 4)
        symbols = [rnd.randrange(size) for _ in range(rnd.randint(0, 22))]
        assert op.lyndon_lengths(symbols, size) == plain_lyndon(symbols)
        assert op.lyndon_lengths([size - 1 - s for s in symbols], size) == plain_lyndon([size - 1 - s for s in symbols])


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_plain_version(seed):
    rnd = random.Random(seed)
    for _ in range(300):
        unit = [rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 6))]
        words = [rnd.randrange(3) for _ in range(rnd.randint(0, 8))] + unit * rnd.randint(1, 8) + [rnd.randrange(3) for _ in range(rnd.randint(0, 8))]
        assert sorted(op.runs_of(words)) == plain_runs(words)


@pytest.mark.parametrize("seed", range(3))
def test_query_equals_plain_version(spark, seed):
    rows = texts(seed)
    assert found(spark, rows) == sorted((plain_row(*r) for r in rows), key=repr)


def test_edge_rows(spark):
    long = " ".join(f"x{i % 1009}" for i in range(60_000)) + " " + " ".join(f"y{i}" for i in range(60_000))
    same = (6, "a b " * 9)
    rows = [(1, None), (2, ""), (3, "  \n "), (None, "a b " * 5), (4, long), (5, "one " * 40), same, same, (6, "other"), (7, "a a a a a"), (8, "a a a a a a"), (9, "é日 " * 6)]
    runs = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in op.periodic_runs(spark.createDataFrame(rows[:6] + rows[9:], SCHEMA)).collect()}
    assert runs == {1: [], 2: [], 3: [], None: [(0, 10, 2)], 4: [(0, 60_000, 1009)], 5: [(0, 40, 1)], 7: [], 8: [(0, 6, 1)], 9: [(0, 6, 1)]}
    short = [r for r in rows if r[0] != 4]
    assert found(spark, short) == sorted((plain_row(*r) for r in short), key=repr)
    assert found(spark, []) == []


def test_other_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(30, "a b " * 20, "x", 1)], SCHEMA + ", h string, runs int")
    assert op.with_planted_runs(docs).columns == docs.columns
    assert op.periodic_runs(op.with_planted_runs(docs)).columns == ["doc_id", "n_words", "runs", "collapsed"]
