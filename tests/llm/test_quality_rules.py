from __future__ import annotations

import random
import re

import duckdb
import pytest

from pastward.llm import quality_rules as op
from tests.llm.brute import WORD


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def texts(seed, n=150):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        few = [f"é{rnd.randint(0, 9)}" for _ in range(rnd.choice([2, 20]))]
        parts = [rnd.choice(few) + rnd.choice([" ", "\n", "\t", " \x0b", "# ", "&&&\n"]) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.3:
            parts = parts + parts[: rnd.randint(0, 9)] + parts
        out.append((i, "".join(parts), rnd.choice(["en", "de", None]), rnd.choice(["a", "b"])))
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("seed", range(2))
def test_counts_and_verdicts(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in op.judged(df).collect()}
    for doc_id, text, *_ in rows:
        r, want = got[doc_id], base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    documents = df.toPandas()  # noqa: F841
    expected = duckdb.sql(op.SQL).fetchall()
    assert sorted(map(tuple, got.values())) == sorted(expected)


def test_outliers_go_and_the_bulk_stays(spark):
    rnd = random.Random(9)
    plain = [(i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(200)), "en", "a") for i in range(300)]
    noisy = [(1000 + i, " ".join(f"w{rnd.randint(0, 10**6)}###$$$" for _ in range(200)), "en", "a") for i in range(5)]
    other = [(2000 + i, " ".join(f"w{rnd.randint(0, 10**6)}###$$$" for _ in range(200)), "en", "code") for i in range(50)]
    kept = {r.doc_id for r in op.judged(spark.createDataFrame(plain + noisy + other, SCHEMA)).where("kept").collect()}
    assert kept == {r[0] for r in plain + other}


def test_edge_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", None), (None, "a b c d e f g h i j k", "en", "x"), (4, "x y z " * 30000, "en", "x"), (5, "\n\n \n", "en", "x"), (6, "a b c d e f g h i j", "en", "x"), (6, "a b c d e f g h i j", "en", "x"), (7, "long" * 50000, "en", "x")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", n_words int, kept string")
    got = op.judged(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id == 4:
            assert (r.n_words, r.n_repeat_words, r.base_failed) == (90000, 90000, True)
        if r.doc_id in (None, 6):
            assert r.kept
    assert op.judged(df.limit(0)).collect() == []


def test_sketches_merge_and_bound_the_error(spark):
    rnd = random.Random(4)
    values = [int(rnd.paretovariate(0.6)) for _ in range(5000)]
    rows = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "part int, value long")
    whole = {r.bucket: r.n for r in op.sketch(rows, []).collect()}
    parts = op.sketch(rows, ["part"]).groupBy("bucket").sum("n").collect()
    assert whole == {r[0]: r[1] for r in parts}
    q = op.quantiles(op.sketch(rows.withColumn("g", rows.part * 0), ["g"]), ["g"], middle=(1, 2), high=(9, 10)).collect()[0]
    for name, share in (("middle", 0.5), ("high", 0.9)):
        true = sorted(values)[int(share * 5000) - 1]
        assert q[name] <= true <= q[name] * 1.04


def test_a_third_of_a_source_that_is_junk_goes(spark):
    rnd = random.Random(11)
    good = [(i, " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(50, 300))) + " #1", "en", "a") for i in range(200)]
    for marks, junk_rows in (("###", 99), ("&", 60)):
        junk = [(1000 + i, " ".join(f"w{rnd.randint(0, 10**6)}{marks}" for _ in range(100)), "en", "a") for i in range(junk_rows)]
        kept = {r.doc_id for r in op.judged(spark.createDataFrame(good + junk, SCHEMA)).where("kept").collect()}
        assert kept == {r[0] for r in good}
