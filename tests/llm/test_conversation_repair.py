from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import groupby, product

import pytest

from pastward.llm import conversation_repair as op

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def cheapest(rows):
    """Forward over (role, text, fault): for each state the cheapest, then least, audit so far, with its lines."""
    fits = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(best, state, way):
        if state not in best or way[:2] < best[state][:2]:
            best[state] = way

    def inserts(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                to = fits[state]
                better(best, to, (cost + 2, audit + "I", lines + [f"{names[to]}:"]))
        return best

    best = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, lines) in best.items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault not in (1, 2):
                more, to = fault == 3, fits[state]
                better(after, to, (cost + 2 + more, audit + "R", lines + [f"{names[to]}:{text}"]))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    better(after, role[:1], (cost + more, audit + "K", lines + [f"{role}:{text}"]))
        best = inserts(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda w: w[:2])


def plain(rows):
    """rows as they are after damage."""
    out = []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, *((" " if x is None else x).encode() for x in r[2:])))
    for conv, group in groupby(order, lambda r: r[0]):
        seen, judged, turns = set(), [], set()
        for _, turn, role, text in group:
            role, text = (" " if x is None else x for x in (role, text))
            bare = text.strip(WHITE)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            seen.add((role, text))
            judged.append((role, text, fault))
            turns |= {turn} - {None}
        initials = [r[0][:1] for r in judged]
        cost, audit, lines = cheapest(judged)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for *_, f in judged) for k in (1, 2, 3)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha("\n".join(lines)),
        ))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def talks(seed, n=60, most=14):
    rnd = random.Random(seed)
    texts = ["ok.", "well", "a\n", "", "  \t", None, "yes!", "no? ", "é日.", "x" * 50]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, ""]
    return [
        (rnd.choice([c, c, c, c, None]) if c == 7 else c, rnd.choice([k, k, k, None, rnd.randrange(9)]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"text {rnd.random()}.")
        for c in range(n)
        for k in range(rnd.randint(1, most))
    ]


@pytest.mark.parametrize("seed", range(3))
def test_audits_equal_plain_version(spark, seed):
    rows = talks(seed)
    assert found(op.audited(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(3))
def test_conversations_over_many_partitions(spark, many_partitions, seed):
    rows = talks(seed, 3, 150) + [(None, t, r, f"{t}.") for t in range(90) for r in ("user", "tool")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(op.audited(df)) == plain(rows)
    edits = op.repaired(df).collect()
    audits = {r[0]: (r[7], r[8]) for r in plain(rows)}
    for conv in audits:
        own = sorted((e for e in edits if e["conv_id"] == conv), key=lambda e: e["number"])
        assert "".join(e["edit"] for e in own) == audits[conv][0]
        assert sha("\n".join(f"{e['role']}:{e['text']}" for e in own if e["edit"] != "D")) == audits[conv][1]


def test_every_short_conversation_by_tables():
    """All rows of up to five symbols: the tables against the forward search."""
    names = [("x", "", 1), *((r, t, f) for r in ("system", "user", "assistant", "tool") for t, f in (("t.", 0), ("t", 3)))]
    for n in range(6):
        for symbols in product(range(op.SYMBOLS), repeat=n) if n < 4 else random.Random(n).sample(list(product(range(op.SYMBOLS), repeat=n)), 3000):
            after, _ = op.tables().expanded(bytes(symbols), 0)
            trace = op._Trace(0)
            for s, v in zip(symbols, after):
                list(trace.row(None, *names[s][:2], s, names[s][2], 1, v))
            list(trace.end())
            cost, audit, lines = cheapest([names[s] for s in symbols])
            assert (trace.cost, "".join(trace.audit), trace.digest.hexdigest()) == (cost, audit, sha("\n".join(lines)))


@pytest.mark.parametrize("seed", range(2))
def test_query_form(spark, seed):
    rows = talks(seed, 80, 6) + [(c, 0, "user", "only.") for c in range(1000, 1060)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", same string, copies int")
    hurt = plain_damaged(rows)
    left = {r[0] for r in hurt}
    empty = [(c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in {r[0] for r in rows} - left]
    assert empty
    assert found(op.with_all(op.audited(op.damaged(df)), df)) == sorted(plain(hurt) + empty, key=repr)


def test_edge_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(op.audited(none)) == found(op.repaired(none)) == found(op.with_all(op.audited(op.damaged(none)), none)) == []
    rows = [(1, None, None, None)] * 3 + [(2, 5, "user", "hi.")] * 200 + [(3, t, "user", "long. " * 20_000 + ".") for t in range(2)]
    assert found(op.audited(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
