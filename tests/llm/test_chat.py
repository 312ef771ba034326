from __future__ import annotations

import json
import random

import pytest

from pastward.llm import chat as op
from tests.llm.brute import sha

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "\\\\", "\\l", "\\\\l", "<", "</turn>\n", "<turn assistant>", "### Assistant:", ">#", "ünï 🙂", "a\nb", "\\g\\h", "$1"]


def plain(rows):
    out, by = [], {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = [(r, x) for *_, r, x in turns]
        loss = "".join(x for r, x in said if r == "assistant")
        width = lambda s: len(s) + sum(ch in "\\<>#" for ch in s)
        out.append((c, len(said), sha("".join(f"{r}\n{x}\n" for r, x in said)), len(loss), sha(loss), sum(15 + width(r) + width(x) for r, x in said)))
    return sorted(out, key=repr)


def conversations(seed):
    rnd = random.Random(seed)
    return [(c, t, rnd.choice(["user", "assistant", "system", "human", "o>d<\\d"]), "".join(rnd.choices(ODD, k=rnd.randint(0, 6)))) for c in range(30) for t in range(rnd.randint(1, 6))]


@pytest.mark.parametrize("seed", range(2))
def test_round_trip_equals_plain_version(spark, seed):
    rows = conversations(seed)
    got = op.digests(op.rows_to_turns(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_edge_rows(spark):
    rows = [(None, 0, "user", "x"), (None, 1, "assistant", None), (1, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "assistant", "<" * 50000), (3, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA + ", turns string, formatted int")
    assert sorted(map(tuple, op.digests(op.rows_to_turns(df)).collect()), key=repr) == plain(rows)
    assert op.digests(op.rows_to_turns(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        op.rows_to_turns(df.drop("role"))


def test_the_sample_conversation(spark):
    out = op.formatted(op.rows_to_turns(op.with_sample(spark.createDataFrame([], SCHEMA)))).collect()[0]
    assert out.formatted.count("</turn>") == 2 and out.formatted.count("###") == 0
    s = out.loss_spans
    assert len(s) == 1 and out.formatted[s[0].start : s[0].start + s[0].length] == op.SAMPLE.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g").replace("#", "\\h")


def test_layouts_of_json_records(spark):
    said = [("user", "hi\nthere"), ("assistant", "yes <b>")]
    records = [
        ({"messages": [{"role": r, "content": t} for r, t in said]}, "messages", said),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": None}]}, None, None),
        ({"conversations": [{"from": "human", "value": "hi"}, {"value": "so", "from": "gpt"}]}, "shares", [("user", "hi"), ("assistant", "so")]),
        ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"response": "r", "prompt": "p"}, "prompt", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "do", "input": "", "output": "done"}, "instruction with input", [("user", "do"), ("assistant", "done")]),
        ({"instruction": "do", "input": "this", "output": "done"}, "instruction with input", [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"question": "q", "answer": "a"}, "question", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"prompt": "p", "response": "r", "more": 1}, None, None),
        ({}, None, None),
        ([1, 2], None, None),
    ]
    rows = [(i, json.dumps(r)) for i, (r, *_) in enumerate(records)] + [(98, "{broken"), (99, None)]
    got = {r.id: r for r in op.records_to_turns(spark.createDataFrame(rows, "id int, record string")).collect()}
    for i, (_, layout, turns) in enumerate(records):
        if i == 1:  # a null leaf is a type of its own but the same path
            assert got[i].layout == "shares" and [tuple(t) for t in got[i].turns] == [("user", "hi"), ("assistant", "")]
            continue
        assert got[i].layout == layout, i
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == turns
    assert got[98].layout is None and got[99].turns is None


def test_paths_of_types_and_of_variants_agree(spark):
    record = {"a": {"b": [{"c": 1, "d d": "x"}], "e": [[True]]}, "f": 1.5}
    df = spark.createDataFrame([(json.dumps(record),)], "r string").selectExpr("parse_json(r) AS v")
    got = df.select(op.variant_paths(df.v).alias("p")).collect()[0].p
    assert sorted(p.replace("`", "") for p in got) == ["a.b[].c", "a.b[].d d", "a.e[][]", "f"]
    typed = spark.createDataFrame([], "a struct<b: array<struct<c: int, d: string>>, e: array<array<boolean>>>, f double").schema
    assert op.schema_paths(typed) == {"a.b[].c", "a.b[].d", "a.e[][]", "f"}


@pytest.mark.parametrize("seed", range(2))
def test_records_of_all_layouts_are_read_back(spark, seed, monkeypatch):
    monkeypatch.setattr(op, "RECORD_BYTES", 60_000)
    rows = conversations(seed)
    rnd = random.Random(seed)
    for c in range(100, 180):
        roles = rnd.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant", "user"], ["assistant", "user"]])
        rows += [(c, t, r, "".join(rnd.choices([*ODD, "\x00", '"', "\u2028", "\ud7ff"], k=rnd.randint(0, 4)))) for t, r in enumerate(roles)]
    rows += [(200, 0, "user", "x" * 70_000), (200, 1, "assistant", "y"), (None, 0, "user", "q"), (None, 1, "assistant", None)]
    turns = op.rows_to_turns(spark.createDataFrame(rows, SCHEMA))
    read = op.through_records(turns)
    assert sorted(map(tuple, op.digests(read).collect()), key=repr) == plain(rows)
    found = {r.layout for r in read.collect()}
    assert found == {m.name for m in op.MAPPINGS} - {"instruction with input"}


def test_a_record_is_read_by_its_fingerprint_alone(spark):
    """Records of a layout that no mapping declares stay without turns, whatever else they hold."""
    rows = [(c, t, r, "hi") for c in range(40) for t, r in enumerate(("user", "assistant"))]
    records = op.turns_to_records(op.rows_to_turns(spark.createDataFrame(rows, SCHEMA)))
    changed = records.selectExpr("conv_id", "concat(substr(record, 1, length(record) - 1), ',\"more\":1}') AS record")
    assert {(r.layout, r.turns) for r in op.records_to_turns(changed).collect()} == {(None, None)}
    assert None not in {r.layout for r in op.records_to_turns(records).collect()}
