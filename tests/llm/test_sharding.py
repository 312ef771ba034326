from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pastward.llm import sharding as op


def rows(spark, n=5000):
    texts = [None if i % 50 == 0 else "copy" if i % 3 == 0 else f"tëxt {i}" * (i % 7) for i in range(n)]
    return texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_every_row_once_and_slots_without_gaps(spark):
    texts, df = rows(spark)
    out = op.placed(df).collect()
    assert sorted(r.doc_id for r in out) == list(range(5000))
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) < 1.35 * 5000 / 16


def test_one_more_shard_takes_rows_only_into_itself(spark):
    _, df = rows(spark)
    out = {r.doc_id: r for r in op.placed(df).collect()}
    grown = {r.doc_id: r.shard for r in op.placed(df, shards=17).collect()}
    assert all(grown[i] == r.grown_shard for i, r in out.items())
    moved = [r for r in out.values() if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {16} and 0.5 * 5000 / 17 < len(moved) < 1.5 * 5000 / 17


def test_order_is_shuffled_repeatable_and_seeded(spark):
    _, df = rows(spark)
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in op.placed(df, seed=seed).collect()}
    first = place(1)
    assert first == place(1) and first != place(2)
    order = [d for d, _ in sorted(((d, p) for d, p in first.items() if p[0] == 3), key=lambda x: x[1])]
    rising = sum(a < b for a, b in zip(order, order[1:])) / (len(order) - 1)
    assert 0.35 < rising < 0.65


def test_edge_rows(spark):
    data = [(None, None, 1, "a")] * 40 + [(1, "x", 2, "b")] * 3 + [(1, "y", None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, slot int, shard string")
    out = op.shuffled(df, shards=4, bucket_rows=5)
    assert out.columns == [*df.columns, "_shard", "_slot", "grown_shard"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.slot, r.shard) for r in got) == Counter(data)
    assert len({r._shard for r in got if r.doc_id is None}) == 1
    by = {}
    for r in got:
        by.setdefault(r._shard, []).append(r._slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert op.shuffled(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        op.shuffled(df, shards=0)


def test_files_hold_the_texts_in_order(spark, tmp_path):
    _, df = rows(spark, 500)
    path = f"{tmp_path}/out"
    op.write_shards(df, path, shards=4)
    back = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in back.select("doc_id", "text").collect()) == sorted((r.doc_id, r.text) for r in df.collect())
    assert back.select("shard", "slot").distinct().count() == 500


def test_digests_are_those_of_the_texts_that_come_out(spark, monkeypatch):
    texts, df = rows(spark, 300)
    asked, real = [], op.shuffled

    def lossy(docs, *args, **more):
        asked.append((docs, more))
        return real(docs, *args, **more).withColumn("document", F.col("document").withField("text", F.concat("document.text", F.lit("!"))))

    monkeypatch.setattr(op, "shuffled", lossy)
    out = op.placed(df.withColumn("shard", F.lit("a"))).collect()
    docs, more = asked[0]
    assert docs.schema["document"].dataType.names == ["doc_id", "text", "shard"] and more["size"] in docs.columns
    for r in out:
        raw = b"" if texts[r.doc_id] is None else (texts[r.doc_id] + "!").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_slots_do_not_depend_on_input_splits(spark):
    _, df = rows(spark, 1500)
    df = df.union(df.limit(100))
    places = []
    for splits in (1, 3, 7):
        out = op.shuffled(df.repartition(splits), shards=3, seed=5, bucket_rows=60).collect()
        places.append(sorted((r.doc_id, r.shard, r.slot, r.grown_shard) for r in out))
    assert places[0] == places[1] == places[2]


def test_equal_rows_are_spread_over_buckets(spark, monkeypatch):
    made, put = [], op.Work.put
    monkeypatch.setattr(op.Work, "put", lambda self, df: made.append(put(self, df)) or made[-1])
    df = spark.createDataFrame([(1, "same")] * 5000 + [(i, "other") for i in range(50)], "doc_id long, text string")
    out = op.shuffled(df, shards=1, bucket_rows=50).collect()
    assert sorted(r.slot for r in out) == list(range(5050)) and Counter(r.doc_id for r in out)[1] == 5001
    filled = next(t for t in made if "xs" in t.columns).select(F.size("xs")).collect()
    assert max(r[0] for r in filled) < 100


def test_maps_can_be_carried(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (1, "a", {"k": 1}), (2, None, None)], "doc_id long, text string, m map<string,int>")
    got = op.shuffled(df, shards=2).collect()
    assert sorted((r.doc_id, (r.m or {}).get("k", 0)) for r in got) == [(1, 1), (1, 1), (2, 0)]


def plain_shard(doc_id, shards, seed=0):
    """The shard with the largest draw, from the hash library."""
    import xxhash

    def draw(shard):
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
        h = h if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h

    return max((draw(s), s) for s in range(shards))[1]


def test_shards_equal_plain_version(spark):
    ids = [*range(-50, 400), None, 2**62, -(2**63)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    for seed in (0, 9):
        got = {r.doc_id: (r.shard, r.grown_shard) for r in op.placed(df, seed=seed).collect()}
        assert got == {i: (plain_shard(i, 16, seed), plain_shard(i, 17, seed)) for i in ids}
