from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pastward.llm import substring_dedup
from pastward.llm import wordhash as wh


def rows(n_texts, n_words):
    rnd = random.Random(3)
    text = [" ".join(f"word{rnd.randrange(5000)}" for _ in range(n_words)) for _ in range(n_texts)]
    none = pa.array([None] * n_texts, pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(range(n_texts)), pa.array(text), pa.array(range(n_texts), pa.int32()), none, none], ["doc_id", "text", "mark", "once", "lone"])


@pytest.mark.parametrize("run", [substring_dedup._anchor_rows(35), substring_dedup._window_rows(35), substring_dedup._kept_rows(35, False)])
def test_a_worker_holds_little_beside_its_rows(run, monkeypatch):
    batch = rows(400, 1000)  # 3.5 MB of text
    monkeypatch.setattr(wh, "_powers", {})
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 24e6
    assert sum(x.nbytes for x in wh._powers.values()) < 24e6


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    batch = rows(30, 900)
    data, offsets = wh.text_buffers(batch.column("text"))
    words = wh.split_words(data, offsets)
    whole = wh.word_hashes(words, 1)
    monkeypatch.setattr(wh, "BLOCK_BYTES", 1000)
    assert np.array_equal(wh.word_hashes(words, 1), whole)
    assert [r.num_rows for r, _, _ in wh.chunks(iter([batch]), most=1000)] == [1] * 30
    apart = np.concatenate([wh.window_hashes(wh.word_hashes(wh.split_words(d, o), 1), 35, 2) for _, d, o in wh.chunks(iter([batch]), most=1000)])
    assert np.array_equal(apart, wh.window_hashes(whole, 35, 2)[wh.inside_texts(words, 35)])
