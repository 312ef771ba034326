"""Removal of long repeated passages, found by difference-cover anchors.

Positions ``p`` with ``p mod PERIOD`` in ``COVER`` carry an anchor: the hash of the ``ANCHOR`` words from there. For any
two positions there is a shift below ``PERIOD`` that puts both on the cover, so two equal windows of
``PERIOD + ANCHOR - 1`` words always share an anchor at the same shift. Only windows around anchors that occur twice are
then extended to their full width and compared by 128-bit hashes.

Rows do not meet in pairs. Both rounds count hashes with partial sums and send back the places of hashes seen *once*: a
place is exact there, and a passage that a third of the rows share adds up to a single row per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastward.llm import wordhash as wh
from pastward.llm.work import Work, text_mark

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 6, 8, 18)  # every difference modulo 21 occurs once


def _cover_positions(words: wh.Words, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the batch, and in their texts, of all anchors."""
    n = len(words.start)
    inner = np.arange(n) - np.repeat(words.first[:-1], words.counts)
    left = np.repeat(words.counts, words.counts) - inner
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    at = np.flatnonzero(on[inner % PERIOD] & (left >= anchor))
    return at, inner[at]


def _places(mark: np.ndarray, text: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Mark and position of a place in one number."""
    return (mark[text].astype(np.int64) << 32) | position


def _anchor_rows(window: int):
    anchor = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in wh.chunks(batches):
            words = wh.split_words(data, offsets)
            at, inner = _cover_positions(words, anchor)
            keep = (words.counts >= window)[text := words.text_of()[at]]
            at, inner, text = at[keep], inner[keep], text[keep]
            if not len(at):
                continue
            hashes = wh.window_hashes(wh.word_hashes(words, 1), anchor, 2)[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes.view(np.int64)),
                    rows.column("doc_id").take(pa.array(text)),
                    pa.array(_places(rows.column("mark").to_numpy(), text, inner)),
                ],
                ["h", "doc_id", "place"],
            )

    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and value of each element of a list column; a null list is empty."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _candidates(rows: pa.RecordBatch, words: wh.Words, window: int) -> np.ndarray:
    """Places in the batch where a window starts that holds an anchor which occurs twice."""
    n, anchor = len(words.start), window - PERIOD + 1
    at, _ = _cover_positions(words, anchor)
    repeated = np.zeros(n + 1, bool)
    repeated[at] = True
    text, position = _lists(rows.column("once"))
    repeated[words.first[text] + position] = False
    # a window at p holds the anchor at a if a - PERIOD < p <= a
    runs = np.zeros(n + 1, np.int64)
    a = np.flatnonzero(repeated[:n])
    np.add.at(runs, np.maximum(a - PERIOD + 1, 0), 1)
    np.add.at(runs, a + 1, -1)
    near = np.cumsum(runs)[: max(n - window + 1, 0)] > 0
    return np.flatnonzero(near & wh.inside_texts(words, window))


def _window_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in wh.chunks(batches):
            words = wh.split_words(data, offsets)
            at = _candidates(rows, words, window)
            if not len(at):
                continue
            text = words.text_of()[at]
            first, second = (wh.window_hashes(wh.word_hashes(words, s), window, s + 1)[at] for s in (3, 5))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(first.view(np.int64)),
                    pa.array(second.view(np.int64)),
                    rows.column("doc_id").take(pa.array(text)),
                    pa.array(_places(rows.column("mark").to_numpy(), text, at - words.first[text])),
                ],
                ["h", "g", "doc_id", "place"],
            )

    return run


def _kept_rows(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in wh.chunks(batches):
            words = wh.split_words(data, offsets)
            n = len(words.start)
            repeated = np.zeros(n + 1, bool)
            repeated[_candidates(rows, words, window)] = True
            text, position = _lists(rows.column("lone"))
            repeated[words.first[text] + position] = False
            runs = np.zeros(n + window + 1, np.int64)
            at = np.flatnonzero(repeated)
            runs[at] += 1
            runs[at + window] -= 1
            gone = np.cumsum(runs)[:n] > 0
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            raw = words.data.tobytes()
            keep = np.flatnonzero(~gone)
            first = np.searchsorted(keep, words.first)
            spans = list(map(slice, words.start[keep].tolist(), words.end[keep].tolist()))
            left = [b" ".join([raw[x] for x in spans[low:high]]) for low, high in zip(first[:-1].tolist(), first[1:].tolist())]
            out = {
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
            }
            if with_text:
                texts = [x.decode() if r else None for x, r in zip(left, removed.tolist())]
                out |= {"kept_text": pc.coalesce(pa.array(texts, pa.string()), rows.column("text").cast(pa.string())), "rest": rows.column("rest")}
            else:
                out["doc_id"] = rows.column("doc_id")
            yield pa.RecordBatch.from_pydict(out)

    return run


def _once_by_text(rows: DataFrame, *keys: str) -> DataFrame:
    """Of rows (keys, doc_id, place): the positions whose keys occur in one row only, one list per (doc_id, mark)."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("doc_id").alias("doc_id"), F.max("place").alias("place"))
    once = counted.where("n = 1").select("doc_id", F.expr("cast(shiftright(place, 32) as int)").alias("mark"), F.expr("cast(place & 4294967295L as int)").alias("position"))
    return once.groupBy("doc_id", "mark").agg(F.collect_list("position").alias("positions"))


def _scanned(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    work = Work(docs.sparkSession)
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("rest")] if with_text else []
    rows = docs.select("doc_id", "text", text_mark(F.col("text")).alias("mark"), *rest)
    texts = rows.select("doc_id", "mark", "text")
    once = work.put(_once_by_text(texts.mapInArrow(_anchor_rows(window), "h long, doc_id long, place long"), "h"))

    def beside(left: DataFrame, lists: DataFrame, name: str) -> DataFrame:
        right = lists.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), F.col("positions").alias(name))
        joined = left.join(right, left["doc_id"].eqNullSafe(right["of_id"]) & (left["mark"] == right["of_mark"]), "left")
        return joined.drop("of_id", "of_mark")

    windows = beside(texts, once, "once").mapInArrow(_window_rows(window), "h long, g long, doc_id long, place long")
    lone = work.put(_once_by_text(windows, "h", "g"))
    kind = "n_words long, n_removed long, kept_sha256 string, "
    kind += f"kept_text string, rest {rows.schema['rest'].dataType.simpleString()}" if with_text else "doc_id long"
    return beside(beside(rows, once, "once"), lone, "lone").mapInArrow(_kept_rows(window, with_text), kind)


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """How much of each text is covered by windows of words that also start elsewhere, and a digest of what is left.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), one row for each row of
    ``docs``. A null or empty text has no words; a text shorter than a window loses nothing. Repeated rows are documents of
    their own: their windows repeat. Null ids are allowed. A long text is read as a whole. Other columns are not read.
    """
    return _scanned(docs, window, False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the covered words taken out of ``text``; the kept words of a changed text are joined by one space.

    Unchanged texts, null ones included, stay as they are. Every other column is carried as it is, whatever its name.
    """
    out = _scanned(docs, window, True)
    return out.select(*[(F.col("kept_text") if c.lower() == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts)),
gone AS (
  SELECT DISTINCT doc_id, k
  FROM (SELECT doc_id, unnest(range(i, i + 35)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY x) AS n FROM windows) WHERE n > 1)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS left_over FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
