"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language, in order. A text's own ``TOP`` n-grams are compared with
each profile: an n-gram costs the difference of its two ranks, one that the profile lacks costs ``TOP``. The language of
the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pastward.llm import wordhash as wh

TOP = 300
LONGEST = 3
UNKNOWN = "und"
PIECE = 1 << 20
PARTS = 3
HELD_OUT = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters, cut behind a space where there is one."""
    while len(text) > PIECE:
        cut = text.rfind(" ", PIECE // 2, PIECE) + 1 or PIECE
        yield text[:cut]
        text = text[cut:]
    yield text


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of texts in lower case, sorted by the first two.

    Every run of letters is a word with one space on either side; n-grams of 1 to ``LONGEST`` characters lie in one word and
    hold a letter. An n-gram is known by 52 bits of its hash.
    """
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), "<u4").astype(np.uint64)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    letter = _letters()[codes.astype(np.int64)]
    before = np.concatenate([[False], letter[:-1]])
    behind = np.concatenate([letter[1:], [False]])
    codes = np.where(letter, codes, np.uint64(32))
    # a run of other characters between two words gives a space behind the first word and one before the second
    parts = []
    for n in range(1, LONGEST + 1):
        for lead in (False, True):
            for tail in (False, True):
                inner = n - lead - tail
                if inner < 1:
                    continue
                ok = letter.copy()
                for k in range(1, inner):
                    ok[: len(ok) - k] &= letter[k:]
                    ok[len(ok) - k :] = False
                if lead:
                    ok &= ~before
                if tail:
                    ok[: len(ok) - inner + 1] &= ~behind[inner - 1 :]
                at = np.flatnonzero(ok)
                gram = np.full(len(at), 32 if lead else 0, np.uint64)
                for k in range(inner):
                    gram = (gram << np.uint64(21)) | codes[at + k]
                if tail:
                    gram = (gram << np.uint64(21)) | np.uint64(32)
                parts.append((text[at] << np.uint64(52)) | (wh.mix(gram) >> np.uint64(12)))
    keys = np.sort(np.concatenate(parts))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return (keys >> np.uint64(52)).astype(np.int64), keys & np.uint64((1 << 52) - 1), counts


def _summed(text: np.ndarray, gram: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((gram, text))
    text, gram, counts = text[order], gram[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])])) if len(gram) else np.zeros(0, np.int64)
    return text[first], gram[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count), sorted by the first two; any length of text."""
    texts = [(t or "").lower() for t in texts]
    if all(len(t) <= PIECE for t in texts):
        return _counted(texts)
    parts = []
    for number, t in enumerate(texts):
        for piece in _pieces(t):
            _, gram, counts = _counted([piece])
            parts.append((np.full(len(gram), number), gram, counts))
    return _summed(*(np.concatenate(x) for x in zip(*parts)))


def _learn_rows(most: int = 1 << 20):
    """Counts of n-grams per language, added up in the task while they are few."""

    def rows(langs: list[str], text, gram, counts) -> pa.RecordBatch:
        names = pa.DictionaryArray.from_arrays(pa.array(text, pa.int32()), pa.array(langs, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(gram.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple] = []
        waiting = 0
        for chunk, _, _ in wh.chunks(batches):
            text, gram, counts = gram_counts(chunk.column("text").to_pylist())
            number = np.array([langs.setdefault(x, len(langs)) for x in chunk.column("lang").to_pylist()], np.int64)
            held.append(_summed(number[text], gram, counts))
            waiting += len(held[-1][1])
            if waiting > most:
                held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                waiting = len(held[0][1])
                if waiting > most // 2:
                    yield rows(list(langs), *held[0])
                    langs, held, waiting = {}, [], 0
        if held:
            yield rows(list(langs), *_summed(*(np.concatenate(x) for x in zip(*held))))

    return run


def profiles(docs: DataFrame) -> list[tuple[str, list[int]]]:
    """The ``TOP`` n-grams of each value of ``lang``, the most frequent first, from all rows of ``docs`` with text and lang.

    Equally frequent n-grams go by their number. The result has ``TOP`` numbers for each language; counts are added up in the
    tasks first, and every task keeps the ``TOP`` of each language before the last shuffle.
    """
    learnt = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_learn_rows(), "lang string, gram long, n long")
    counts = learnt.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    found: dict[str, list[int]] = {}
    for row in best.select("lang", "rank", "gram").orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return sorted(found.items())


def _rank_table(known: list[tuple[str, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the profiles, sorted, and their rank in each profile (``TOP`` where it lacks them)."""
    grams = np.unique(np.array([g for _, own in known for g in own], np.uint64))
    ranks = np.full((len(known), len(grams)), TOP, np.int64)
    for i, (_, own) in enumerate(known):
        ranks[i, np.searchsorted(grams, np.array(own, np.uint64))] = np.arange(len(own))
    return grams, ranks


def distances(texts: list[str | None], grams: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its distance to each profile, and the number of its n-grams that were compared."""
    text, gram, counts = gram_counts(texts)
    order = np.lexsort((gram, -counts, text))
    text, gram = text[order], gram[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    text, gram, rank = (x[rank < TOP] for x in (text, gram, rank))
    at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
    hit = grams[at] == gram
    compared = np.bincount(text, minlength=len(texts))
    out = np.empty((len(texts), len(ranks)))
    for i, own in enumerate(ranks):
        cost = np.where(hit & (own[at] < TOP), np.minimum(np.abs(own[at] - rank), TOP), TOP)
        out[:, i] = np.bincount(text, weights=cost, minlength=len(texts))
    return out, compared


def _predict_rows(known: list[tuple[str, list[int]]], carried: str):
    names = [name for name, _ in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, ranks = _rank_table(known) if known else (None, None)
        for chunk, _, _ in wh.chunks(batches):
            n = chunk.num_rows
            if known:
                cost, compared = distances(chunk.column("text").to_pylist(), grams, ranks)
                best = cost.argmin(axis=1)
                score = 1 - cost[np.arange(n), best] / np.maximum(compared * TOP, 1)
                pred = [names[b] if c else UNKNOWN for b, c in zip(best.tolist(), compared.tolist())]
                score = np.where(compared > 0, score, 0.0)
            else:
                pred, score = [UNKNOWN] * n, np.zeros(n)
            yield pa.RecordBatch.from_arrays([chunk.column(carried), pa.array(pred, pa.string()), pa.array(score)], [carried, "lang_pred", "score"])

    return run


def _with_text(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows and, beside them, their field ``at``, the text: it comes to the task once, inside its row."""
    for batch in batches:
        row = batch.column("row")
        yield pa.RecordBatch.from_arrays([row.field(at), row], ["text", "row"])


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of the id as text, modulo 3, is 1 (false without an id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % PARTS == HELD_OUT, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """The language of each text, learnt from the other part of ``docs``: doc_id, held_out, lang_pred, score.

    Profiles come from rows with an id, a text and a lang that are not held out; a prediction reads the text alone. The score
    is 1 less the distance's share of the largest possible one. A text that is null or has no letters gives ``und`` with
    score 0, and so does every text if there is nothing to learn from. Ties go to the first language in order. One row for
    each row of ``docs``; repeated rows get equal results. Columns other than doc_id, text and lang are not read.
    """
    known = profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    out = docs.select("doc_id", "text").mapInArrow(_predict_rows(known, "doc_id"), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more; all columns are carried."""
    known = profiles(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double"
    at, predicted = [c.lower() for c in docs.columns].index("text"), _predict_rows(known, "row")
    out = rows.mapInArrow(lambda batches: predicted(_with_text(batches, at)), kind)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
