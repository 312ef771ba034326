"""Runs of periodic words, from the Lyndon arrays that the first phase of a grouping suffix sorter yields.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Every run holds a Lyndon
root: a place whose longest Lyndon word, under an order of the words or under the reverse order, is as long as the period.
So the Lyndon arrays under both orders name all places and periods that can belong to runs, and extending each by its
longest common extensions to the left and the right gives the run.

The Lyndon arrays come from grouping alone, in nearly linear time: suffixes are grouped by first word; groups are taken from the highest
down; each member points to the nearest earlier suffix of a lower group, and the suffixes pointed to move into new groups above
their old ones, by how many members point at them. A suffix's group ends up as its longest Lyndon prefix. No suffix array is
finished.

Only runs that repeat their period four times and have six words or more are asked for. That gives an exact sieve: within
such a run every five-word window comes again within q words, for 3q - 4 places in a row. Stretches of a text where this fails for
every q are left out before words are grouped; where it holds, words are compared as they are, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm import wordhash as wh
from pastward.llm.work import WORD, fresh

LEAST = 6  # words of a run, at least
TIMES = 4  # its periods, at least; the sieve rests on both values
GRAM = 5
SIEVE_ROUNDS = 8
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def lyndon_lengths(symbols: list[int], size: int) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; symbols are numbers below ``size``."""
    n = len(symbols)
    length, group = [1] * n, list(symbols)
    members: list[list[int]] = [[] for _ in range(size)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    below, above = list(range(-1, size - 1)), list(range(1, size + 1))
    # node x stands for place x - 1 and leads to the nearest place at or before it whose group is still to come; 0 is none
    lead = list(range(n + 1))
    now = size - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        pointed: dict[int, int] = {}
        for i in own:
            lead[i + 1] = i
        for i in own:
            end = i
            while lead[end] != end:
                end = lead[end]
            x = i
            while lead[x] != end:
                lead[x], x = end, lead[x]
            if end:
                pointed[end - 1] = pointed.get(end - 1, 0) + 1
        if pointed:
            width = length[own[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, times in pointed.items():
                moved.setdefault((-times, group[j]), []).append(j)
            for less, old in sorted(moved):  # most pointers first: fewer ones come between these and the old group
                new, places = len(members), moved[less, old]
                members.append(places)
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
                for j in places:
                    group[j] = new
                    length[j] -= less * width
        now = below[now]
    return length


def runs_of(words: list) -> set[tuple[int, int, int]]:
    """Start, length and period of the runs of ``words`` that are long enough."""
    names = {w: k for k, w in enumerate(sorted(set(words)))}
    size, n = len(names), len(words)
    up = [names[w] for w in words]
    flat = np.array(up, np.int32).tobytes()
    found: set[tuple[int, int, int]] = set()
    for symbols in (up, [size - 1 - s for s in up]):
        ends: dict[int, int] = {}  # by period, where the last run extended ends
        for i, p in enumerate(lyndon_lengths(symbols, size)):
            # of a run's Lyndon roots the first starts before its second period; two more follow
            if i + 2 * p > n or i + p <= ends.get(p, 0) or up[i] != up[i + p] or flat[4 * i : 4 * (i + p)] != flat[4 * (i + p) : 4 * (i + 2 * p)]:
                continue
            low, high = i, i + 2 * p
            while high < n and up[high] == up[high - p]:
                high += 1
            while low and up[low - 1] == up[low - 1 + p]:
                low -= 1
            ends[p] = high
            if high - low >= max(LEAST, TIMES * p):
                found.add((low, high - low, p))
    return found


def _stretches(words: wh.Words) -> list[tuple[int, int, int]]:
    """Text, first word and end, in the batch, of the stretches that the sieve leaves; those of one text do not overlap."""
    grams = wh.window_hashes(wh.word_hashes(words, 1), GRAM, 2)
    if not len(grams):
        return []
    text = words.text_of()
    inside = np.flatnonzero(wh.inside_texts(words, GRAM))
    key = grams[inside] ^ wh.mix(text[inside].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    here, later = inside[order[:-1][again]], inside[order[1:][again]]
    step = np.zeros(len(grams) + 2, np.int64)  # to the next place with the same window; 0 at both ends and where there is none
    step[here + 1] = later - here
    for _ in range(SIEVE_ROUNDS):
        edges = np.diff((step > 0).astype(np.int8))
        low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        places = np.zeros(len(step), np.int64)
        places[1:] = np.repeat(np.stack([np.zeros(len(low) + 1, np.int64), np.append(high - low, 0)], 1).ravel()[:-1], np.diff(np.concatenate([[0], np.stack([low, high], 1).ravel(), [len(step) - 1]])))
        gone = 3 * step > places + GRAM - 1
        if not gone.any():
            break
        step[gone] = 0
    edges = np.diff((step > 0).astype(np.int8))
    low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out: list[tuple[int, int, int]] = []
    for k, a, b in zip(text[low].tolist(), low.tolist(), (high + (high - low + GRAM - 1) // 3 + GRAM).tolist()):
        b = min(b, int(words.first[k + 1]))
        if out and out[-1][0] == k and a <= out[-1][2]:
            out[-1] = (k, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in wh.chunks(batches):
        words = wh.split_words(data, offsets)
        raw = words.data.tobytes()
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(rows))]
        keep = np.ones(len(words.start), bool)
        for k, a, b in _stretches(words):
            some = [raw[x:y] for x, y in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]
            for start, length, period in runs_of(some):
                runs[k].append((a + start - int(words.first[k]), length, period))
                keep[a + start + period : a + start + length] = False
        at = np.flatnonzero(keep)
        first = np.searchsorted(at, words.first)
        spans = list(map(slice, words.start[at].tolist(), words.end[at].tolist()))
        left = [b" ".join([raw[x] for x in spans[low:high]]) for low, high in zip(first[:-1].tolist(), first[1:].tolist())]
        flat = [(s, length, p) for some in runs for s, p, length in sorted((s, p, length) for s, length, p in some)]
        struct = pa.StructArray.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)], ["start", "length", "period"])
        counts = np.concatenate([[0], np.cumsum([len(some) for some in runs])]).astype(np.int32)
        out = {name: rows.column(name) for name in rows.schema.names if name != "text"}
        out |= {"n_words": pa.array(words.counts, pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(counts), struct), "collapsed": pa.array(left, pa.binary()).cast(pa.string())}
        yield pa.RecordBatch.from_pydict(out)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and then period) and the collapsed text, for each row.

    Words are runs of characters other than space and ``\\t \\n \\v \\f \\r``. The collapsed text has the words that no run holds after
    its first period, joined by one space. A null or empty text has no words, no runs and an empty collapsed text. Each row is
    judged alone: repeated rows give repeated results, null ids are carried, an empty table gives an empty table, other columns are not
    read. A long text is read as a whole; memory follows one text.
    """
    return docs.select("doc_id", "text").mapInArrow(_rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words bigint, runs {RUN}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` where the words of some texts repeat periodically, decided by the CRC of the id.

    Let h be the CRC-32 of the id's decimal digits and g its tenth. If h is divisible by ten and the text has n > 0 words, each word from a = g mod n on
    becomes word a + (i - a) mod p with p = 1 + (n - a) div (3 + g mod 8), and words are joined by one space. Other texts, those of
    null ids included, stay as they are.
    """
    h, = fresh(docs.columns, "h")
    g = F.expr(f"`{h}` div 10")

    def planted(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        numbers = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.when(n > 0, F.array_join(F.transform(numbers, lambda i: F.get(words, i.cast("int"))), " "))

    # the words are an element of an array, so that the inner steps name them instead of finding them again
    words = F.array(F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1)))
    text = F.when(F.col(h) % 10 == 0, F.coalesce(F.transform(words, planted)[0], F.col("text"))).otherwise(F.col("text"))
    return docs.withColumn(h, F.crc32(F.col("doc_id").cast("string").cast("binary"))).withColumn("text", text).drop(h)


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row of :func:`periodic_runs`, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    length, start, period = best["length"], -best["col2"], -best["col3"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# Runs in SQL: equal five-word windows give places and distances q; of neighbouring ones with equal q come the maximal stretches.
SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce(list_concat([c], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
sizes AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM hashed),
starts AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM sizes),
texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
                         THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w
  FROM starts),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
grams AS (
  SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER v, lead(word, 2) OVER v, lead(word, 3) OVER v, lead(word, 4) OVER v) AS x
  FROM words WINDOW v AS (PARTITION BY doc_id ORDER BY i) QUALIFY lead(word, 4) OVER v IS NOT NULL),
pairs AS (SELECT p.doc_id, p.i, q.i - p.i AS q FROM grams p JOIN grams q ON p.doc_id = q.doc_id AND p.x = q.x AND p.i < q.i),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM numbered GROUP BY doc_id, q, island),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_over FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
of_text AS (
  SELECT doc_id, count(*) AS n_runs, arg_max({'s': start, 'l': length, 'p': period}, [length, -start, -period]) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.l::BIGINT AS length, best.p::BIGINT AS period,
       (1000 * best.l // best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM texts LEFT JOIN of_text USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
