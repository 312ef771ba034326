"""Search for benchmark passages in documents by a prefix-filtered join.

A benchmark item's windows of ``WINDOW`` words (the whole item if it is shorter) are the sets to be contained. For whole
containment one token of each window is a sufficient prefix: its rarest word in the corpus. Only occurrences of these words
become candidates; the offset of the word in its window gives the place where the window would lie, which has to fit
into the text, and there all its words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.work import Work, text_mark

WINDOW = 13
MOST_BROADCAST = 64 << 20  # bytes
# of folded texts; the same words as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, a class that takes ten times as long to match
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, items): each distinct window of words with the ids of its items as text, one row per window.

    An id that is null is left out of ``items``; its windows count all the same.
    """
    words = items.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))
    each = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(window)).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def _prefixes(windows: DataFrame, rows: DataFrame, small: bool) -> DataFrame:
    """(word, before, window, items): each window with its rarest word in the corpus and the number of words before it."""
    spread = windows.select("window", F.posexplode("window").alias("before", "word"))
    vocabulary = spread.select("word").distinct()
    said = rows.select(F.explode("w").alias("word"))
    counts = said.join(F.broadcast(vocabulary) if small else vocabulary, "word").groupBy("word").agg(F.count("*").alias("n"))
    ranked = spread.join(F.broadcast(counts) if small else counts, "word", "left")
    rarest = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "before")).alias("r"))
    return windows.join(rarest, "window").where("r.n > 0").select("r.word", "r.before", "window", "items")


def _fits(start: Column, n: Column) -> Column:
    """Positional and length bound: the window lies in the text."""
    return (start >= 0) & (start + F.size("window") <= n)


def _matches(rows: DataFrame, prefixes: DataFrame, small: bool) -> DataFrame:
    """(doc_id, mark, start, window, items) of all windows that occur. Rows: doc_id, mark, w."""
    start = (F.col("at") - F.col("before")).alias("start")
    same = F.slice("w", F.col("start") + 1, F.size("window")) == F.col("window")
    if small:
        said = rows.select("doc_id", "mark", "w", F.posexplode("w").alias("at", "word"))
        near = said.join(F.broadcast(prefixes), "word").select("doc_id", "mark", "w", start, "window", "items")
        return near.where(_fits(F.col("start"), F.size("w")) & same).drop("w")
    said = rows.select("doc_id", "mark", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"))
    near = said.join(prefixes, "word").select("doc_id", "mark", "n", start, "window", "items").where(_fits(F.col("start"), F.col("n")))
    own = rows.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), "w").distinct()
    back = near.join(own, near["doc_id"].eqNullSafe(own["of_id"]) & (near["mark"] == own["of_mark"]))
    return back.where(same).select("doc_id", "mark", "start", "window", "items")


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans (start, stop)."""
    whole = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["stop"]).alias("end"),
        ),
    )
    return whole["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """How many words of each text lie in occurrences of benchmark windows.

    Words are runs of a-z (A-Z folded), 0-9 and all beyond ASCII. Returns doc_id, mark (which tells apart different texts with
    one id), n_words, n_hit, n_items, items_sha256 (item ids sorted as text, joined by commas) and contaminated (some word
    is hit, and at least ``percent`` of all), one row for each row of ``docs``. A null or empty text has no words and no
    hits; so has an item. Repeated rows get equal results; an item with a null id hits but is not listed. An empty table of
    items hits nothing. Other columns are not read.

    The windows are broadcast if their words have ``MOST_BROADCAST`` bytes at most, 32 for each window and 16 for each word
    included; beyond that, all joins are by shuffle.
    """
    work = Work(docs.sparkSession)
    windows = work.put(item_windows(items, window))
    size = F.octet_length(F.array_join("window", "")) + F.octet_length(F.array_join("items", "")) + 16 * (F.size("window") + F.size("items")) + 32
    small = windows.agg(F.coalesce(F.sum(size.cast("double")), F.lit(0.0))).first()[0] <= MOST_BROADCAST
    keyed = docs.select("doc_id", text_mark(F.col("text")).alias("mark"), "text")
    rows = keyed.select("doc_id", "mark", word_list(F.col("text")).alias("w"))
    prefixes = work.put(_prefixes(windows, rows, small))
    matches = _matches(rows, prefixes, small)
    hits = matches.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.size("window")).alias("stop")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    hits = hits.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark"), _covered(F.col("spans")).cast("long").alias("n_hit"), "items")
    counted = keyed.select("doc_id", "mark", F.regexp_count(folded(F.col("text")), F.lit(WORD)).cast("long").alias("n_words"))
    joined = counted.join(hits, counted["doc_id"].eqNullSafe(hits["of_id"]) & (counted["mark"] == hits["of_mark"]), "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; all columns are carried, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", text_mark(F.col("text")).alias("mark"))
    bad = contamination(docs, items, window, percent).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).distinct()
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["of_id"]) & (rows["mark"] == bad["of_mark"]), "left_anti").select("row.*")


SQL = r"""
WITH folded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM folded, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT DISTINCT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x ON p.key = x.key AND p.n = x.n),
hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(f.w) AS contaminated
FROM folded f LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
