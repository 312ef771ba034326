"""Quality rules whose limits follow the data: one set per language and source, read from mergeable quantile sketches.

A sketch counts values in buckets of about 3 % width, in whole numbers: values below 64 have buckets of their own, larger
ones keep their first six bits. Sketches of parts of a group add up to that of the group, in any order. A group's usual rate is its
60 % quantile moved out by a multiple of the distance to the 20 % quantile: both lie among the good rows of a group as long as no more than
a third of it is bad, however bad. A text may stand above the usual rate by what chance does to a text of its length: some standard
deviations of the count, and a few events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pastward.llm.work import WORD, Work

WIDTH = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
LOW, UPPER = (1, 5), (3, 5)  # quantiles, as fractions
SPREAD = 2
DEVIATIONS = 4
# events that any text may have, whatever is usual: symbols, lines, words of twenty windows
FREE = {"symbol_rate": 3, "dup_line_rate": 2, "repeat_rate": 20 * WIDTH}
KEPT_BITS = 6


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _starts(words: Column) -> Column:
    return F.sequence(F.lit(0), F.size(words) - WIDTH)


def _may_repeat(words: Column) -> Column:
    """Whether two windows of a text have equal hashes; if not, no window repeats."""

    def of(hashed: Column) -> Column:
        prints = F.transform(_starts(hashed), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WIDTH)]))
        return _bound(prints, lambda p: F.size(F.array_distinct(p)) < F.size(p))

    return (F.size(words) > WIDTH) & _bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def _repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more, the first occurrence included: sorted windows with equal neighbours."""

    def of(placed: Column) -> Column:
        def same(k: Column) -> Column:
            beside = [F.get(placed, k + d)["x"] == F.get(placed, k)["x"] for d in (-1, 1)]
            return F.coalesce(beside[0], F.lit(False)) | F.coalesce(beside[1], F.lit(False))

        places = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), same)
        return F.sort_array(F.transform(places, lambda k: F.get(placed, k)["at"]))

    windows = F.transform(_starts(words), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WIDTH), " ").alias("x"), i.alias("at")))
    covered = F.aggregate(
        _bound(F.sort_array(windows), of),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WIDTH - F.greatest(p, acc["end"])).alias("n"), (p + WIDTH).alias("end")),
    )
    return covered["n"]


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and counts of each text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are runs without white space, n_lines counts lines with a word. A null or empty text has zeros. One row for each row
    of ``docs``; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    counted = _bound(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").alias("n_words"),
        F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).alias("n_symbols"),
        counted.alias("lines"),
        F.when(_may_repeat(F.col("words")), _repeated_words(F.col("words"))).otherwise(F.lit(0)).alias("n_repeat_words"),
    )
    rows = rows.withColumn("n_lines", F.col("lines.n")).withColumn("n_dup_lines", F.col("lines.n") - F.col("lines.distinct"))
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in counts])


def _rates() -> dict[str, Column]:
    """Shares in ten-thousandths, and a word's mean length in hundredths, as whole numbers."""

    def share(a: str, b: str, times: int) -> Column:
        return F.expr(f"{a} * {times} div greatest({b}, 1)")

    return {
        "symbol_rate": share("n_symbols", "word_chars", 10_000),
        "dup_line_rate": share("n_dup_lines", "n_lines", 10_000),
        "repeat_rate": share("n_repeat_words", "n_words", 10_000),
        "word_length": share("word_chars", "n_words", 100),
    }


# what each share counts, and in how many
COUNTS = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}


def sketch(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mergeable quantile sketches of whole numbers from 0: (keys, bucket, n). Sketches merge by adding ``n`` up."""
    shift = f"greatest(length(bin({value})) - {KEPT_BITS}, 0)"
    bucket = F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], **asked: tuple[int, int]) -> DataFrame:
    """(keys, one column for each asked fraction): the smallest bucket that holds that share of the values at least."""
    group = Window.partitionBy(*keys)
    rows = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") * d >= F.col("total") * a, F.col("bucket"))).alias(name) for name, (a, d) in asked.items()])


def judged(docs: DataFrame) -> DataFrame:
    """``measures`` with base_failed and kept, one row for each row of ``docs``.

    base_failed: fewer than 10 words, or more than 20 % of the words repeat in windows. Usual rates come from the other texts of
    the same lang and source (null is a value of its own); a text is kept if none of its counts is further above its group's usual rate than
    ``DEVIATIONS`` standard deviations and ``FREE`` events. Its mean word length may exceed the usual one by the same number of deviations, each the
    length over the root of its words.
    """
    work = Work(docs.sparkSession)
    rows = work.put(measures(docs))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rates = _rates()
    rows = rows.withColumn("base_failed", failed).select("*", *[c.alias(n) for n, c in rates.items()])
    long = rows.where("not base_failed").unpivot(["lang", "source"], list(rates), "rate", "value")
    marks = quantiles(sketch(long, ["lang", "source", "rate"]), ["lang", "source", "rate"], low=LOW, upper=UPPER)
    usual = F.col("upper") + SPREAD * (F.col("upper") - F.col("low"))
    limits = marks.groupBy(F.col("lang").alias("of_lang"), F.col("source").alias("of_source")).agg(
        *[F.max(F.when(F.col("rate") == n, usual)).alias(f"usual_{n}") for n in rates]
    )
    out = rows.join(limits, rows["lang"].eqNullSafe(limits["of_lang"]) & rows["source"].eqNullSafe(limits["of_source"]), "left")
    good = F.lit(True)
    for n, (count, of) in COUNTS.items():
        expected = F.col(of) * F.col(f"usual_{n}") / F.lit(10_000.0)
        good &= F.col(count) <= expected + FREE[n] + DEVIATIONS * F.sqrt(expected + 1)
    length = F.col("usual_word_length")
    good &= F.col("word_length") <= length + DEVIATIONS * length / F.sqrt("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(good, F.lit(False))).alias("kept")
    )


SQL = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
repeats AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, len(l) AS n, len(l) - len(list_distinct(l)) AS dup
  FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts)),
counted AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(lines.n AS BIGINT) AS n_lines, CAST(lines.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
rated AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 10000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_length
  FROM counted),
long AS (
  SELECT lang, source, unnest(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS rate,
    unnest([symbol_rate, dup_line_rate, repeat_rate, word_length]) AS v
  FROM rated WHERE NOT base_failed),
sketches AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket, count(*) AS n
  FROM long GROUP BY ALL),
upto AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY lang, source, rate) AS total FROM sketches),
marks AS (
  SELECT lang, source, rate, min(bucket) FILTER (below * 5 >= total) AS low, min(bucket) FILTER (below * 5 >= total * 3) AS upper
  FROM upto GROUP BY lang, source, rate),
limits AS (
  SELECT lang, source, max(usual) FILTER (rate = 'symbol_rate') AS a, max(usual) FILTER (rate = 'dup_line_rate') AS b,
    max(usual) FILTER (rate = 'repeat_rate') AS c, max(usual) FILTER (rate = 'word_length') AS d
  FROM (SELECT *, upper + 2 * (upper - low) AS usual FROM marks) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(
    n_symbols <= word_chars * a / 10000.0::DOUBLE + 3 + 4 * sqrt(word_chars * a / 10000.0::DOUBLE + 1)
    AND n_dup_lines <= n_lines * b / 10000.0::DOUBLE + 2 + 4 * sqrt(n_lines * b / 10000.0::DOUBLE + 1)
    AND n_repeat_words <= n_words * c / 10000.0::DOUBLE + 100 + 4 * sqrt(n_words * c / 10000.0::DOUBLE + 1)
    AND word_length <= d + 4 * d / sqrt(n_words::DOUBLE), false) AS kept
FROM rated LEFT JOIN limits ON rated.lang IS NOT DISTINCT FROM limits.lang AND rated.source IS NOT DISTINCT FROM limits.source
"""
