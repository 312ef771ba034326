"""Text quality by co-training of two classifiers.

One classifier sees hashed words, word shapes and repeated neighbours of the text, the other metadata of the page: language, source, length, lines
and the make-up of its characters. Both start from the same labelled rows. In every round each rates all unlabelled rows and hands its
sure verdicts to the other as labels; of these a fit reads a bounded number, dealt out evenly to all languages and sources. Their margins are
then calibrated on labelled rows kept aside, and added up as log-odds, which score all documents.

The counts of terms and the metadata of all rows are written once; every rating reads them again.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.language import held_out
from pastward.llm.work import Work
from pastward.operators.skew import joined_to_groups

LABELLED = 8192  # labelled rows that are learnt from, at most; drawn by a hash of the id
GIVEN = 2048  # verdicts of a round that a fit reads, as expected; drawn by a hash of the id from all sure ones
ROUNDS = 3
SURE = 0.95
TEXT_BITS, META_BITS = 14, 10
WORDS = r"\S+"  # the words of WORD: this class is that of Java
VIEWS = ("text", "meta")
META = ("lang", "source", "log_chars", "log_lines", "line_length", "word_length", "letter_share", "upper_share", "distinct_share")


def _views(docs: DataFrame, *carried: str) -> DataFrame:
    """``carried`` columns, and the vectors ``counts`` (of terms) and ``meta_view`` of each row."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a"), r"\p{N}+", "0")
    shapes = F.transform(F.regexp_extract_all(plain, F.lit(WORDS), F.lit(0)), lambda w: F.concat(F.lit("\n"), w))
    again = F.filter(F.transform("words", lambda w, i: F.when(w == F.get("words", i - 1), F.lit("\v"))), lambda x: x.isNotNull())
    chars, lines = F.char_length(text), F.size(F.split(text, "\n"))
    share = lambda n: n / F.greatest(chars, F.lit(1))
    more = [c for c in carried if c not in ("lang", "source")]
    rows = docs.select(*more, "text", "lang", "source", words.alias("words"))
    rows = rows.select(
        *more,
        F.concat("words", shapes, again).alias("terms"),
        "lang",
        "source",
        (F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1))).alias("distinct_share"),
        F.log1p(chars).alias("log_chars"),
        F.log1p(lines).alias("log_lines"),
        F.log1p(chars / lines).alias("line_length"),
        F.log1p(chars / F.greatest(F.size("words"), F.lit(1))).alias("word_length"),
        share(F.char_length(F.regexp_replace(text, r"\P{L}+", ""))).alias("letter_share"),
        share(F.char_length(F.regexp_replace(text, r"\P{Lu}+", ""))).alias("upper_share"),
    )
    rows = HashingTF(numFeatures=1 << TEXT_BITS, inputCol="terms", outputCol="counts").transform(rows)
    rows = FeatureHasher(inputCols=list(META), outputCol="meta_view", numFeatures=1 << META_BITS).transform(rows)
    return rows.select(*carried, "counts", "meta_view")


def _ready(rows: DataFrame) -> DataFrame:
    """With ``text_view``, the counts at length one."""
    return Normalizer(inputCol="counts", outputCol="text_view").transform(rows).drop("counts")


def _margin(model: LogisticRegressionModel, df: DataFrame, view: str) -> DataFrame:
    """``df`` with the model's log-odds in ``margin_<view>``."""
    names = {"rawPredictionCol": "raw", "probabilityCol": "share", "predictionCol": "verdict"}
    out = model.copy({getattr(model, k): v for k, v in names.items()}).transform(df)
    return out.withColumn(f"margin_{view}", vector_to_array("raw")[1]).drop("raw", "share", "verdict")


def _drawn(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, the same for the same ids."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def _learnable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("doc_id").isNotNull() & ~held_out())


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, label): of several labels of one id the largest."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("label"))


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The views of one row of each id, with the columns of ``ids``; ``ids`` is small."""
    rows = docs.select("doc_id", "text", "lang", "source").join(ids, "doc_id").dropDuplicates(["doc_id"])
    return _ready(_views(rows, *ids.columns))


def _sample(work: Work, docs: DataFrame, known: DataFrame) -> DataFrame:
    """The labelled rows to learn from: doc_id, label, aside, text_view, meta_view."""
    drawn = work.put(_drawn(_learnable(docs.select("doc_id")).distinct().join(known, "doc_id"), LABELLED, 1))
    aside = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(5)) == 0
    return work.put(_picked(docs, drawn.withColumn("aside", aside)))


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=f"{view}_view", labelCol="label", maxIter=30, regParam=1e-4).fit(rows.select(f"{view}_view", "label"))


def _verdicts(work: Work, rated: DataFrame, margin: str, step: int) -> DataFrame:
    """(doc_id, label): sure verdicts of all rated rows, drawn evenly from the languages, sources and labels that have any.

    A group of n sure rows gives each of them with the chance GIVEN / (groups * n), so the rarest group takes part as a whole and a fit reads about
    ``GIVEN`` rows.
    """
    bar = math.log(SURE / (1 - SURE))
    group = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source")], "label")
    sure = rated.where(F.abs(margin) >= bar).withColumn("label", (F.col(margin) > 0).cast("double")).withColumn("group", group).select("doc_id", "label", "group")
    sizes = work.put(sure.groupBy("group").agg(F.count("*").alias("n")))
    groups = sizes.count()
    drawn = F.pmod(F.xxhash64(F.lit(step), F.lit(4), "doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    known = joined_to_groups(sure, sizes, ["group"], "n")
    return known.where(drawn * F.col("n") * float(max(groups, 1)) < float(GIVEN)).select("doc_id", "label")


def _co_trained(work: Work, docs: DataFrame, rows: DataFrame, known: DataFrame, sample: DataFrame) -> dict[str, LogisticRegressionModel]:
    """Both models after ``ROUNDS`` exchanges on all unlabelled rows of ``rows`` (doc_id, lang, source and the views)."""
    start = sample.where("not aside")
    columns = ["doc_id", "label", "text_view", "meta_view"]
    given: DataFrame | None = None  # (doc_id, taker, label and views) of the verdicts handed over so far
    models = {}
    for step in range(ROUNDS + 1):
        for view in VIEWS:
            more = start.select(*columns)
            models[view] = _fit(more if given is None else more.unionByName(given.where(F.col("taker") == view).select(*columns)), view)
        if step == ROUNDS:
            return models
        rated = _learnable(rows)
        for view in VIEWS:
            rated = _margin(models[view], rated, view)
        rated = rated.select("doc_id", "lang", "source", *[f"margin_{view}" for view in VIEWS]).dropDuplicates(["doc_id"])
        rated = work.put(rated.join(known, "doc_id", "left_anti"))
        new = None
        for giver, taker in (VIEWS, VIEWS[::-1]):
            left = rated if given is None else rated.join(given.where(F.col("taker") == taker).select("doc_id"), "doc_id", "left_anti")
            part = _verdicts(work, left, f"margin_{giver}", step).withColumn("taker", F.lit(taker))
            new = part if new is None else new.unionByName(part)
        new = work.put(new)
        ids = work.put(new.select("doc_id").distinct())
        fresh = work.put(_picked(docs, ids).join(new, "doc_id"))
        given = fresh if given is None else given.unionByName(fresh)


def _calibrated(models: dict[str, LogisticRegressionModel], sample: DataFrame) -> Column:
    """The score of a row with both margins: calibrated log-odds of the views, less the prior counted twice."""
    aside = sample.where("aside")
    for view in VIEWS:
        aside = _margin(models[view], aside, view)
    aside = VectorAssembler(inputCols=["margin_text"], outputCol="by_text").transform(VectorAssembler(inputCols=["margin_meta"], outputCol="by_meta").transform(aside))
    aside = aside.select("label", "by_text", "by_meta", "margin_text", "margin_meta").persist()
    good, n = aside.agg(F.sum("label"), F.count("*")).collect()[0]
    if not n or good in (0, n):  # nothing to calibrate on: the margins as they are, with equal weight
        aside.unpersist()
        return 1 / (1 + F.exp(-(F.col("margin_text") + F.col("margin_meta")) / 2))
    odds = F.lit(-math.log(good / (n - good)))
    for view in VIEWS:
        fit = LogisticRegression(featuresCol=f"by_{view}", labelCol="label", regParam=1e-6).fit(aside)
        odds = odds + F.col(f"margin_{view}") * float(fit.coefficients[0]) + float(fit.intercept)
    aside.unpersist()
    return 1 / (1 + F.exp(-odds))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The probability that a text is of good quality: doc_id, held_out, score, kept (score of one half at least).

    Learns from rows with an id that are not held out (see ``language.held_out``): at most ``LABELLED`` labelled ones, of which a
    fifth calibrates. All others of them are rated in each round; a fit reads about ``GIVEN`` sure ones more. Of several labels of one id the
    largest counts; rows that share an id are learnt from once. A null text counts as empty, a null lang or source as none. Without labels of both kinds all scores are the share
    of good labels (one half without any). One row for each row of ``docs``, repeated rows included.
    """
    work = Work(docs.sparkSession)
    known = work.put(_known(labels))
    sample = _sample(work, docs, known)
    kinds = [r["label"] for r in sample.where("not aside").select("label").distinct().limit(2).collect()]
    if len(kinds) < 2:
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(kinds[0] if kinds else 0.5).alias("score")).withColumn("kept", F.col("score") >= 0.5)
    views = work.put(_views(docs, "doc_id", "lang", "source"))
    models = _co_trained(work, docs, _ready(views), known, sample)
    value = _calibrated(models, sample)
    rows = _ready(views)
    for view in VIEWS:
        rows = _margin(models[view], rows, view)
    return rows.select("doc_id", held_out().alias("held_out"), value.alias("score")).withColumn("kept", F.col("score") >= 0.5)
