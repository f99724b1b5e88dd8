"""Sentiment of articles in Arrow batches, and of entries over their articles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import filled
from ..sources.staging import release, staged

#: Words of the stand-in scorer, from the adapters' phrases; a fitted model (fit_model) or any Scorer takes its place.
GOOD = ["wins", "record", "rise", "expands", "partners", "upgrade", "launches"]
BAD = ["faces", "settles", "controls", "raises", "downgrade", "falls", "cautious"]
Scorer = Callable[[list[str]], list[tuple[str, float]]]


def lexicon() -> Scorer:
    """A scorer that counts good and bad words; stands in where no model is at hand."""

    def score(texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for t in texts:
            words = t.lower().split()
            good, bad = sum(w in GOOD for w in words), sum(w in BAD for w in words)
            label = "positive" if good > bad else "negative" if bad > good else "neutral"
            out.append((label, 0.5 + 0.5 * abs(good - bad) / max(1, good + bad)))
        return out

    return score


def scored(articles: DataFrame, load: Callable[[], Scorer] = lexicon, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, label, score). load() is called once a task and gives the model; equal texts are scored once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for pdf in batches:
            texts = pdf[text_col].fillna("")
            some = texts.drop_duplicates().tolist()
            found = dict(zip(some, score(some)))
            yield pd.DataFrame({id_col: pdf[id_col], "label": [found[t][0] for t in texts], "score": [found[t][1] for t in texts]})

    return articles.select(id_col, text_col).mapInPandas(run, f"{id_col} long, label string, score double")


#: Words and runs of symbols of a text, and its shape: the share of symbols and of distinct words, and the mean length of words.
SHAPE = r"""SELECT *, array_size(filter(__words, w -> w RLIKE '^[^\\p{L}\\p{N}]')) / greatest(1, array_size(__words)) AS __symbols,
  array_size(array_distinct(__words)) / greatest(1, array_size(__words)) AS __distinct, length(__text) / greatest(1, array_size(__words)) AS __length
FROM (SELECT *, regexp_extract_all(lower(__text), r"[\p{L}\p{N}']+|[^\p{L}\p{N}\s']+", 0) AS __words FROM __THIS__)"""


def fit_model(labelled: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 14, least: int = 10) -> PipelineModel:
    """A text classifier of labelled rows, trained by Spark: logistic regression on hashed words and word pairs that `least` texts have, of one length a text, and on the text's shape.

    Words are cut and hashed once and their counts written: each step that is fitted reads those, not the texts.
    """
    few = labelled.select(filled(F.col(text_col)).alias("__text"), F.col(label_col).alias("__label")).where("__label IS NOT NULL")
    counting, steps = [SQLTransformer(statement=SHAPE), NGram(n=2, inputCol="__words", outputCol="__pairs")], []
    for words, n in (("__words", "__w"), ("__pairs", "__p")):
        counting.append(HashingTF(inputCol=words, outputCol=f"{n}n", numFeatures=features))
        steps += [IDF(inputCol=f"{n}n", outputCol=f"{n}i", minDocFreq=least), Normalizer(inputCol=f"{n}i", outputCol=n)]
    steps += [VectorAssembler(inputCols=["__symbols", "__distinct", "__length"], outputCol="__shape"), StandardScaler(inputCol="__shape", outputCol="__s", withMean=True)]
    steps += [VectorAssembler(inputCols=["__w", "__p", "__s"], outputCol="__features"), StringIndexer(inputCol="__label", outputCol="__index", stringOrderType="alphabetAsc", handleInvalid="skip")]
    steps.append(LogisticRegression(featuresCol="__features", labelCol="__index", predictionCol="__best", probabilityCol="__share", rawPredictionCol="__raw", regParam=1e-3, maxIter=25))
    counts = staged(PipelineModel(counting).transform(few).drop("__text", "__words", "__pairs"))
    fitted = Pipeline(stages=steps).fit(counts)
    release(counts)
    return PipelineModel([*counting, *fitted.stages])


def scored_by(model: PipelineModel, articles: DataFrame, id_col: str = "article_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, label, score): the likeliest label of a fitted model and its probability. Nothing runs in Python."""
    labels = next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels
    steps = PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)])
    out = steps.transform(articles.select(id_col, filled(F.col(text_col)).alias("__text"), *keep))
    share = vector_to_array(F.col("__share"))
    return out.select(id_col, *keep, F.get(F.array(*map(F.lit, labels)), F.col("__best").cast("int")).alias("label"), F.array_max(share).alias("score"))


#: Of the remainders of crc32(id) mod 8, those a model is fitted on and those its probabilities are set by; the others are held out.
FITTED, SET_BY = (0, 1, 2, 3), (4, 5)


def split_of(id_col: Column) -> Column:
    """'fit', 'calibrate' or 'held_out', by a hash of the id."""
    r = F.crc32(id_col.cast("string").cast("binary")) % 8
    return F.when(r.isin(*FITTED), "fit").when(r.isin(*SET_BY), "calibrate").otherwise("held_out")


def fit_calibrated(labelled: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label", features: int = 1 << 14) -> tuple[PipelineModel, IsotonicRegressionModel]:
    """A classifier of the rows that split_of names 'fit' and what sets its probabilities, by those named 'calibrate'.

    A logistic regression on few rows is too sure of itself; the second model is the monotone
    curve from its probability of the likeliest label to how often that label is right.
    """
    parts = labelled.withColumn("__split", split_of(F.col(id_col)))
    model = fit_model(parts.where("__split = 'fit'"), text_col, label_col, features)
    some = parts.where("__split = 'calibrate'").select(id_col, text_col, F.col(label_col).alias("__true")).where("__true IS NOT NULL")
    told = scored_by(model, some, id_col, text_col, keep=["__true"])
    curve = IsotonicRegression(featuresCol="score", labelCol="right", predictionCol="calibrated")
    return model, curve.fit(told.withColumn("right", (F.col("label") == F.col("__true")).cast("double")))


def scored_calibrated(models: tuple[PipelineModel, IsotonicRegressionModel], articles: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    """(id, label, score, split): the likeliest label and how likely it is right. Nothing runs in Python."""
    out = models[1].transform(scored_by(models[0], articles, id_col, text_col))
    return out.select(id_col, "label", F.col("calibrated").alias("score"), split_of(F.col(id_col)).alias("split"))


def overall(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean signed score of non-neutral rows a group, and its verdict; a group of neutral rows only has no row."""
    sign = F.when(F.col("label") == "positive", F.col("score")).when(F.col("label") == "negative", -F.col("score"))
    out = rows.groupBy(*keys).agg(F.avg(sign).alias("mean_score"), F.count(sign).alias("n_scored")).where("n_scored > 0")
    bound = rules.SENTIMENT_BOUND
    return out.withColumn("overall", F.when(F.col("mean_score") >= bound, "Positive").when(F.col("mean_score") <= -bound, "Negative").otherwise("Neutral"))
