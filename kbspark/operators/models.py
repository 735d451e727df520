"""Embedding, intent and sentiment models, and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from kbspark import constants as K
from kbspark.functions import text as X
from kbspark.operators.dedupe import WORD

DIM = 1024


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def features(df: DataFrame, text: Column, dim: int = DIM) -> DataFrame:
    """``features``: hashed word counts of unit length."""
    counted = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dim).transform(
        df.withColumn("_words", tokens(text)))
    return Normalizer(inputCol="_counts", outputCol="features", p=2.0).transform(counted).drop("_words", "_counts")


def embed(df: DataFrame, text: Column, dim: int = DIM, model=None) -> DataFrame:
    """``embedding`` of a text. The default is deterministic hashed word
    counts; ``model`` may be any column function text -> array<float>, such as
    a ``predict_batch_udf`` around a sentence encoder."""
    if model is not None:
        return df.withColumn("embedding", model(text))
    return features(df, text, dim).withColumn("embedding", vector_to_array("features", "float32")).drop("features")


def embed_chunks(chunks: DataFrame, dim: int = DIM, model=None) -> DataFrame:
    """Index vectors: chunks are embedded together with their header."""
    whole = X.chunk_with_header(F.col("source"), F.col("file_name"), F.col("chunk_index"), F.col("text"))
    return embed(chunks, whole, dim, model)


# -- classifiers ----------------------------------------------------------

def label_id(label: Column, labels) -> Column:
    """Position of the label in the list; null when it is not listed."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), label).cast("int"), F.lit(0)) - 1


def label_name(index: Column, labels=K.INTENT_LABELS, default: str = K.DEFAULT_INTENT) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), index), F.lit(default))


def in_test_split(row_id: Column, share: int = 5) -> Column:
    """One row in ``share``, chosen by its id: the same on every run."""
    return F.pmod(F.xxhash64(row_id), F.lit(share)) == 0


def train_intent(rows: DataFrame, labels, c: float = 1.0, max_iter: int = 1000):
    """Multinomial logistic regression with L2 penalty over (text, label) rows.

    The objective is a mean over rows, hence the penalty is divided by their number."""
    data = features(rows.withColumn("y", label_id(F.col("label"), labels).cast("double")).filter("y is not null"), F.col("text"))
    data = data.select("features", "y")
    n = max(data.count(), 1)
    classifier = LogisticRegression(
        featuresCol="features", labelCol="y", family="multinomial", maxIter=max_iter, regParam=1.0 / (c * n),
        elasticNetParam=0.0, standardization=False)
    return classifier.fit(data)


def score_intent(model, rows: DataFrame, labels, text: str = "text", default: str = K.DEFAULT_INTENT) -> DataFrame:
    """intent, intent_confidence, intent_model_used, intent_status of each row.
    An empty text gets the default without the model."""
    scored = model.transform(features(rows, F.col(text)))
    probs = vector_to_array("probability")
    best = F.array_max(probs)
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    return scored.withColumns({
        "intent": F.when(empty, default).otherwise(
            label_name((F.array_position(probs, best) - 1).cast("int"), labels, default)),
        "intent_confidence": F.when(empty, 0.0).otherwise(best),
        "intent_model_used": ~empty,
        "intent_status": F.when(empty, "Empty input.").otherwise("Intent successfully predicted."),
    }).drop("features", "rawPrediction", "probability", "prediction")


def train_sentiment(rows: DataFrame):
    """Binary model over (text, y) rows; y = 1 is positive."""
    data = features(rows, F.substring("text", 1, K.SENTIMENT_CHARS)).select("features", F.col("y").cast("double").alias("y"))
    return LogisticRegression(featuresCol="features", labelCol="y", maxIter=200, regParam=0.01).fit(data)


def score_sentiment(model, rows: DataFrame, text: str = "text") -> DataFrame:
    """sentiment and its score on the head of the text the model is defined on;
    a blank text has none."""
    scored = model.transform(features(rows, F.substring(text, 1, K.SENTIMENT_CHARS)))
    positive = F.get(vector_to_array("probability"), F.lit(1))
    blank = F.length(X.strip(F.coalesce(F.col(text), F.lit("")))) == 0
    return scored.withColumns({
        "sentiment": F.when(blank, "").when(positive >= 0.5, "POSITIVE").otherwise("NEGATIVE"),
        "sentiment_score": F.when(blank, 0.0).otherwise(F.greatest(positive, 1 - positive)),
    }).drop("features", "rawPrediction", "probability", "prediction")


# -- evaluation -----------------------------------------------------------

def _cells(predictions: DataFrame) -> DataFrame:
    """Counts per (actual, predicted): all later work is on this small table."""
    return predictions.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, labels=K.INTENT_LABELS) -> DataFrame:
    """One row per actual label, one column per predicted label, zeros kept."""
    spark = predictions.sparkSession
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("actual"))
    counts = _cells(predictions).groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n"))
    return rows.join(counts, "actual", "left").na.fill(0)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("actual") == F.col("predicted")).cast("int")).alias("accuracy"))


def classification_report(predictions: DataFrame, labels=K.INTENT_LABELS) -> DataFrame:
    """label, precision, recall, f1, support: each class, accuracy, macro and weighted averages."""
    cells = _cells(predictions)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hits")),
            F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hits")),
        )).alias("s")).select("s.*").filter(F.col("label").isin(*labels))
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hits").alias("hits"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    p, r = ratio(F.col("hits"), F.col("guessed")), ratio(F.col("hits"), F.col("support"))
    per_class = sums.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    scores = ("precision", "recall", "f1")
    columns = ["label", *scores, "support"]
    macro = per_class.agg(*[F.avg(c).alias(c) for c in scores], F.sum("support").alias("support")).withColumn(
        "label", F.lit("macro avg"))
    weighted = per_class.agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in scores],
        F.sum("support").alias("support")).withColumn("label", F.lit("weighted avg"))
    share = per_class.agg((F.sum("hits") / F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    overall = share.select(F.lit("accuracy").alias("label"), F.col("f1").alias("precision"), F.col("f1").alias("recall"), "f1", "support")
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in (per_class, overall, macro, weighted)])
