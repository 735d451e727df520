"""Model and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark import constants as K
from kbspark.catalog import fixtures as X
from kbspark.catalog import sqlkit as Q
from kbspark.catalog.fixtures import sql, table
from kbspark.operators import models

QUERIES: dict = {}
ORACLES: dict = {}
LANGS = ("de", "en", "es", "fr")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("label_decode", sql(f"""SELECT vec_id, coalesce({X.sql_pick('label', *map(Q.lit, K.INTENT_LABELS))}, 'general_query') AS intent FROM embeddings"""))
def label_decode(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", models.label_name(F.col("label")).alias("intent"))


@query("embed_text")
def embed_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.embed(docs, F.col("text"), dim=256).select("doc_id", "embedding")


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("label"))


def intent_model(spark, sf_dir):
    return models.train_intent(labelled(spark, sf_dir).filter(~models.in_test_split(F.col("doc_id"))), LANGS)


@query("intent_train")
def intent_train(spark, sf_dir):
    """Report on the rows held back from training."""
    held = labelled(spark, sf_dir).filter(models.in_test_split(F.col("doc_id")))
    scored = models.score_intent(intent_model(spark, sf_dir), held, LANGS)
    return models.classification_report(scored.select(F.col("label").alias("actual"), F.col("intent").alias("predicted")), LANGS)


@query("intent_score")
def intent_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return models.score_intent(intent_model(spark, sf_dir), docs, LANGS).drop("text")


@query("sentiment_score")
def sentiment_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("quality").alias("y"))
    return models.score_sentiment(models.train_sentiment(rated), docs).drop("text")


_COUNTS = ", ".join(f"count(*) FILTER (WHERE predicted = '{k}') AS {k}" for k in K.INTENT_LABELS)


@query("confusion_matrix", sql(f"SELECT actual, {_COUNTS} FROM predictions GROUP BY actual"))
def confusion_matrix(spark, sf_dir):
    return models.confusion_matrix(X.predictions(spark, sf_dir))


@query("classification_report", sql("""SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, support FROM
    (SELECT * FROM per_class UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END) AS a, count(*) AS n FROM predictions)
     UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support)::BIGINT FROM per_class
     UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM per_class)""",
    per_class="""SELECT label, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, support FROM
        (SELECT l.label, CASE WHEN max(g) > 0 THEN count(*) FILTER (WHERE actual = predicted) / max(g) ELSE 0 END AS p,
            count(*) FILTER (WHERE actual = predicted) / count(*) AS r, count(*) AS support
         FROM (SELECT predicted AS label, count(*)::DOUBLE AS g FROM predictions GROUP BY 1) l JOIN predictions ON actual = label GROUP BY l.label)"""))
def classification_report(spark, sf_dir):
    report = models.classification_report(X.predictions(spark, sf_dir))
    return report.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("accuracy", sql("SELECT round(avg(CASE WHEN actual = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM predictions"))
def accuracy(spark, sf_dir):
    return models.accuracy(X.predictions(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))
