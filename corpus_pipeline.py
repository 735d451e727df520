"""Toxicity, near-duplicates, mixture and token ids of a corpus, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import mixing, partition_join, toxicity, viterbi
from kbspark.llm.common import saved, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold. The lexicon is learnt
    from the labelled ones among them.

    Missing, empty and wordless texts score least and stay; texts of any length are scored whole; rows of equal text
    share a fate, repeated rows included. A row without an id, or whose id has no label, is scored and not learnt from. Columns of any
    name stay as they are. Without labels, or documents, nothing is dropped."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.score(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains of Jaccard links join, the one of the smallest id.

    Missing, empty and wordless texts link with nothing and stay, as do rows without an id, each of them. Of
    repeated rows of one id one stays, whatever their texts. Texts of any length are compared whole. Columns of
    any name stay as they are. An empty table stays empty."""
    return partition_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes at least half of it.

    Missing, empty and wordless texts have nothing to take and leave. A missing source is a source of its own; rows
    without an id enter by their own source and text. Repeated rows enter as often as the first of them; ties in position are in the order of
    ids. Texts and columns of any length and name stay as they are. An empty table stays empty."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their whole texts, in new columns ids and round_trip.

    A missing or empty text has no ids and comes back as an empty one. Every row is encoded for itself, so repeated rows, missing
    ids and clashing columns change nothing; columns called ids or round_trip are replaced. An empty table stays empty."""
    return viterbi.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the lexicon's learning nor the hash order of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
