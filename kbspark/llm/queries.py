"""One query for each operator, over its whole table, and the SQL that checks those SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import (chat, elias_fano, hilbert_codes, line_dedup, mixing, multi_index, partition_join, separator_scan, spotsigs,
                         toxicity, url_rules, viterbi, whitening)
from kbspark.llm.common import table

#: Vocabulary files, as a parameter of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_mixing_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.curriculum(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken",
                       F.col("takes")["position"].alias("positions"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids in flat files, and what a scan of these files finds, with
    the doc_id that was noted for each place when the files were written."""
    files, keys = separator_scan.write_keyed(table(spark, sf_dir, "documents"), BYTE_BPE)
    found = separator_scan.scan(files).join(keys, ["file", "ordinal"], "left")
    return found.select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.read(elias_fano.write(table(spark, sf_dir, "documents"), BYTE_BPE))


def op5_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether they decode to that very text."""
    rows = viterbi.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_partition_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_hilbert_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_codes.codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_chat_perspectives, op2_mixing_curriculum, op3_separator_scan, op4_token_files, op5_url_association_rules, op6_inverted_multi_index,
    op7_sentencepiece_viterbi, op8_toxicity_lexicon, op9_partition_jaccard_join,
    op10_spotsigs_fingerprints, op11_line_dedup, op12_chebyshev_whitening, op13_hilbert_codes)}

ORACLES = {"op1_chat_perspectives": chat.SQL, "op11_line_dedup": line_dedup.SQL, "op13_hilbert_codes": hilbert_codes.SQL}
