"""Readers: knowledge-base files, address lists, policies, labelled text, logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbspark.functions import text as X
from kbspark.session import is_missing

# Fields of the JSON-lines logs.
LOG_SCHEMAS = {
    "api_predict_results": "tenant_id string, request_id string, created_at timestamp, workflow_type string, purpose string, "
        "key_points string, customer_context_summary struct<summary:string,key_details:array<string>>, ops_query string, "
        "intent string, generated_reply string, latency_ms bigint",
    "api_requests": "tenant_id string, request_id string, endpoint string, created_at timestamp, status string, "
        "latency_ms bigint, ip_hash string, user_agent string",
    "escalation": "tenant_id string, request_id string, endpoint string, created_at timestamp, escalation_reason string, "
        "ip_hash string",
    "kb_ingestion_status": "tenant_id string, request_id string, status string, filename string, error string, "
        "timestamp timestamp",
    "intent_model_status": "tenant_id string, interaction_id string, created_at timestamp, intent string, "
        "intent_model_used boolean, intent_confidence double, intent_status string",
    "api_retrieval_results": "tenant_id string, request_id string, interaction_id string, created_at timestamp, "
        "ip_hash string, retrieval_results array<struct<rank:int,score:double,source:string,chunk_preview:string>>",
    "feedback": "interaction_id string, rating int, feedback_type string, comment string, timestamp timestamp",
}


def decode(content: Column, errors: str = "replace") -> Column:
    """Bytes as text; undecodable ones become U+FFFD or, with ``ignore``, nothing."""
    raw = content.cast("string")
    fixed = F.make_valid_utf8(raw)
    if errors == "ignore":
        fixed = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(fixed, F.lit("�"), F.lit("")))
    return X.strip(fixed)


def text_files(files: DataFrame, source: str | Column, errors: str = "replace") -> DataFrame:
    """source, file_name, content of the ``.txt`` rows of a (path, content) table."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    origin = F.lit(source) if isinstance(source, str) else source
    return files.filter(F.lower("path").endswith(".txt")).select(
        origin.alias("source"), name.alias("file_name"), decode(F.col("content"), errors).alias("content"))


def scan_kb_text(spark: SparkSession, path: str, source: str, errors: str = "replace") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(path)
    return text_files(files.select("path", "content"), source, errors)


def scan_url_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Distinct addresses of ``{"urls": [...]}`` files; a missing or broken file has none."""
    schema = "urls array<string>"
    try:
        lists = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        lists = spark.createDataFrame([], schema)
    return lists.select(F.explode("urls").alias("url")).distinct()


def scan_policy_json(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content of policy objects, one per file, as readable lines."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return files.select(
        F.regexp_extract("path", "[^/]*$", 0).alias("file_name"), X.policy_text(F.col("value")).alias("content"))


def scan_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """text, label rows of a CSV file with header; blank lines are skipped."""
    rows = spark.read.schema("text string, label string").options(header="true", quote='"', escape='"').csv(path)
    return rows.filter("text is not null and label is not null")


def scan_logs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMAS[kind]).json(path)
