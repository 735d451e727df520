"""Streaming jobs over a request log or a folder of incoming files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from kbspark import constants as K
from kbspark.functions import text as X
from kbspark.operators import access, chunking, models, usage
from kbspark.plans import kb
from kbspark.session import DEFAULTS, cut_lineage, is_folder, is_missing
from kbspark.sources import sinks
from kbspark.streaming.processors import MonthlyQuota, SlidingLog

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATENESS = "10 minutes"
REMEMBERED_HOURS = 24   # how long an expired state can still be told from an unknown one


def stateful(spark: SparkSession) -> None:
    """Keyed state of any size needs the RocksDB store."""
    spark.conf.set(PROVIDER, DEFAULTS[PROVIDER])


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table of the folder, one file or a folder of files, as a stream of its files."""
    table = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, table):
        return reader.parquet(table)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_available(
    stream: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Process what is there, to parquet at ``path`` or through ``sink``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").option("path", path).outputMode("append").start()
    query.awaitTermination()
    return query


def limited(log: DataFrame, keys, limits: dict[str, int], window_seconds: int, lateness: str = LATENESS) -> DataFrame:
    """event_id, accepted of a log stream, state per key."""
    stateful(log.sparkSession)
    rows = log.select("ts", "us", "event_id", "endpoint", *[k for k in keys if k != "endpoint"]).withWatermark("ts", lateness)
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=SlidingLog(limits, window_seconds), outputStructType="event_id bigint, accepted boolean",
        outputMode="Append", timeMode="EventTime")


def quota(log: DataFrame, request_cap: int, llm_cap: int, lateness: str = LATENESS) -> DataFrame:
    """event_id, api_key, month, allowed, block_reason of a log stream."""
    stateful(log.sparkSession)
    rows = log.withColumn("month", usage.month_of(F.col("ts"))).select(
        "ts", "us", "event_id", "api_key", "month", "is_capped").withWatermark("ts", lateness)
    return rows.groupBy("api_key", "month").transformWithStateInPandas(
        statefulProcessor=MonthlyQuota(request_cap, llm_cap),
        outputStructType="event_id bigint, api_key string, month string, allowed boolean, block_reason string",
        outputMode="Append", timeMode="EventTime")


def usage_sink(path: str, fan: int = sinks.FAN) -> Callable[[DataFrame, int], None]:
    """Add each micro-batch's daily counters; a replayed batch counts once."""
    return lambda batch, batch_id: sinks.add_usage(usage.usage_increments(batch), path, batch_id, fan=fan)


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, batch_id: sinks.write_logs(batch, path, batch_id)


def interactions(
    states: DataFrame, lookups: DataFrame, ttl_hours: int = K.INTERACTION_TTL_HOURS, remembered_hours: int = REMEMBERED_HOURS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Every lookup with ``state_status`` and the columns of its state.

    Valid and expired lookups leave at once; those without a state leave as unknown when
    the watermarks of both sides have passed them, since a late state may still turn up. A state
    is kept for ``remembered_hours`` beyond its time to live, so that lookups up to then find it
    expired; later ones are unknown. Watermarks move with rows only: in a quiet
    time, or at the end of a finite log, send both sides a heartbeat, a row with a later
    time and the id of a tenant that nobody is; rows without an id are left out
    before they move a watermark. Such a lookup may come out itself."""
    s = states.withWatermark("created_at", lateness).select(
        F.col("interaction_id").alias("state_id"), F.col("tenant_id").alias("state_tenant"),
        "created_at", "expires_at", "purpose", "key_points")
    k = lookups.withWatermark("requested_at", lateness)
    known = (
        (F.col("interaction_id") == F.col("state_id")) & (F.col("tenant_id") == F.col("state_tenant"))
        & (F.col("requested_at") >= F.col("created_at"))
        & (F.col("requested_at") <= F.col("created_at") + F.expr(f"INTERVAL {ttl_hours + remembered_hours} HOURS"))
    )
    return k.join(s, known, "left_outer").drop("state_id", "state_tenant").withColumn("state_status", access.state_status())


class VectorLimitExceeded(ValueError):
    pass


def index_sink(path: str, dim: int = models.DIM, max_vectors: int | None = None) -> Callable[[DataFrame, int], None]:
    """Clean, chunk, de-duplicate within each file, embed and store files (file_name, content).

    A batch leaves two folders, each written again as a whole when it is replayed: its chunks
    and, after them, one row per file with the reason of a refusal. ``read_index`` gives the chunks of
    each file's last accepted content, so a changed file replaces the old one and a refused change
    leaves it as it is; ``index_rejects`` gives the refusals. A file whose stored content is the same
    is left out. Of several contents of one name in a batch, the one with the greatest
    hash enters and the others are refused. A batch looks at the rows of its
    own file names in the table of files, not at chunks. Where ``max_vectors`` is
    given, a batch after which the index would hold more fails."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clean = batch.select("file_name", "content", X.kb_clean(F.col("content")).alias("clean"))
        offered = clean.select(
            "file_name", "clean", F.sha2(F.coalesce("clean", F.lit("")), 256).alias("content_hash"),
            F.when(F.coalesce("file_name", F.lit("")) == "", "MISSING_FILE_NAME").otherwise(
                X.kb_reject_reason(F.col("content"), F.col("clean"))).alias("reason"),
        ).dropDuplicates(["file_name", "content_hash", "reason"])
        stored = _files(spark, path)
        if stored is not None:
            offered = cut_lineage(offered, "offered")
            mine = stored.filter(F.col("batch") < batch_id).join(offered.select("file_name").distinct(), "file_name", "left_semi")
            offered = offered.join(_current(mine), ["file_name", "content_hash"], "left_anti")
        offered = cut_lineage(offered, "changed")
        entering = offered.filter("reason IS NULL").groupBy("file_name").agg(F.max("content_hash").alias("entering"))
        judged = cut_lineage(offered.join(entering, "file_name", "left").withColumn("reason", F.coalesce(
            "reason", F.when(F.col("content_hash") != F.col("entering"), "replaced_in_batch"))), "judged")
        files = judged.filter("reason IS NULL").select(
            F.lit("UPLOADED_KB").alias("source"), "file_name", "content_hash", F.col("clean").alias("content"))
        chunks = kb.dedupe_chunks(chunking.chunk(files), scope="file_name")
        if max_vectors is not None:
            chunks = cut_lineage(chunks, "chunks")
            others = 0 if stored is None else read_index(spark, path, batch_id).join(files, "file_name", "left_anti").count()
            if others + chunks.count() > max_vectors:
                raise VectorLimitExceeded(f"vector_limit_exceeded: max={max_vectors}")
        written = f"{path}/batch={batch_id}"
        models.embed_chunks(chunks, dim).write.mode("overwrite").parquet(written)
        counted = spark.read.schema("file_name string").parquet(written).groupBy("file_name").agg(F.count(F.lit(1)).alias("n_chunks"))
        judged.join(counted, "file_name", "left").select(
            "file_name", "content_hash", F.coalesce("reason", F.when(F.col("n_chunks").isNull(), "no_valid_chunks")).alias("reason"),
        ).write.mode("overwrite").parquet(f"{path}/_files/batch={batch_id}")

    return sink


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("file_name string, content_hash string, reason string, batch bigint").parquet(f"{path}/_files")
    except AnalysisException as error:
        if is_missing(error):
            return None
        raise


def _current(files: DataFrame) -> DataFrame:
    """(file_name, batch, content_hash) of each file's last accepted content."""
    last = F.max(F.struct("batch", "content_hash")).alias("last")
    return files.filter("reason IS NULL").groupBy("file_name").agg(last).select("file_name", "last.*")


def read_index(spark: SparkSession, path: str, before_batch: int | None = None) -> DataFrame:
    """Chunks of each file's last accepted content, as all batches or those before one have left them."""
    files = _files(spark, path)
    if before_batch is not None:
        files = files.filter(F.col("batch") < before_batch)
    chunks = spark.read.parquet(path)
    return chunks.withColumn("batch", F.col("batch").cast("bigint")).join(
        _current(files).drop("content_hash"), ["file_name", "batch"], "left_semi")


def index_rejects(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content_hash, reason, batch of every refused file."""
    return _files(spark, path).filter("reason IS NOT NULL")
