"""Writers: guarded CSV, JSON-lines logs, vector tables, usage counters."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from kbspark.functions import text as X
from kbspark.session import is_missing
from kbspark.sources.readers import LOG_SCHEMAS


def guard_strings(df: DataFrame) -> DataFrame:
    """Every string column with spreadsheet formulas neutralised."""
    return df.select(*[
        X.guard_formula(F.col(f.name)).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}


def write_csv_guarded(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    guard_strings(df).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


# -- logs -----------------------------------------------------------------

LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"   # ISO, to the microsecond


def write_logs(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append rows as JSON lines. With a batch id, writing the batch again
    replaces it, so a replayed micro-batch does not repeat its lines."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": LOG_TIME}).alias("value"))
    if batch_id is None:
        lines.write.mode("append").text(path)
    else:
        lines.write.mode("overwrite").text(f"{path}/batch={batch_id}")


def write_log(rows: DataFrame, path: str, kind: str, batch_id: int | None = None) -> None:
    """Append rows to the log of a kind in its own folder, with the fields of its schema
    (``readers.LOG_SCHEMAS``): fields the rows do not have are null, other columns are left out."""
    fields = StructType.fromDDL(LOG_SCHEMAS[kind]).fields
    typed = rows.select(*[
        (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    write_logs(typed, f"{path}/{kind}", batch_id)


def write_audit(rows: DataFrame, path: str, batch_id: int) -> None:
    """Add a batch of audit rows; written again, the batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches; none where nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path).drop("batch")
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], schema)


# -- vectors --------------------------------------------------------------

VECTOR_SCHEMA = ("chunk_id bigint, file_name string, chunk_index int, text string, embedding array<float>, "
                 "source string")
MANIFEST_SCHEMA = "version string, source string, file string, rows bigint, least_dim int, most_dim int, checksum string"
FILE = ("version", "source", "file")   # what identifies a file of the table


class DamagedTable(ValueError):
    """The files of a vector table are not those of its manifest."""


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the published manifests, oldest first."""
    fs, folder = _folder(spark, f"{path}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n for n in names if n.startswith("v"))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _stored(spark: SparkSession, path: str, versions: list[str]) -> DataFrame:
    """Rows of the stated versions; other versions' folders are not read."""
    return spark.read.parquet(path).filter(F.col("version").isin(*versions))


def _files(rows: DataFrame, content: bool = True) -> DataFrame:
    """One row per file: its rows and, with ``content``, the least and greatest vector
    size and a sum of row hashes. Without it only file footers are read."""
    file = rows.withColumn("file", F.col("_metadata.file_name"))
    sums = [F.count(F.lit(1)).alias("rows")]
    if content:
        values = [c for c in rows.columns if c not in FILE]
        sums += [F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"),
                 F.sum(F.xxhash64(*values).cast("decimal(38,0)")).cast("string").alias("checksum")]
    return file.groupBy(*FILE).agg(*sums)


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Chunks with their vectors as a new version of the table, which is returned;
    one folder per source and version for partition pruning.

    A manifest (each file's rows, vector sizes and checksum) is written beside
    the data and published by one rename. Until then readers see the table as it
    was, and what a failed job has left is in no manifest. ``append`` keeps the
    files of the last version, ``overwrite`` starts anew. One writer at a time."""
    spark = df.sparkSession
    before = _listed(spark, path)
    if before and mode not in ("append", "overwrite"):
        raise ValueError(f"{path} already holds a vector table")
    version = f"v{len(before) + 1:08d}"
    part = f"{version}-{uuid.uuid4().hex[:12]}"
    df.withColumn("version", F.lit(part)).write.mode("append").partitionBy("source", "version").parquet(path)
    try:
        files = _files(_stored(spark, path, [part]))
    except AnalysisException as error:
        if not is_missing(error):
            raise
        files = spark.createDataFrame([], MANIFEST_SCHEMA)   # no rows were ever written
    if before and mode == "append":
        files = files.unionByName(spark.read.parquet(f"{path}/_manifest/{before[-1]}"))
    fs, draft = _folder(spark, f"{path}/_manifest/_draft-{part}")
    files.write.parquet(draft.toString())
    _, published = _folder(spark, f"{path}/_manifest/{version}")
    if fs.exists(published) or not fs.rename(draft, published):
        raise ValueError(f"another writer has published {version} of {path}")
    return version


def vector_fault(dim: int | None = None) -> Column:
    """Why a row cannot be searched; null when it can."""
    vector = F.col("embedding")
    return (
        F.when(F.col("text").isNull(), "missing_text").when(vector.isNull(), "missing_vector")
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "bad_value")
        .when(F.lit(False) if dim is None else F.size(vector) != dim, "wrong_dimension")
    )


def read_vectors(
    spark: SparkSession, path: str, dim: int | None = None, version: str | None = None, content: bool = False
) -> DataFrame:
    """Rows of the last published version, or of the one named, that can be searched;
    ``vector_rejects`` gives the others. Empty where there is no table yet."""
    return _checked(spark, path, version, content).filter(vector_fault(dim).isNull())


def vector_rejects(spark: SparkSession, path: str, dim: int | None = None, version: str | None = None) -> DataFrame:
    """Stored rows without a text or a vector of ``dim`` finite numbers, with ``reason``."""
    rows = _checked(spark, path, version, False)
    return rows.withColumn("reason", vector_fault(dim)).filter("reason IS NOT NULL")


def _checked(spark: SparkSession, path: str, version: str | None, content: bool) -> DataFrame:
    """The rows of a version after its files were held against the manifest: each is there with
    its number of rows and, with ``content``, the same sums. A table with other files is refused."""
    published = _listed(spark, path)
    if version is not None and version not in published:
        raise DamagedTable(f"{path} has no version {version}")
    if not published:
        return spark.createDataFrame([], VECTOR_SCHEMA)
    manifest = spark.read.parquet(f"{path}/_manifest/{version or published[-1]}")
    parts = [r["version"] for r in manifest.select("version").distinct().collect()]   # one per write
    if not parts:
        return spark.createDataFrame([], VECTOR_SCHEMA)
    try:
        rows = _stored(spark, path, parts)
    except AnalysisException as error:
        if not is_missing(error):
            raise
        raise DamagedTable(f"{path}: every file of the manifest is missing") from error
    found = _files(rows, content)
    sums = [c for c in found.columns if c not in FILE]
    found = found.select(*FILE, F.struct(*sums).alias("found"))
    pairs = manifest.select(*FILE, F.struct(*sums).alias("listed")).join(found, list(FILE), "full")
    missing, unlisted, changed = pairs.agg(
        F.count_if(F.col("found").isNull()), F.count_if(F.col("listed").isNull()),
        F.count_if(F.col("found").isNotNull() & F.col("listed").isNotNull() & ~F.col("found").eqNullSafe(F.col("listed")))).first()
    if missing or unlisted or changed:
        raise DamagedTable(f"{path}: {missing} files missing, {unlisted} not in the manifest, {changed} changed")
    return rows.drop("version")


# -- usage counters -------------------------------------------------------

COUNTERS = ("total_requests", "llm_calls", "estimated_ai_cost")


FAN = 16   # entries of one level that make up an entry of the next


def _entries(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(level, block) of the committed entries; what a failed job has left carries no mark."""
    fs, folder = _folder(spark, path)
    found = []
    for level in (fs.listStatus(folder) if fs.exists(folder) else []):
        for block in fs.listStatus(level.getPath()):
            if fs.exists(_folder(spark, f"{block.getPath()}/_SUCCESS")[1]):
                found.append(tuple(int(p.getName().split("=")[1]) for p in (level.getPath(), block.getPath())))
    return sorted(found)


def _covered(entry: tuple[int, int], entries: list[tuple[int, int]], fan: int) -> bool:
    """An entry of a higher level holds this one's increments."""
    level, block = entry
    return any(above > level and block // fan ** (above - level) == other for above, other in entries)


def _usage_rows(spark: SparkSession, path: str, entries: list[tuple[int, int]], keys) -> DataFrame:
    schema = ", ".join([*(f"{k} string" for k in keys), "month string", "usage_date date", *(f"{c} bigint" for c in COUNTERS)])
    if not entries:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/level={level}/block={block}" for level, block in entries])


def add_usage(delta: DataFrame, path: str, batch_id: int, keys=("tenant_id",), fan: int = FAN) -> None:
    """Add increments of the daily counters (keys, month, usage_date, counters); keys are strings.

    A batch's increments are one entry of level 0, written again as a whole if the
    batch is replayed, so they count once. Batches come in ascending order and only the last
    is ever replayed, as ``foreachBatch`` has it. Once a later batch is there, ``fan`` entries of a
    level are summed into one of the next, which is never written again; they are
    deleted by the call after that, so that readers at work keep their files. At most
    about two times ``fan`` entries of a level remain, and a row is summed once a level."""
    spark = delta.sparkSession
    stored = _entries(spark, path)
    if any(level and batch_id < (block + 1) * fan ** level for level, block in stored):
        raise ValueError(f"batch {batch_id} comes after its successors were summed up")
    delta.select(*keys, "month", "usage_date", *COUNTERS).write.mode("overwrite").parquet(f"{path}/level=0/block={batch_id}")
    for level, block in stored:
        if _covered((level, block), stored, fan):
            fs, folder = _folder(spark, f"{path}/level={level}/block={block}")
            fs.delete(folder, True)
    stored = [e for e in stored if not _covered(e, stored, fan)]
    level = 0
    while any(e[0] >= level for e in stored):
        # A block is full when the batch at hand lies beyond its end.
        full = sorted({b // fan for lv, b in stored if lv == level and (b // fan + 1) * fan ** (level + 1) <= batch_id})
        for block in full:
            parts = [(level, b) for lv, b in stored if lv == level and b // fan == block]
            rows = _summed(_usage_rows(spark, path, parts, keys), [*keys, "month", "usage_date"])
            rows.write.mode("overwrite").parquet(f"{path}/level={level + 1}/block={block}")
            stored = [e for e in stored if e not in parts] + [(level + 1, block)]
        level += 1


def _summed(rows: DataFrame, keys) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def _current(spark: SparkSession, path: str, keys, fan: int) -> DataFrame:
    stored = _entries(spark, path)
    return _usage_rows(spark, path, [e for e in stored if not _covered(e, stored, fan)], keys)


def read_usage(spark: SparkSession, path: str, keys=("tenant_id",), fan: int = FAN) -> DataFrame:
    """Current monthly counters. No rows where nothing is stored yet."""
    return _summed(_current(spark, path, keys, fan), [*keys, "month"])


def read_daily_usage(spark: SparkSession, path: str, keys=("tenant_id",), fan: int = FAN) -> DataFrame:
    """Calls of each day that has any; ``usage.peak_day`` takes them."""
    days = _current(spark, path, keys, fan).groupBy(*keys, "usage_date").agg(F.sum("llm_calls").alias("llm_calls"))
    return days.filter("llm_calls > 0")
