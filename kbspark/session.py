"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kbspark")
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Dates and months are UTC in every operator."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only where that is unset on one machine, as in tests, is a temporary folder used."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kbspark-")
        spark.sparkContext.setCheckpointDir(root)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _store(df: DataFrame, path: str) -> DataFrame:
    """Write a stage and read it back. Nothing reads the shuffle files behind it again, so Spark removes
    them once it is written rather than whenever the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a stage to the shared folder and read it back: the plan restarts
    from files that survive the loss of executors."""
    return _store(df, work_dir(df.sparkSession, name))


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``cut_lineage`` whose stages are deleted when the block ends: what is
    still wanted of them then must have been stored by the other."""
    paths = []

    def cut(df: DataFrame, name: str = "stage") -> DataFrame:
        paths.append(work_dir(spark, name))
        return _store(df, paths[-1])

    try:
        yield cut
    finally:
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def folder_of(stage: DataFrame) -> str:
    """The folder that a stage just read back lies in."""
    return os.path.dirname(stage.inputFiles()[0]) if stage.inputFiles() else ""


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition for work that is heavy per row, not per byte: always
    ``spark.sql.shuffle.partitions`` parts, which adaptive execution, judging
    by bytes, would merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of a few files spread over the cores; a scan that already has a
    split per core is left alone, so large tables are not shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def is_missing(error: AnalysisException) -> bool:
    """The path does not exist, or holds no data file yet."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def is_folder(spark: SparkSession, path: str) -> bool:
    """A folder of the store, which need not be a local one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
