"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.session import work_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; none in a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back. Lineage is cut, and
    later stages read files that survive the loss of executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that tasks write themselves, as a URI."""
    path = work_dir(spark, name)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI, on whichever store it is."""
    return fs.FileSystem.from_uri(uri)


def write_once(folder: str, name: str):
    """A stream to a file that no other attempt of the task writes, and its URI.

    The file counts once a committed row names it; what a lost attempt wrote is
    named nowhere and never read."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{uuid.uuid4().hex[:12]}"
    return system.open_output_stream(f"{path}/{unique}"), f"{folder}/{unique}"


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 2000, of_bytes: int = 8 << 20,
               weight=lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of a bounded number of rows and bytes."""
    held: list[dict] = []
    total = 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if len(held) >= size or total >= of_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded amount of text, one row at least."""
    start, held = 0, 0
    for i, value in enumerate(batch.column(column)):
        size = len(value.as_buffer()) if value.is_valid else 0
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)
