"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document id."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm.common import opened, saved, shared_folder, write_once
from kbspark.llm.tokens import byte_bpe

#: Bytes of a file that are read and searched at once.
BLOCK = 4 << 20
#: Id after each document of a flat file of the given byte-level vocabulary: the first one that its tokenizer never gives.
END = 50_257


def write_keyed(docs: DataFrame, tokenizer: str, end: int | None = None, key: str = "doc_id",
                text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Ids of every whole text, each followed by ``end``, one flat file of
    little-endian numbers per task and nothing else in it.

    Returns (file, bytes, itemsize, end), one row per file, and beside the files
    (file, ordinal, key), one row per document. ``end`` is the first id beyond
    the tokenizer's, so no text holds it; one that the tokenizer can give, as for
    a text with the literal of an added token, is refused. Missing texts are
    empty and leave just their end. Ids go to the file as they are made, so a
    task holds one batch of texts."""
    folder = shared_folder(docs.sparkSession, "flat-tokens")
    free = byte_bpe(tokenizer).first_free_id()
    end = free if end is None else end
    if end < free:
        raise ValueError(f"the tokenizer's ids reach up to {free - 1}; {end} cannot end documents")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        kind = encoder.dtype if end <= np.iinfo(encoder.dtype).max else np.dtype("<u4")
        mark = np.array([end], kind).tobytes()
        stream, uri, size, n = None, None, 0, 0
        for batch in batches:
            if stream is None:
                stream, uri = write_once(folder, "tokens")
            for value in batch.column(1):
                data = encoder.encode(value.as_py() or "")
                if kind != encoder.dtype:
                    data = np.frombuffer(data, encoder.dtype).astype(kind).tobytes()
                size += stream.write(data + mark)
            yield _rows(uri, np.arange(n, n + batch.num_rows), batch.column(0), None, None)
            n += batch.num_rows
        if stream is not None:
            stream.close()
            yield _rows(uri, [None], [None], size, kind.itemsize)

    rows = saved(docs.select(F.col(key).cast("long"), text).mapInArrow(
        write, "file string, ordinal long, key long, bytes long, itemsize int"), "flat-files")
    files = rows.where("bytes is not null").select("file", "bytes", "itemsize", F.lit(end).cast("long").alias("end"))
    return files, rows.where("bytes is null").select("file", "ordinal", F.col("key").alias(key))


def _rows(file: str, ordinals, keys, size: int | None, itemsize: int | None) -> pa.RecordBatch:
    n = len(ordinals)
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), pa.array(ordinals, pa.int64()), pa.array(keys, pa.int64()),
         pa.array([size] * n, pa.int64()), pa.array([itemsize] * n, pa.int32())],
        names=["file", "ordinal", "key", "bytes", "itemsize"])


def write_flat(docs: DataFrame, tokenizer: str, end: int | None = None, text: str = "text") -> DataFrame:
    """The files of ``write_keyed`` for texts whose keys are not asked for."""
    return write_keyed(docs.select(F.lit(None).cast("long").alias("key"), F.col(text).alias("text")),
                       tokenizer, end, "key", "text")[0]


def flat_files(spark: SparkSession, folder: str, itemsize: int) -> DataFrame:
    """(file, bytes, itemsize) of the flat files in a folder; only their names and sizes are read."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
             .select(F.col("path").alias("file"), F.col("length").alias("bytes")))
    return found.withColumn("itemsize", F.lit(itemsize))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            system, path = opened(row["file"])
            with system.open_input_file(path) as stream:
                data = stream.read_at(row["length"], row["offset"])
            kind = "<u2" if row["itemsize"] == 2 else "<u4"
            ids = np.frombuffer(data, kind, len(data) // row["itemsize"])
            ends = np.flatnonzero(ids == row["end"]) + row["offset"] // row["itemsize"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "tokens", "ends"])


def scan(files: DataFrame, end: int | None = None, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document of the files.

    Reads (file, bytes, itemsize), and ``end`` from the files' rows unless it is
    given; END where neither says. Files are cut into blocks regardless of
    documents and each block is searched for ``end`` in one vector operation.
    A prefix scan over the blocks of a file then hands on where the document
    that is open at a block's start began and how many have ended before it.
    ``start`` and ``n_tokens`` count ids, the end id included. Ids after a
    file's last end are a document with ``closed`` false; bytes after the last
    whole id, and empty files, hold none."""
    step = block - block % 8
    if end is not None or "end" not in files.columns:
        files = files.withColumn("end", F.lit(END if end is None else end).cast("long"))
    blocks = (files.where("bytes >= itemsize")
              .select("file", "bytes", "itemsize", "end", F.posexplode(F.sequence(
                  F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(step).cast("long"))).alias("block", "offset"))
              .select("file", "itemsize", "end", F.col("block").cast("long"), "offset",
                      F.least(F.lit(step).cast("long"), F.col("bytes") - F.col("offset")).alias("length")))
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = saved(blocks.repartition(n, "file", "block").mapInArrow(
        _search, "file string, block long, tokens long, ends array<long>"), "separators")

    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", "tokens", F.size("ends").cast("long").alias("n"),
                           F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    carried = summary.select(
        "file", "block",
        F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("open"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ended"))
    joined = found.join(carried, ["file", "block"])
    previous = F.when(F.col("pos") == 0, F.col("open")).otherwise(F.element_at("ends", F.greatest("pos", F.lit(1))) + 1)
    closed = (joined.select("file", "open", "ended", "ends", F.posexplode("ends").alias("pos", "at"))
              .select("file", (F.col("ended") + F.col("pos")).alias("ordinal"), previous.alias("start"),
                      (F.col("at") + 1 - previous).alias("n_tokens"), F.lit(True).alias("closed")))
    whole = summary.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("ordinal"),
                                        F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"))
    tail = whole.where("tokens > start").select(
        "file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)
