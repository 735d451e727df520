"""Token ids in binary files whose document boundaries are Elias-Fano coded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import opened, saved, shared_folder, slices, write_once
from kbspark.llm.tokens import byte_bpe

#: Id after each document.
END = 2
#: Every so many ones of the upper half, the select directory notes a position.
SAMPLE = 512
MAGIC = b"EFTOK002"
#: Bytes of ids in a file, about; positions in its bit rows fit 32 bits.
FILE_BYTES = 64 << 20
#: Boundaries that a reader decodes at once.
RUN = 4096
#: At the end of a file: bytes of an id, rows, rows without doc_id, least doc_id,
#: ids, and the bytes of the coded boundaries and doc_ids.
FOOTER = "<QQQqQQQ"
PART = "<QQQQQ"


class EliasFano:
    """A non-decreasing sequence of numbers from 0 on, in about 2 + log2(largest / n) bits each.

    The lower bits of each number are packed; its upper bits are a one in a bit
    row, after as many zeros as the upper bits say. ``select`` finds the i-th
    number through a directory of every 512th one."""

    def __init__(self, n: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, directory: np.ndarray | None = None):
        self.n, self.low_bits, self.lower, self.upper = n, low_bits, lower, upper
        if directory is None:
            directory = self._ones()[::SAMPLE].astype("<u4")
        self.directory = directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low = max(int(values[-1] // np.uint64(n)).bit_length() - 1, 0) if values[-1] >= n else 0
        shifts = np.arange(low, dtype=np.uint64)
        parts = [np.packbits(((values[i:i + 65_536, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
                 for i in range(0, n, 65_536)] if low else []  # 65,536 rows of bits end on a byte
        places = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
        row = np.zeros(int(places[-1]) + 1, np.uint8)
        row[places.astype(np.int64)] = 1
        return cls(n, low, np.concatenate(parts) if parts else np.zeros(0, np.uint8), np.packbits(row, bitorder="little"))

    def _ones(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))[:self.n]

    def _lows(self, start: int, stop: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(stop - start, np.uint64)
        first, last = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.lower[first // 8:-(-last // 8)], bitorder="little")[first % 8:first % 8 + last - first]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return bits.reshape(-1, self.low_bits).astype(np.uint64) @ weights

    def run(self, start: int, stop: int) -> np.ndarray:
        """The numbers from the ``start``-th up to the ``stop``-th one, found through the directory; memory goes with the run."""
        if start >= stop:
            return np.zeros(0, np.uint64)
        first = start // SAMPLE
        last = -(-stop // SAMPLE)
        byte = int(self.directory[first]) // 8
        end = int(self.directory[last]) // 8 + 1 if last < len(self.directory) else len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[byte:end], bitorder="little")) + byte * 8
        ones = ones[ones >= int(self.directory[first])][start - first * SAMPLE:stop - first * SAMPLE]
        return ((ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(start, stop)

    def values(self) -> np.ndarray:
        return self.run(0, self.n)

    def select(self, i: int) -> int:
        """The i-th number, from the directory and a few bytes of the bit row."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        left += bin(int(self.upper[byte]) & ((1 << at % 8) - 1)).count("1")
        while True:
            counts = np.unpackbits(self.upper[byte:byte + 64], bitorder="little")
            ones = np.flatnonzero(counts)
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                break
            left -= len(ones)
            byte += 64
        return ((place - i) << self.low_bits) | int(self._lows(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        head = struct.pack(PART, self.n, self.low_bits, len(self.lower), len(self.upper), len(self.directory))
        return head + self.lower.tobytes() + self.upper.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low, a, b, c = struct.unpack_from(PART, data)
        at = struct.calcsize(PART)
        return cls(n, low, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a),
                   np.frombuffer(data, "<u4", c, at + a + b))


def write(docs: DataFrame, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text",
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Ids of every whole text, each followed by ``end``, in files of ascending key.

    Returns (shard, file, n_docs, n_tokens), one row per file; files in the
    order of ``shard`` hold the rows in ascending key, missing keys first, rows
    of one key by a hash of the text. A file is the ids as little-endian numbers, then the
    ends of its documents and their keys, Elias-Fano coded, then a footer. Texts are range-sorted into files
    of about ``file_bytes`` of text each and encoded once, slice by slice, as they are written. A task holds one slice of texts and 16
    bytes per document of its file. Missing texts are empty, texts of any length are encoded whole, repeated rows each have their place,
    other columns are ignored, and an empty table gives no files."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tie"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(-(-total // file_bytes), 1)
    rows = rows.repartitionByRange(n, F.col("key").asc_nulls_first(), F.col("tie"))
    rows = rows.sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(tokenizer)
        wide = encoder.dtype.itemsize
        stream, uri, total, no_key = None, None, 0, 0
        ends, keys = [], []
        for part in (part for batch in batches for part in slices(batch, 1)):
            if stream is None:
                stream, uri = write_once(folder, f"shard-{TaskContext.get().partitionId():05d}")
                stream.write(MAGIC)
            ids, bounds = encoder.encode_all(part.column(1))
            stream.write(np.insert(ids, bounds[1:], np.array(end, encoder.dtype)).tobytes())
            sizes = np.diff(bounds) + 1
            ends.append(total + np.cumsum(sizes))
            total += int(sizes.sum())
            no_key += part.column(0).null_count
            keys.append(part.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64))
        if stream is None:
            return
        ends, keys = np.concatenate(ends), np.concatenate(keys)
        least = int(keys[0]) if len(keys) else 0
        bounds, ids = EliasFano.of(ends).to_bytes(), EliasFano.of(keys.astype(np.uint64) - np.uint64(least % 2**64)).to_bytes()
        stream.write(bounds + ids + struct.pack(FOOTER, wide, len(ends), no_key, least, total, len(bounds), len(ids)))
        stream.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([uri]),
             pa.array([len(ends)], pa.int64()), pa.array([total], pa.int64())],
            names=["shard", "file", "n_docs", "n_tokens"])

    return saved(rows.select("key", "text").mapInArrow(run, "shard long, file string, n_docs long, n_tokens long"), "token-manifest")


class TokenFile:
    """One file, opened for reading whole documents or single ones."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.stream = system.open_input_file(path)
        foot = self.stream.size() - struct.calcsize(FOOTER)
        self.wide, self.n, self.no_key, self.least, self.total, a, b = struct.unpack(
            FOOTER, self.stream.read_at(struct.calcsize(FOOTER), foot))
        at = foot - a - b
        self.ends = EliasFano.from_bytes(self.stream.read_at(a, at))
        self.keys = EliasFano.from_bytes(self.stream.read_at(b, at + a))

    def ids(self, start: int, stop: int) -> np.ndarray:
        data = self.stream.read_at((stop - start) * self.wide, len(MAGIC) + start * self.wide)
        return np.frombuffer(data, "<u2" if self.wide == 2 else "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def key(self, start: int, stop: int) -> list[int | None]:
        missing = [None] * max(min(stop, self.no_key) - start, 0)
        numbers = self.keys.run(max(start - self.no_key, 0), max(stop - self.no_key, 0)) + np.uint64(self.least % 2**64)
        return missing + numbers.astype(np.int64).tolist()

    def documents(self, at_once: int = 1 << 21) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start, ids) in file order. Boundaries are decoded in runs, and
        about ``at_once`` ids, or one document, are in memory."""
        before = 0
        for first in range(0, self.n, RUN):
            last = min(first + RUN, self.n)
            ends = self.ends.run(first, last).astype(np.int64)
            starts, keys, i = np.concatenate([[before], ends[:-1]]), self.key(first, last), 0
            while i < len(ends):
                j = max(int(np.searchsorted(ends, starts[i] + at_once, side="right")), i + 1)
                block, base = self.ids(int(starts[i]), int(ends[j - 1])), int(starts[i])
                for k in range(i, j):
                    yield keys[k], int(starts[k]), block[starts[k] - base:ends[k] - base]
                i = j
            before = int(ends[-1])


def read(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read back from its
    file; start counts the ids of all documents before it, over all files."""
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = ((doc, row["first"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                         for doc, start, ids in TokenFile(row["file"]).documents())
                while some := list(islice(found, RUN)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)],
                                                     names=["key", "start", "n_tokens", "ids_crc32"])

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    out = files.repartition(n, "shard").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)
