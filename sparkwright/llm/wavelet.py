"""Operator 5: token ids in wavelet-matrix shards.

A wavelet matrix keeps a sequence of ids as one bit-plane per bit of the
largest id.  Each plane is stored with counts of its ones per block, so that
one compressed file answers access (the id at a place), rank (how often an id
occurs before a place), select (the place of its k-th occurrence) and count.

Scale: documents are range-partitioned by id and sorted inside partitions, and
every task cuts its ids into shards of about ``SHARD_TOKENS`` (a longer
document has a shard of its own).  A shard is one row with one binary file
image; Spark's own writer commits them, so a lost executor costs a rerun task.
Only one total per partition is gathered to number the ids over all shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.common import prepared, scratch_path
from sparkwright.llm.tokens import tokenizer, tokenizer_path

SHARD_TOKENS = 1 << 20
BLOCK = 1024                  # bits per stored count of ones
MAGIC = b"WVM1"

SHARD_SCHEMA = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
    T.StructField("base", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_lengths", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType()),
])
DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


class WaveletMatrix:
    """Bit-planes of a sequence, highest bit first; each plane orders the next one: zeros, then ones."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ones: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ones = n, planes, zeros, ones

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length())
        level = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, ones = [], [], []
        for shift in range(bits - 1, -1, -1):
            bit = (level & level.dtype.type(1 << shift)) != 0
            plane = np.packbits(bit)
            planes.append(plane)
            low, high = np.flatnonzero(~bit), np.flatnonzero(bit)
            zeros.append(len(low))
            level = np.concatenate([level.take(low), level.take(high)])
            per_block = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8)) \
                if len(plane) else np.zeros(0)
            ones.append(np.concatenate([[0], np.cumsum(per_block, dtype=np.int64)]).astype(np.uint32))
        return cls(len(ids), planes, zeros, ones)

    # -- file image -------------------------------------------------------
    def to_bytes(self) -> bytes:
        body = b"".join([struct.pack("<Q", z) + p.tobytes() + o.astype("<u4").tobytes()
                         for z, p, o in zip(self.zeros, self.planes, self.ones)])
        return MAGIC + struct.pack("<QI", self.n, len(self.planes)) + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet matrix image")
        n, bits = struct.unpack_from("<QI", image, 4)
        body = zstandard.ZstdDecompressor().decompress(image[16:])
        size, blocks = (n + 7) // 8, -(-((n + 7) // 8) // (BLOCK // 8)) + 1
        planes, zeros, ones, at = [], [], [], 0
        for _ in range(bits):
            zeros.append(struct.unpack_from("<Q", body, at)[0])
            planes.append(np.frombuffer(body, np.uint8, size, at + 8))
            ones.append(np.frombuffer(body, "<u4", blocks, at + 8 + size))
            at += 8 + size + 4 * blocks
        return cls(n, planes, zeros, ones)

    # -- queries ----------------------------------------------------------
    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block, plane = i // BLOCK, self.planes[level]
        first = block * BLOCK // 8
        total = int(self.ones[level][block]) + int(np.bitwise_count(plane[first:i >> 3]).sum())
        return total + ((int(plane[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else 0)

    def _place(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this value in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            seen = self._ones(level, mid + 1)
            if (seen if bit else mid + 1 - seen) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit, before = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + before if bit else i - before
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where occurrences of ``value`` before ``end`` lie below the last plane."""
        lo, hi = 0, end
        for level in range(len(self.planes)):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, end: int) -> int:
        """How often ``value`` occurs before place ``end``."""
        if value >> len(self.planes):
            return 0
        lo, hi = self._range(value, min(end, self.n))
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of ``value``; -1 if there is none."""
        if k < 0 or k >= self.count(value):
            return -1
        i = self._range(value, self.n)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - level) & 1
            i = self._place(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """The whole sequence, from the last plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        value = np.zeros(self.n, dtype=kind)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty(self.n, dtype=kind)
            z = self.zeros[level]
            above[np.flatnonzero(~bit)] = value[:z]
            above[np.flatnonzero(bit)] = value[z:] | kind(1 << (bits - 1 - level))
            value = above
        return value


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer_file: str | None = None, end_id: int = 2,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Tokenize whole texts, append ``end_id`` to each and write wavelet-matrix shards to ``path``.

    Documents stand in ascending id order over all shards (null ids first;
    rows with the same id in the order of their texts).  A null or empty text is
    one ``end_id``; an empty table writes no shards; other columns are ignored.
    """
    file = tokenizer_file or tokenizer_path()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(file).encode_batch
        part, shard, base, held = TaskContext.get().partitionId(), 0, 0, 0
        ids, names = [], []

        def image() -> pa.RecordBatch:
            payload = WaveletMatrix.build(np.concatenate(ids)).to_bytes()
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([base], pa.int64()),
                pa.array([held], pa.int64()), pa.array([names], pa.list_(pa.int64())),
                pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], names=SHARD_SCHEMA.names)

        for batch in batches:
            found, counts = encode(batch.column(1))
            ends = np.cumsum(counts)
            found = np.insert(found, ends, end_id)
            ends += np.arange(1, len(ends) + 1)
            for doc_id, one in zip(batch.column(0).to_pylist(), np.split(found, ends[:-1])):
                if held and held + len(one) > shard_tokens:
                    yield image()
                    shard, base, held, ids, names = shard + 1, base + held, 0, [], []
                ids.append(one)
                names.append(doc_id)
                held += len(one)
        if held:
            yield image()

    prepared(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text") \
        .mapInArrow(shards, SHARD_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decode the shards at ``path``: per document its id, the number of ids before it over
    all shards, its number of ids and their crc32 (as little-endian uint32)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one total per written partition, so this frame is bounded by the partition count
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix.from_bytes(row["payload"]).decode().astype("<u4")
                lengths = np.array(row["doc_lengths"], dtype=np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts + (row["before"] + row["base"]), pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64()),
                ], names=DOC_SCHEMA.names)

    return prepared(shards).join(F.broadcast(before), "part") \
        .select("before", "base", "doc_ids", "doc_lengths", "payload").mapInArrow(documents, DOC_SCHEMA)


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the shards of ``docs`` to a new shared folder and read its documents back."""
    spark = prepared(docs).sparkSession
    path = scratch_path(spark, "wavelet")
    write_shards(docs, path, **options)
    return read_documents(spark, path)


COUNT_SCHEMA = "part int, shard int, n_found long"
PLACE_SCHEMA = "part int, shard int, doc_id long, offset long"
PLACES = 1 << 16              # places per batch of answers


def count_token(spark: SparkSession, path: str, token_id: int) -> DataFrame:
    """How often each shard at ``path`` holds an id (two ranks, nothing is decoded): part, shard, n_found.

    A shard without the id has a row with 0; no shards give no rows.
    """
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [WaveletMatrix.from_bytes(image.as_py()).count(token_id) for image in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("shard"), pa.array(found, pa.int64())],
                                             names=["part", "shard", "n_found"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return prepared(shards).select("part", "shard", "payload").mapInArrow(counts, COUNT_SCHEMA)


def locate_token(spark: SparkSession, path: str, token_id: int) -> DataFrame:
    """Every occurrence of an id, found by select: part, shard, doc_id and the place in that document (from 0).

    Rows of a document with a null id keep the null; an id that never occurs gives no rows.
    """
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["payload"])
                ends = np.cumsum(np.array(row["doc_lengths"], dtype=np.int64))
                found = matrix.count(token_id)
                for a in range(0, found, PLACES):
                    at = np.array([matrix.select(token_id, k) for k in range(a, min(a + PLACES, found))], dtype=np.int64)
                    doc = np.searchsorted(ends, at, side="right")
                    begin = ends[doc] - np.array(row["doc_lengths"], dtype=np.int64)[doc]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([row["part"]] * len(at), pa.int32()), pa.array([row["shard"]] * len(at), pa.int32()),
                        pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(at - begin, pa.int64()),
                    ], names=["part", "shard", "doc_id", "offset"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    return prepared(shards).select("part", "shard", "doc_ids", "doc_lengths", "payload").mapInArrow(places, PLACE_SCHEMA)
