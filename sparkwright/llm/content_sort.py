"""Operator 13: exact duplicates by sorting contents.

Texts are normalised (each run of white space becomes one space) and compared as
bytes.  Sampled splitters range-partition them, Spark's external sort orders every
partition, equal texts become neighbours, and neighbours are compared byte by byte.
The smallest identifier of a run of equal texts stays.

The order is (first bytes, hash of all bytes, all bytes, identifier).  Splitters hold
the first bytes, the hash and the identifier only, so the sample that the driver
sees has short keys however long the texts are, and many texts with one beginning
can still be split.  The identifier and the input partition's number come last in
the splitters: a group of copies of any size is cut over as many partitions as its
share of the rows asks for.  A run that touches a partition's edge is joined with
equal ones at other edges (two rows per partition, compared by their whole bytes).

Scale: whole texts are shuffled once.  The sorted pass holds one batch and the text
before it; it writes numbers, digests and the texts at the edges.  After it, only
numbers are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import prepared, scratch_path

HEAD_BYTES = 64                # bytes of a text that splitters hold
PARTITION_BYTES = 16 << 20     # input bytes per sorted partition, as long as there are
MOST_PARTITIONS = 1 << 17      # no more partitions than these; larger ones are sorted externally all the same
WHITE = r"[\x20\x09-\x0D]+"
FIELDS = ["id", "row", "digest", "part", "run", "first", "size", "edge"]


def normalised(text: Column) -> Column:
    """Bytes of a text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ").cast("binary")


def _partitions(docs: DataFrame) -> int:
    """Sorted partitions for the optimizer's size estimate of the input."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = docs.sparkSession.sparkContext.defaultParallelism
    return min(max(least, -(-estimate // PARTITION_BYTES)), MOST_PARTITIONS)


def sorted_runs(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text",
                carry: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Sort the rows by content, mark the runs of equal texts, and write both to ``path``.

    Rows have (id, row, digest, part, run, first): ``row`` holds the carried columns,
    ``first`` marks the first row of a run in its partition.  Runs have (id, part, run,
    size) and, at an edge of the partition, their text as ``edge``; inner runs of a
    single row are left out.
    """
    own = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"),
                      (F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")).alias("row")) \
        .withColumns({"head": F.substring("norm", 1, HEAD_BYTES), "hash": F.xxhash64("norm"),
                      "tie": F.spark_partition_id()})
    ids_last = F.asc_nulls_last("id")
    placed = own.repartitionByRange(partitions or _partitions(docs), "head", "hash", ids_last, "tie") \
        .sortWithinPartitions("head", "hash", "norm", ids_last).select("id", "norm", "row")
    kinds = {c: placed.schema[c].dataType.simpleString() for c in ("id", "row")}
    schema = (f"id {kinds['id']}, row {kinds['row']}, digest binary, part int, run long, first boolean, size long, "
              "edge binary")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        zero = last = lead = digest = None    # texts of the first run and of the row before; first id and digest of its run
        run, size = -1, 0
        types = None

        def ended(runs: list, sizes: list, leads: list, edges: list) -> pa.RecordBatch:
            n = len(runs)
            return pa.RecordBatch.from_arrays([
                pa.array(leads, types[0]), pa.nulls(n, types[1]), pa.nulls(n, pa.binary()), pa.array([part] * n, pa.int32()),
                pa.array(runs, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(sizes, pa.int64()),
                pa.array(edges, pa.binary())], names=FIELDS)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, texts, rows = batch.columns
            types = types or (ids.type, rows.type)
            new = np.ones(n, dtype=bool)      # rows whose text differs from the one before
            if last is None:
                zero = texts[0].as_py()
            else:
                new[0] = texts[0].as_py() != last
            if n > 1:
                new[1:] = ~np.asarray(pc.equal(texts.slice(1), texts.slice(0, n - 1)))
            starts = np.flatnonzero(new)
            runs = run + np.cumsum(new)
            digests = [hashlib.sha256(texts[int(at)].as_buffer()).digest() for at in starts]
            named = digests if new[0] else [digest, *digests]
            yield pa.RecordBatch.from_arrays([
                ids, rows, pa.array(named, pa.binary()).take(pa.array(np.cumsum(new) - int(new[0]))),
                pa.array(np.full(n, part, dtype=np.int32)), pa.array(runs), pa.array(new), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.binary())], names=FIELDS)
            size += int(starts[0]) if len(starts) else n
            if len(starts):                   # the run before ends here, and all that begin here but the last
                done = [(run, size, lead)] if run >= 0 else []
                done += zip(runs[starts[:-1]].tolist(), np.diff(starts).tolist(), ids.take(pa.array(starts[:-1])).to_pylist())
                done = [d for d in done if d[1] > 1 or d[0] == 0]
                if done:
                    yield ended(*map(list, zip(*done)), [zero if d[0] == 0 else None for d in done])
                run, size, lead, digest = int(runs[-1]), n - int(starts[-1]), ids[int(starts[-1])].as_py(), digests[-1]
            last = texts[n - 1].as_py()
        if run >= 0:
            yield ended([run], [size], [lead], [last])

    placed.mapInArrow(mark, schema).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (),
                 partitions: int | None = None) -> DataFrame:
    """Groups of equal normalised texts, one row per input row: doc_id, keep_id, group_size, kept, text_sha256
    and the carried columns in the struct ``row``.

    The row with the smallest id of a group stays; of several rows with that id, one
    does.  Null ids count as larger than all others: a group of them alone has a null
    ``keep_id`` and keeps one row.  A null text equals an empty one; white space at
    the ends becomes a space and stays.  Repeated rows are members of their group.
    An empty table gives no rows; other columns are ignored.
    """
    spark = prepared(docs).sparkSession
    found = sorted_runs(docs, scratch_path(spark, "content-sort"), id_col=id_col, text_col=text_col, carry=carry,
                        partitions=partitions)
    runs = found.where("size IS NOT NULL")
    # at most two rows per partition; equal texts at several edges are one run
    joined = runs.where("edge IS NOT NULL").groupBy("edge").agg(
        F.sum("size").alias("total"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "part")).alias("lead"),
        F.collect_list(F.struct("part", "run")).alias("pieces")).where("size(pieces) > 1") \
        .select("total", "lead", F.inline("pieces"))
    sizes = runs.select("part", "run", "size", "id").join(joined, ["part", "run"], "left").select(
        "part", "run", F.coalesce("total", "size").alias("size"),
        F.coalesce("lead", F.struct(F.col("id").isNull().alias("none"), "id", "part")).alias("lead"))
    rows = found.where("size IS NULL").select("id", "row", "digest", "part", "run", "first")
    out = rows.join(sizes, ["part", "run"], "left").select(
        F.col("id").alias("doc_id"), F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("lead.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("first") & (F.col("size").isNull() | (F.col("lead.part") == F.col("part")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "row")
    return out if carry else out.drop("row")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose normalised text another row keeps; all columns as they were."""
    return exact_groups(docs, carry=docs.columns, **options).where("kept").select("row.*")
