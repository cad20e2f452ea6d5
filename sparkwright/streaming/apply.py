"""Apply a fitted preparation recipe to a stream (J5 on Structured Streaming).

The recipe's steps are projections with frozen statistics and stream-static
left joins to small dictionary frames, all of which Structured Streaming
supports without state.  Output goes to a file sink whose checkpoint lives
in the shared ``spark.checkpoint.dir`` folder, so a restarted query resumes
exactly once.

A step that runs jobs of its own (a k-NN search) cannot stand in a streaming
plan.  Recipes with such steps are replayed micro-batch by micro-batch, and a
batch writes its own folder, named by its number, in overwriting mode: a batch
that is delivered again replaces what it wrote before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.columns import q
from sparkwright.plans.prep import Prepared
from sparkwright.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, file_glob: str | None = None) -> DataFrame:
    """File stream over a directory (``file_glob`` keeps only matching files)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def prepare_stream(stream: DataFrame, prepared: Prepared, require: Sequence[str] = (),
                   pre: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``pre`` (optional projection) -> drop rows missing a ``require`` column
    (the batch flow's row filter) -> replay the fitted steps."""
    df = pre(stream) if pre else stream
    if require:
        cond = F.lit(True)
        for c in require:
            cond = cond & q(c).isNotNull()
        df = df.where(cond)
    return prepared.apply(df)


def replay_to_files(stream: DataFrame, prepared: Prepared, require: Sequence[str] = (),
                    pre: Callable[[DataFrame], DataFrame] | None = None, out_dir: str | None = None) -> str:
    """Replay any recipe on what the stream holds now and write it to Parquet files; returns their folder."""
    if not prepared.runs_jobs:
        return run_to_files(prepare_stream(stream, prepared, require, pre), out_dir)
    base = checkpoint_dir(stream.sparkSession).rstrip("/")
    tag = uuid.uuid4().hex
    out_dir = out_dir or f"{base}/stream-out-{tag}"

    def write(batch: DataFrame, number: int) -> None:
        prepare_stream(batch, prepared, require, pre).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/stream-ckpt-{tag}") \
        .trigger(availableNow=True).start()
    query.awaitTermination()
    return out_dir


def run_to_files(prepared_stream: DataFrame, out_dir: str | None = None, fmt: str = "parquet",
                 available_now: bool = True) -> str:
    """Write the prepared stream to files (checkpoint in the shared folder);
    with ``available_now`` the query processes what is there and stops."""
    spark = prepared_stream.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    tag = uuid.uuid4().hex
    out_dir = out_dir or f"{base}/stream-out-{tag}"
    w = (prepared_stream.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", f"{base}/stream-ckpt-{tag}").option("path", out_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    query = w.start()
    if available_now:
        query.awaitTermination()
    return out_dir
