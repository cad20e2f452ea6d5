"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.columns import q
from sparkwright.session import checkpoint_dir, scratch_path, ship_package

__all__ = ["boxed", "prepared", "scratch_path", "text_bytes", "unboxed"]


# Texts per Arrow batch are bounded by bytes: a batch stands several times in a task's memory (growing, sent, read
# and as output), and the batches of long texts would else grow to 64 MB.  A bound set by the caller stays.
_BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def prepared(df: DataFrame) -> DataFrame:
    """``df``, with the shared checkpoint folder and the size of Arrow batches set and this package sent to the workers."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    ship_package(spark)
    return df


def boxed(docs: DataFrame) -> DataFrame:
    """Each row as one struct column ``row``, so that no name of its own meets an operator's."""
    return docs.select(F.struct(*[q(c) for c in docs.columns]).alias("row"))


def unboxed(rows: DataFrame, names: list[str], **changed) -> DataFrame:
    """The columns ``names`` of ``row``, some of them changed."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in names])


def text_bytes(value: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return value.encode("utf-8", "surrogatepass") if value else b""
