"""Order-dependent scans without a single-task window.

A window ``partitionBy(key).orderBy(o)`` puts a whole key (or, with no key,
the whole table) into one task.  Here rows are cut into *blocks* of bounded
size along the sort order ``(key, order)``; every block is scanned locally,
a per-(block, key) summary (count, first and last non-null value) is carried
across blocks with a window over the *summary* (at most one row per block
for a hot key), and the carry is joined back.  Exact, and it holds when one
key owns a third of all rows.

Blocks are Spark's own range partitions, cut once: a range shuffle samples its
bounds anew per execution, so the rows are checkpointed with their block number,
and every later use, and every recomputation after an executor loss, sees the same
blocks.  Their number follows the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.functions.columns import q
from sparkwright.session import cut_lineage

BLOCK_ROWS = 200_000        # rows of a block in a large table
LEAST_ROWS = 5_000          # no smaller blocks in a small one
MOST_BLOCKS = 100_000       # larger blocks beyond (their windows sort externally)
CUT_CHARS = 256             # characters of a text that bounds hold


def _n_blocks(df: DataFrame, n_blocks: int | None) -> int:
    if n_blocks:
        return n_blocks
    n = df.count()
    cores = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return min(max(-(-n // BLOCK_ROWS), min(cores, -(-n // LEAST_ROWS)), 1), MOST_BLOCKS)


def _group_key(keys) -> Column:
    # one non-null text key per group, so joins are plain name-based equi-joins
    return F.to_json(F.struct(*keys)) if keys else F.lit("")


def _cut_keys(df: DataFrame, sort_exprs: Sequence[Column]) -> list[Column]:
    """What bounds are made of: the sort expressions up to the first text, of which they hold the beginning.

    A text's beginning keeps its order, but nothing after it would, so rows that agree so far share a block.
    """
    kinds = [f.dataType for f in df.select(*[e.alias(f"f{i}") for i, e in enumerate(sort_exprs)]).schema.fields]
    out = []
    for e, kind in zip(sort_exprs, kinds):
        if isinstance(kind, T.StringType):
            return [*out, F.substring(e, 1, CUT_CHARS)]
        if not isinstance(kind, T.AtomicType):
            return [*out, e]
        out.append(e)
    return out


def assign_blocks(df: DataFrame, sort_exprs: Sequence[Column], n_blocks: int,
                  name: str = "__blk") -> DataFrame:
    """Add ``name``: the number of the contiguous range of ``sort_exprs`` order
    the row falls in (about ``n/n_blocks`` rows per block)."""
    if n_blocks <= 1:
        return df.withColumn(name, F.lit(0))
    keys = _cut_keys(df, sort_exprs)
    keyed = df.select("*", *[k.alias(f"__cut{i}") for i, k in enumerate(keys)])
    cuts = [f"__cut{i}" for i in range(len(keys))]
    return cut_lineage(keyed.repartitionByRange(n_blocks, *cuts).drop(*cuts).withColumn(name, F.spark_partition_id()))


def _blocked(df: DataFrame, order_by, partition_by, n_blocks):
    keys = [q(k) if isinstance(k, str) else k for k in partition_by]
    order = [q(o) if isinstance(o, str) else o for o in order_by]
    g = df.withColumn("__gk", _group_key(keys))
    # groups need to be contiguous only, so bounds hold a hash of the key; windows go by the key itself
    b = assign_blocks(g, [*([F.xxhash64("__gk")] if keys else []), *order], _n_blocks(df, n_blocks))
    return b, order


def neighbours(df: DataFrame, value: str, order_by: Sequence[str],
               partition_by: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Add ``__pos`` (0-based row position within the key), ``__prev`` and
    ``__next`` (structs ``pos, v`` of the nearest non-null ``value`` at or
    before / at or after the row, within the key)."""
    blk, order = _blocked(df, order_by, partition_by, n_blocks)
    wk = Window.partitionBy("__blk", "__gk").orderBy(*order)
    v = q(value)
    local = blk.withColumn("__lpos", F.row_number().over(wk) - 1)
    nn = F.when(v.isNotNull(), F.struct(F.col("__lpos").alias("pos"), v.alias("v")))
    local = local.withColumn(
        "__lprev", F.last(nn, ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(
        "__lnext", F.first(nn, ignorenulls=True).over(wk.rowsBetween(0, Window.unboundedFollowing)))
    summary = local.groupBy("__blk", "__gk").agg(
        F.count(F.lit(1)).alias("__cnt"), F.max(nn).alias("__last"), F.min(nn).alias("__first"))
    ws = Window.partitionBy("__gk").orderBy("__blk")
    summary = summary.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def glob(s):
        return F.when(F.col(s).isNotNull(), F.struct((F.col(s + ".pos") + F.col("__off")).alias("pos"),
                                                     F.col(s + ".v").alias("v")))
    summary = summary.withColumn("__glast", glob("__last")).withColumn("__gfirst", glob("__first"))
    summary = summary.withColumn(
        "__cprev", F.last("__glast", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn(
        "__cnext", F.first("__gfirst", ignorenulls=True).over(ws.rowsBetween(1, Window.unboundedFollowing))
    ).select("__blk", "__gk", "__off", "__cprev", "__cnext")
    j = local.join(summary, ["__blk", "__gk"], "left")
    return j.select(
        *[q(c) for c in df.columns],
        (F.col("__lpos") + F.col("__off")).alias("__pos"),
        F.coalesce(glob("__lprev"), F.col("__cprev")).alias("__prev"),
        F.coalesce(glob("__lnext"), F.col("__cnext")).alias("__next"))


def ffill(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
          n_blocks: int | None = None) -> DataFrame:
    """Forward fill: last non-null value at or before the row (leading nulls stay)."""
    n = neighbours(df, column, order_by, partition_by, n_blocks)
    return n.select(*[F.col("__prev.v").alias(c) if c == column else q(c) for c in df.columns])


def bfill(df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
          n_blocks: int | None = None) -> DataFrame:
    """Backward fill: first non-null value at or after the row (trailing nulls stay)."""
    n = neighbours(df, column, order_by, partition_by, n_blocks)
    return n.select(*[F.col("__next.v").alias(c) if c == column else q(c) for c in df.columns])


def interpolate_linear(df: DataFrame, column: str, order_by: Sequence[str],
                       partition_by: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Linear interpolation by row position, forward direction: leading nulls
    stay null, trailing nulls take the last value."""
    n = neighbours(df, column, order_by, partition_by, n_blocks)
    p, nx = F.col("__prev"), F.col("__next")
    pv, pp = p["v"].cast("double"), p["pos"].cast("double")
    nv, npos = nx["v"].cast("double"), nx["pos"].cast("double")
    pos = F.col("__pos").cast("double")
    val = (F.when(p.isNull(), F.lit(None).cast("double"))
           .when(nx.isNull(), pv)
           .when(npos == pp, pv)
           .otherwise(pv + (nv - pv) * (pos - pp) / (npos - pp)))
    return n.select(*[val.alias(c) if c == column else q(c) for c in df.columns])


def row_position(df: DataFrame, order_by: Sequence, partition_by: Sequence = (),
                 n_blocks: int | None = None, name: str = "__pos") -> DataFrame:
    """0-based position of each row within its partition key in ``order_by``
    order (``order_by`` must be unique within the key): local row numbers
    inside blocks plus per-(block, key) offsets."""
    blk, order = _blocked(df, order_by, partition_by, n_blocks)
    wk = Window.partitionBy("__blk", "__gk").orderBy(*order)
    local = blk.withColumn("__lpos", F.row_number().over(wk) - 1)
    sizes = local.groupBy("__blk", "__gk").agg(F.count(F.lit(1)).alias("__cnt"))
    ws = Window.partitionBy("__gk").orderBy("__blk")
    offs = sizes.withColumn("__off", F.coalesce(
        F.sum("__cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__cnt")
    j = local.join(offs, ["__blk", "__gk"], "left")
    return j.select(*[q(c) for c in df.columns], (F.col("__lpos") + F.col("__off")).alias(name))


def cumulative_sum(df: DataFrame, columns: Sequence[str], order_by: Sequence,
                   partition_by: Sequence = (), n_blocks: int | None = None,
                   prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``columns`` along ``order_by`` (unique within
    the key), blockwise like ``row_position``; adds ``<prefix><column>``."""
    blk, order = _blocked(df, order_by, partition_by, n_blocks)
    wk = Window.partitionBy("__blk", "__gk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blk.select("*", *[F.sum(q(c)).over(wk).alias(f"__l_{c}") for c in columns])
    sizes = local.groupBy("__blk", "__gk").agg(*[F.sum(q(c)).alias(f"__t_{c}") for c in columns])
    ws = Window.partitionBy("__gk").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__blk", "__gk", *[F.coalesce(F.sum(f"__t_{c}").over(ws), F.lit(0)).alias(f"__o_{c}")
                                            for c in columns])
    j = local.join(offs, ["__blk", "__gk"], "left")
    return j.select(*[q(c) for c in df.columns],
                    *[(F.col(f"__l_{c}") + F.col(f"__o_{c}")).alias(prefix + c) for c in columns])


def with_neighbour_rows(df: DataFrame, order_by: Sequence, partition_by: Sequence = (),
                        columns: Sequence[str] = (), n_blocks: int | None = None) -> DataFrame:
    """Attach the previous and next row's ``columns`` (as structs ``__prev_row``
    / ``__next_row``) by joining on row position - a distributed lag/lead."""
    pos = row_position(df, order_by, partition_by, n_blocks)
    keys = [k for k in partition_by]
    cols = list(columns)
    prev = pos.select(*[q(k).alias(k) for k in keys], (F.col("__pos") + 1).alias("__pos"),
                      F.struct(*[q(c) for c in cols]).alias("__prev_row"))
    nxt = pos.select(*[q(k).alias(k) for k in keys], (F.col("__pos") - 1).alias("__pos"),
                     F.struct(*[q(c) for c in cols]).alias("__next_row"))
    on = keys + ["__pos"]
    return pos.join(prev, on, "left").join(nxt, on, "left")
