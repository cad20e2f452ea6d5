"""Operator 6: SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint keeps 64 majority bits over the XXH64 hashes of a text's word
shingles.  To find all pairs of fingerprints that differ in at most ``radius``
bits, bit ``i`` gets a non-zero vector of ``radius + 1`` bits, and there is one
table per non-zero vector ``v``: its mask holds the bits whose vector has an
odd overlap with ``v``.  Any ``radius`` differing bits give ``radius`` linear
conditions on ``radius + 1`` unknowns, so some ``v`` masks all of them out, and
the pair meets in that table: no pair within the radius is missed.

Scale: the texts are read once and never shuffled.  Equal fingerprints become
one class before anything is joined, so a group of copies is one row.  Buckets
of one class are dropped by a partial count; in the others only a spanning set
of links leaves the task (each class to the smallest one it reaches there).
Buckets of more than ``BUCKET`` classes are not gathered: their classes look up
every fingerprint within the radius in an equi-join, which is exact and linear.
Components are found by alternating star rounds, each cut by a checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.common import boxed, prepared, text_bytes, unboxed

BITS = 64
SEED = 42
BUCKET = 4096                 # classes of a bucket that one task compares by itself
BROADCAST_IDS = 100_000       # numbers that are broadcast; more are joined by a shuffle
DENSE = 256                   # up to so many are compared pair by pair
_CHUNK = 1 << 16

FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 without words."""
    words = text_bytes(text).lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64, count=n).astype(">u8").view(np.uint8)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _CHUNK):
        set_bits += np.unpackbits(hashes[8 * k:8 * (k + _CHUNK)].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long, per document row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))],
                                             names=FINGERPRINTS.names)

    return prepared(docs).select(docs[id_col].cast("long").alias("doc_id"),
                                 docs[text_col].cast("string").alias("text")).mapInArrow(rows, FINGERPRINTS)


def covering_masks(radius: int) -> list[int]:
    """The bit masks of the tables: one for each non-zero vector of ``radius + 1`` bits."""
    vectors = range(1, 1 << (radius + 1))
    return [sum(1 << i for i in range(BITS) if ((1 + i % len(vectors)) & v).bit_count() & 1) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, radius: int) -> list[int]:
    """All patterns of one to ``radius`` bits outside ``mask``."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [sum(c) for k in range(1, radius + 1) for c in combinations(free, k)]


def _bucket_links(values: np.ndarray, flips: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (value, smallest value it reaches) among the sorted values of one bucket."""
    n = len(values)
    if n <= DENSE:
        i, j = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius, 1))
    else:
        left, right = [], []
        for flip in flips:
            other = values ^ flip
            at = np.minimum(np.searchsorted(values, other), n - 1)
            hit = np.flatnonzero((values[at] == other) & (at > np.arange(n)))
            left.append(hit)
            right.append(at[hit])
        i, j = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(n))
    return values[own], values[root[own]]


def links(classes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints of column ``fp`` within ``radius`` bits."""
    masks = covering_masks(radius)
    tables = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for k, m in enumerate(masks)])).alias("t")).select("t.tab", "t.key", "fp")
    sizes = tables.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = tables.join(sizes, ["tab", "key"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {k: np.array(_flips(m, radius), dtype=np.uint64) for k, m in enumerate(masks)}
        held_key, held = None, []

        def close() -> pa.RecordBatch | None:
            values = np.sort(np.array(held, dtype=np.int64).view(np.uint64))
            a, b = _bucket_links(values, flips[held_key[0]], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                              names=LINKS.names) if len(a) else None

        for batch in batches:
            for tab, key, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (tab, key) != held_key:
                    if held and (out := close()):
                        yield out
                    held_key, held = (tab, key), []
                held.append(fp)
        if held and (out := close()):
            yield out

    near = shared.where(F.col("n") <= bucket).select("tab", "key", "fp") \
        .repartition("tab", "key").sortWithinPartitions("tab", "key").mapInArrow(rows, LINKS)
    # a bucket too large for one task: each of its fingerprints names all others within the radius that share the bucket
    wide = shared.where(F.col("n") > bucket)
    flips = F.element_at(F.array(*[F.array(*[F.lit(_signed(x)) for x in _flips(m, radius)]) for m in masks]),
                         F.col("tab") + 1)
    named = wide.select(F.col("fp").alias("a"), F.explode(flips).alias("flip")) \
        .select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("b")).where("a > b")
    return near.unionByName(named.join(classes.select(F.col("fp").alias("b")), "b").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links: columns ``node`` and ``root`` (the smallest node of its component)."""
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b") \
        .distinct().checkpoint(eager=True)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        # each node hands its smallest known node to its larger neighbours ...
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        # ... and then to its smaller ones
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint(eager=True)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Per document row: doc_id, fingerprint (16 hex digits), component_id and group.

    Fingerprints link at ``radius`` or fewer differing bits; ``component_id`` is
    the smallest doc_id reachable over links, the own one included; ``group`` is
    the component's smallest fingerprint, as signed numbers go.

    A null or empty text (no words) has fingerprint zero and links like any
    other; fewer words than ``shingle`` make one shingle.  Repeated rows appear as
    often as they occur; a null id joins a component without naming it (null if
    it holds no other id).  An empty table gives no rows; other columns are ignored.
    """
    own = fingerprints(docs, id_col, text_col, shingle).checkpoint(eager=True)
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint(eager=True)
    joined = components(links(classes, radius, bucket))
    roots = classes.join(joined, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(names, "root").select("fp", "root", "component_id")
    return own.join(named, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id",
                                        _hex("root").alias("group"))


def _hex(name: str) -> F.Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             radius: int = 2) -> DataFrame:
    """One row of each group of near duplicates, all columns as they are: the one with the smallest id.

    Null ids count as larger than all others.  Of several rows with the smallest id, those with the smallest
    fingerprint come first and the smallest text hash decides, so exactly one row of a group stays, also where one
    id stands for several texts or rows are repeated.  Null and empty texts are one group (with all texts near
    them); an empty table gives no rows.
    """
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius) \
        .checkpoint(eager=True)
    lead = judged.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fingerprint")).alias("l")) \
        .select("group", F.col("l.doc_id").alias("id"), F.col("l.fingerprint").alias("fp"))
    often = judged.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    # most ids stand for one row, and the id alone names it
    own = boxed(docs).withColumn("id", F.col("row").getField(id_col).cast("long"))
    sole = own.join(lead.where("id IS NOT NULL").join(often, "id", "left_anti").select("id"), "id", "left_semi")
    # rows without an id, or with one that stands more than once, are told apart by their fingerprints
    unsure = lead.where("id IS NULL").unionByName(lead.join(often, "id", "left_semi").select(*lead.columns)) \
        .withColumnRenamed("id", "lead_id").checkpoint(eager=True)
    n = unsure.count()
    if not n:
        return unboxed(sole, docs.columns)
    ids = unsure.select("lead_id").distinct()
    rest = own.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("id").eqNullSafe(F.col("lead_id")), "left_semi") \
        .select("id", "row", F.col("row").getField(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [f"{fingerprint(t.as_py(), shingle):016x}" for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.string())], names=["id", "row", "fp"])

    schema = T.StructType([rest.schema["id"], rest.schema["row"], T.StructField("fp", T.StringType())])
    told = rest.mapInArrow(rows, schema).withColumnRenamed("fp", "own_fp")
    chosen = told.join(unsure, F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("own_fp") == F.col("fp"))) \
        .groupBy("group").agg(F.min_by("row", F.struct(F.xxhash64(F.col("row").getField(text_col)),
                                                       F.col("row").getField(text_col)))
                              .alias("row"))
    return unboxed(sole.select("row").unionByName(chosen.select("row")), docs.columns)
