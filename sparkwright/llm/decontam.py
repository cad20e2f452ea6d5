"""Operator 7: benchmark decontamination by word n-grams.

Texts are normalised to lower-cased words.  The n-grams of all benchmark items
are hashed into a sorted set that is broadcast; every window of every training
text is looked up there, and a hash hit counts only after its words have been
compared.  Hit spans, or whole documents, can then be removed.

Scale: one scan of the documents without a shuffle.  A broadcast set holds at
most ``BLOCK_BYTES`` of item text; a larger benchmark is cut into blocks, each
scanned against all documents, and the hits are merged per document row (rows
are numbered and checkpointed first, so null and repeated ids stay apart).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.llm.common import boxed, prepared, scratch_path, text_bytes

BLOCK_BYTES = 32 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# A-Z to lower case, and every byte that is in no word to a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32
              for b in range(256))

HITS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()),
])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SETS: dict[str, GramSet] = {}


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text; null has none."""
    return text_bytes(text).translate(_FOLD).split()


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def _windows(codes: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` words."""
    m = len(codes) - n + 1
    total = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(n if m > 0 else 0):
        total = total * _MIX + codes[k:k + m]
    return total


class GramSet:
    """The n-grams of some benchmark items, looked up by hash and verified by their words.

    The items' words stand once in one byte buffer; a gram is a hash, the number of its first word and the numbers of
    its items, in flat arrays (about six bytes per character of the items altogether).
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        text, places, first = bytearray(), [], 0          # a place per word, and one behind each item's last
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for item_id, value in items:
            words = words_of(value)
            if not words:
                continue
            ends = np.cumsum([len(w) + 1 for w in words])
            places.append(np.concatenate([[0], ends]) + len(text))
            text += b" ".join(words) + b" "
            size = min(n, len(words))
            hashes = _windows(_codes(words), size)
            found.setdefault(size, []).append((hashes, np.arange(len(hashes)) + first,
                                               np.full(len(hashes), number[item_id], dtype=np.int32)))
            first += len(words) + 1
        self.text = bytes(text)
        kind = np.uint32 if len(text) < 2 ** 32 else np.int64
        self.places = np.concatenate(places).astype(kind) if places else np.zeros(0, dtype=kind)
        self.by_size = {size: self._table(size, *map(np.concatenate, zip(*parts))) for size, parts in sorted(found.items())}

    def _words(self, at: int, size: int) -> bytes:
        return self.text[self.places[at]:self.places[at + size] - 1]

    def _table(self, size: int, hashes: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted hashes of the different grams, a place of each, and their items (``items[cut[k]:cut[k + 1]]``)."""
        order = np.lexsort((at, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        lengths = np.diff(np.append(starts, len(hashes)))
        group = np.repeat(np.arange(len(starts)), lengths)
        for k in np.flatnonzero(lengths > 1):              # equal hashes: the words decide
            run = slice(starts[k], starts[k] + lengths[k])
            words = [self._words(int(a), size) for a in at[run]]
            if len(set(words)) > 1:
                ranks = {w: r for r, w in enumerate(dict.fromkeys(words))}
                sub = np.argsort([ranks[w] for w in words], kind="stable")
                at[run], item[run] = at[run][sub], item[run][sub]
                split = np.sort([ranks[w] for w in words])
                group[run] = -(k + 1) * len(hashes) - split
        # one entry per (gram, item): grams keep the order of their hashes
        new = np.append(True, group[1:] != group[:-1])
        gram = np.cumsum(new) - 1
        pairs = np.unique(gram.astype(np.int64) * len(self.names) + item)
        cut = np.searchsorted(pairs // len(self.names), np.arange(int(gram[-1]) + 2))
        return hashes[new], at[new].astype(np.uint32 if len(self.places) < 2 ** 32 else np.int64), \
            cut.astype(np.uint32), (pairs % len(self.names)).astype(np.int32)

    def nbytes(self) -> int:
        return len(self.text) + self.places.nbytes + sum(a.nbytes for t in self.by_size.values() for a in t)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word spans of all verified windows, and the items they come from."""
        spans, items = [], set()
        codes = _codes(words)
        for size, (hashes, at, cut, own) in self.by_size.items():
            seen = _windows(codes, size)
            if not len(seen):
                continue
            place = np.searchsorted(hashes, seen)
            for k in np.flatnonzero(hashes[np.minimum(place, len(hashes) - 1)] == seen).tolist():
                gram, j = b" ".join(words[k:k + size]), int(place[k])
                while j < len(hashes) and hashes[j] == seen[k]:
                    if self._words(int(at[j]), size) == gram:
                        spans.append((k, k + size))
                        items.update(own[cut[j]:cut[j + 1]].tolist())
                        break
                    j += 1
        return spans, {self.names[k] for k in items}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of these spans and what stands between them."""
    if not spans or text is None:
        return text
    raw, keep, done, k = text_bytes(text), [], 0, 0
    places = [m.span() for m in WORD.finditer(raw)]
    for a, b in spans:
        keep.append(raw[done:places[a][0]])
        done = places[b - 1][1]
    keep.append(raw[done:])
    return b"".join(keep).decode("utf-8", "surrogatepass")


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most ``block_bytes`` of text (one longer item has a list of its own)."""
    block, held = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")) \
            .where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        size = len(row["t"]) * 2
        if block and held + size > block_bytes:
            yield block
            block, held = [], 0
        block.append((row["i"], row["t"]))
        held += size
    if block:
        yield block


def _scan(docs: DataFrame, items: list[tuple[str, str]], n: int, clean: bool) -> tuple[DataFrame, Broadcast]:
    """Hits of one block, and the broadcast that the scan reads."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SETS:  # once per Python worker, and only the latest one stays
            _SETS.clear()
            _SETS[key] = GramSet(shared.value, n)
        grams = _SETS[key]
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                words = words_of(text)
                spans, found = grams.hits(words)
                spans = _merged(spans)
                out.append((doc_id, len(words), [a for a, _ in spans], [b for _, b in spans], sorted(found),
                            _without(text, spans) if clean else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 6, [
                    pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()),
                    pa.string()])], names=HITS.names)

    return docs.mapInArrow(rows, HITS), shared


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", n: int = 10,
               block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Windows of ``n`` benchmark words in whole texts; one row per document row.

    Columns: doc_id, n_words, n_hit (words inside hit windows), starts and ends
    (disjoint word spans), items (ids whose windows occur, sorted), n_items,
    items_sha256, contaminated and, with ``clean``, the text without the spans.

    An item with fewer than ``n`` words is one window; items without words, a
    null item id or a null text give none, repeated items count once.  A null or
    empty text has no words; null ids and repeated rows are kept as they are; an
    empty benchmark hits nothing; other columns are ignored.
    """
    own = prepared(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = list(islice(blocks, 2))
    if len(first) < 2:
        hits, _ = _scan(own, first[0] if first else [], n, clean)
    else:
        own, found = _row_hits(own, "text", chain(first, blocks), n)
        text = _cut("text", "starts", "ends") if clean else F.lit(None).cast("string")
        hits = own.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).join(found, "rid") \
            .select("doc_id", "n_words", "starts", "ends", "items", text.alias("text"))
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return hits.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
        "starts", "ends", "items", "text")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", n: int = 10, most: float = 0.5,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without benchmark spans, all other columns as they are.

    A row with more than ``most`` of its words inside hit windows goes; from the
    others the spans are cut out.  Rows are judged one by one whatever their
    ``id_col`` holds.  Null and empty texts stay as they are, and an empty table or
    benchmark changes nothing.
    """
    at = docs.columns.index(text_col)
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first = list(islice(blocks, 2))
    if len(first) > 1:
        rows_in, found = _row_hits(prepared(docs), text_col, chain(first, blocks), n)
        docs_in, shared = rows_in.join(found, "rid").select("row", "starts", "ends"), None
    else:
        docs_in, shared = prepared(docs), docs.sparkSession.sparkContext.broadcast(first[0] if first else [])
    key, names = uuid.uuid4().hex, docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None and key not in _SETS:
            _SETS.clear()
            _SETS[key] = GramSet(shared.value, n)
        for batch in batches:
            columns = list(batch.columns) if shared is not None else batch.column(0).flatten()
            keep, texts = [], []
            for k, value in enumerate(columns[at]):
                text = value.as_py()
                words = words_of(text)
                spans = _merged(_SETS[key].hits(words)[0]) if shared is not None else \
                    list(zip(batch.column(1)[k].as_py(), batch.column(2)[k].as_py()))
                keep.append(sum(b - a for a, b in spans) <= most * len(words))
                texts.append(_without(text, spans))
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return docs_in.mapInArrow(rows, docs.schema)


def _row_hits(docs: DataFrame, text_col: str, blocks: Iterable[list[tuple[str, str]]],
              n: int) -> tuple[DataFrame, DataFrame]:
    """Rows as structs with a number ``rid``, fixed by a checkpoint, and the hits of all blocks per number.

    A block's hits are written before the next block is read, so one block at a time is on the driver and the workers.
    """
    spark = docs.sparkSession
    rows = boxed(docs).withColumn("rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    own = rows.select(F.col("rid").alias("doc_id"), F.col("row").getField(text_col).cast("string").alias("text"))
    path = scratch_path(spark, "block-hits")
    for items in blocks:
        hits, shared = _scan(own, items, n, False)
        hits.write.mode("append").parquet(path)
        shared.unpersist()
    merged = _merged_hits(spark.read.schema(HITS).parquet(path))
    return rows, merged.select(F.col("doc_id").alias("rid"), "n_words", "starts", "ends", "items")


def _cut(text: str, starts: str, ends: str) -> Column:
    """The text without its hit spans."""
    @F.pandas_udf("string")
    def cut(texts, a, b):
        import pandas as pd
        return pd.Series([_without(t, list(zip(s, e))) for t, s, e in zip(texts, a, b)], dtype=object)

    return cut(text, starts, ends)


def _merged_hits(hits: DataFrame) -> DataFrame:
    """Hits of several blocks, merged per row."""
    @F.pandas_udf("struct<starts:array<long>,ends:array<long>>")
    def merge(starts, ends):
        import pandas as pd
        merged = [_merged(list(zip(chain.from_iterable(s), chain.from_iterable(e)))) for s, e in zip(starts, ends)]
        return pd.DataFrame({"starts": [[a for a, _ in m] for m in merged], "ends": [[b for _, b in m] for m in merged]})

    return hits.groupBy("doc_id") \
        .agg(F.max("n_words").alias("n_words"), F.collect_list("starts").alias("s"), F.collect_list("ends").alias("e"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")) \
        .withColumn("m", merge("s", "e")) \
        .select("doc_id", "n_words", "m.starts", "m.ends", "items", F.lit(None).cast("string").alias("text"))
