"""Operator 4: token counts as delta-maintained rollups.

Changes arrive in batches: inserted documents, deleted ones and revised counts.
A batch is reduced to signed sums per (source, lang, tokenizer) and written as
one folder named after the batch.  The folder appears by the writer's commit, so
a batch is either there or not; a batch that is there already is not counted
again, whatever it holds.  Totals are the sums over the committed batches.
``compact`` replaces committed batches by one snapshot that names them.

Scale: only additive sums per key are stored, so a hot source costs one row per
batch; every aggregation combines inside the map tasks first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.common import prepared

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
DELTA_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# Counters of tokenizer versions: name -> count expression of a text column (null text: 0).
TOKENIZERS = {
    "words-1": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
    "words-2": lambda text: F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[!-/:-@\[-`{-~]")),
                                       F.lit(0)).cast("long"),
}


def counted(docs: DataFrame, *tokenizers: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numbers of every document: source, lang, ``count_0``, ``count_1``, ... (one per tokenizer) and the columns of ``keep``."""
    return docs.select(*keep, F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       *[TOKENIZERS[t](F.col("text")).alias(f"count_{k}") for k, t in enumerate(tokenizers)])


def signed(counts: DataFrame, tokenizer: str, count: str = "count_0", sign: int = 1) -> DataFrame:
    """Changes that insert (``sign`` 1) or delete (-1) counted documents under ``tokenizer``."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("n_docs"),
                         (F.col(count) * F.lit(sign)).alias("n_tokens"))


def inserted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Signed changes of documents that are new under ``tokenizer`` (columns source, lang, text)."""
    return signed(counted(docs, tokenizer), tokenizer)


def deleted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Signed changes of documents that go: their inserts with the sign turned."""
    return signed(counted(docs, tokenizer), tokenizer, sign=-1)


def revised(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Signed changes of documents whose counts move from one tokenizer version to another."""
    return deleted(docs, old).unionByName(inserted(docs, new))


class Rollup:
    """Totals below one shared folder; every commit is idempotent by its batch name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        """Committed folders of a kind (those with the writer's success mark)."""
        top = self._path(f"{self.root}/{kind}")
        found = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.root}/{kind}/{n}/_SUCCESS")))

    def _covered(self) -> tuple[str | None, set[str]]:
        """The latest snapshot and the batches that it holds."""
        shots = self._names("snapshots")
        if not shots:
            return None, set()
        names = self.spark.read.text(f"{self.root}/covered/{shots[-1]}").collect()  # one row per batch name
        return shots[-1], {r["value"] for r in names}

    def committed(self) -> list[str]:
        return sorted(set(self._names("batches")) | self._covered()[1])

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if a batch of this name is there already."""
        if batch in self.committed():
            return False
        changes.groupBy(*KEYS).agg(*[F.sum(F.col(c)).alias(c) for c in SUMS]) \
            .write.mode("overwrite").parquet(f"{self.root}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Totals per key over all committed batches; keys whose documents are all gone are left out."""
        return self._sums(self._names("batches"), *self._covered())

    def _sums(self, batches: list[str], shot: str | None, covered: set[str]) -> DataFrame:
        """Sums of one snapshot and of those of ``batches`` that it does not hold."""
        paths = [f"{self.root}/batches/{b}" for b in batches if b not in covered]
        paths += [f"{self.root}/snapshots/{shot}"] if shot else []
        parts = self.spark.read.schema(DELTA_SCHEMA).parquet(*paths) if paths \
            else self.spark.createDataFrame([], DELTA_SCHEMA)
        return parts.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]) \
            .where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold the batches committed so far into a new snapshot.

        The folders are listed once: the list that is written names exactly the
        batches in the sums, so a batch committed meanwhile is counted from its own
        folder.  Snapshots have names of their own, so compactions at the same time
        do not meet; any one of them is a right start for ``totals``.
        """
        batches = self._names("batches")
        shot, covered = self._covered()
        if not batches and not covered:
            return
        name = f"{len(self._names('snapshots')):08d}-{uuid.uuid4().hex}"
        held = sorted(covered.union(batches))
        self.spark.createDataFrame([(b,) for b in held], "value string").coalesce(1) \
            .write.mode("overwrite").text(f"{self.root}/covered/{name}")
        self._sums(batches, shot, covered).write.mode("overwrite").parquet(f"{self.root}/snapshots/{name}")


def corpus_rollup(docs: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    """Rollup of a corpus with three kinds of change, the last batch delivered twice.

    ``load`` inserts all documents under the first tokenizer version, ``recount``
    moves all of them to the second one, ``toxic`` deletes the documents that are
    labelled toxic, and ``toxic`` once more changes nothing.

    Texts are counted once, in one scan; what is stored, joined and shuffled after
    it are a few numbers per document.

    A null text counts zero tokens, an empty one too; null sources and languages
    are keys of their own; repeated document rows count as often as they occur, a
    document with repeated labels goes once, and a null id has no label.  Empty
    tables give no rows; extra columns are ignored.
    """
    spark = prepared(docs).sparkSession
    rollup = Rollup(spark, root)
    old, new = TOKENIZERS
    path = f"{rollup.root}/counts-{uuid.uuid4().hex}"
    counted(docs, old, new, keep=("doc_id",)).write.parquet(path)
    counts = spark.read.parquet(path)
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    gone = signed(counts.join(toxic, "doc_id", "left_semi"), new, "count_1", -1)
    rollup.commit("load", signed(counts, old))
    rollup.commit("recount", signed(counts, old, sign=-1).unionByName(signed(counts, new, "count_1")))
    rollup.commit("toxic", gone)
    rollup.commit("toxic", gone)
    rollup.compact()
    return rollup.totals()
