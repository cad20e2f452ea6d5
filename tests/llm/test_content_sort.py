import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkwright.llm import content_sort as cs


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        best = min((i for i in ids if i is not None), default=None)
        left = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, best, len(ids), left, hashlib.sha256(t.encode()).hexdigest()))
            left = False
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_odd_rows(spark, odd, partitions):
    df = odd.withColumnsRenamed({"fp": "run", "start": "edge", "n": "size", "label": "first", "span": "digest"}) \
        .withColumns({"id": F.lit(-5), "row": F.lit("r"), "norm": F.lit(""), "head": F.lit(1), "lead": F.lit(2)})
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows_of(cs.exact_groups(df.repartition(3), partitions=partitions)) == brute(rows)


def test_a_group_of_a_third_of_all_rows_is_split(spark, tmp_path):
    """Copies over many partitions, null ids and one id repeated among them; few arrow rows per batch."""
    text = "shared  text\n" * 30
    rows = [(i, text if i % 3 == 0 else f"shared text number {i % 500}" * 5) for i in range(3000)]
    rows += [(None, text.replace("\n", "\t ")) for _ in range(50)] + [(0, text)] * 40 + [(9, None), (8, ""), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert rows_of(cs.exact_groups(df, partitions=12)) == brute(rows)
        runs = cs.sorted_runs(df, str(tmp_path / "runs"), partitions=12).where("size IS NULL")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = [r["count"] for r in runs.groupBy("part").count().collect()]
    assert len(parts) > 8 and max(parts) < len(rows) / 4
    edges = spark.read.parquet(str(tmp_path / "runs")).where("edge IS NOT NULL").collect()
    assert len(edges) <= 2 * 12 and sum(r["edge"].decode() == norm(text) for r in edges) >= 4


def test_equal_hashes_do_not_make_texts_equal(spark, monkeypatch):
    monkeypatch.setattr(cs.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    head = "x" * cs.HEAD_BYTES
    rows = [(i, head + str(i % 9)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = cs.exact_groups(df, partitions=1)
    assert rows_of(got) == brute(rows)


def test_kept_documents_have_all_columns(spark, odd):
    kept = cs.drop_copies(odd, partitions=4)
    assert kept.schema == odd.schema
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == \
        sorted(i for i, _, _, stays, _ in brute(rows) if stays and i is not None)
    assert kept.where("doc_id IS NULL").count() == 1
    assert cs.drop_copies(odd.limit(0)).count() == 0 and cs.exact_groups(odd.limit(0)).count() == 0


def test_sample_table(spark, sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.select("doc_id", "text").collect()]
    assert rows_of(cs.exact_groups(sample)) == brute(rows)
