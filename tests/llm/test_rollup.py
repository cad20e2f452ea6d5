from sparkwright.llm import rollup
from sparkwright.llm.common import scratch_path


def totals(df):
    return sorted(map(tuple, df.select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()), key=str)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens long")


ROWS = [(1, "a b c", "s", "en", 7), (2, "d, e", "s", "en", 7), (3, None, None, "de", 7), (4, "", "t", None, 7), (1, "a b c", "s", "en", 7)]


def test_batches_add_up_once(spark):
    all_docs = docs(spark, ROWS)
    r = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    assert totals(r.totals()) == []
    assert r.commit("one", rollup.inserted(all_docs, "words-1"))
    first = [("s", "en", "words-1", 3, 8), ("t", None, "words-1", 1, 0), (None, "de", "words-1", 1, 0)]
    assert totals(r.totals()) == sorted(first, key=str)
    assert not r.commit("one", rollup.inserted(all_docs, "words-1"))
    r.compact()
    assert not r.commit("one", rollup.inserted(all_docs, "words-1"))
    assert totals(r.totals()) == sorted(first, key=str)
    assert r.commit("two", rollup.revised(all_docs, "words-1", "words-2"))
    assert totals(r.totals()) == sorted([("s", "en", "words-2", 3, 9), ("t", None, "words-2", 1, 0), (None, "de", "words-2", 1, 0)], key=str)
    r.commit("three", rollup.deleted(all_docs, "words-2"))
    r.compact()
    assert totals(r.totals()) == []


def test_an_unfinished_batch_is_not_counted(spark):
    r = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    all_docs = docs(spark, ROWS)
    r.commit("one", rollup.inserted(all_docs, "words-1"))
    before = totals(r.totals())
    rollup.inserted(all_docs, "words-1").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false") \
        .parquet(f"{r.root}/batches/two")
    assert totals(r.totals()) == before and r.committed() == ["one"]


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert rollup.corpus_rollup(docs(spark, []), labels, scratch_path(spark, "rollup")).count() == 0


def test_a_batch_committed_during_a_compaction_counts_once(spark, monkeypatch):
    r = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    all_docs = docs(spark, ROWS)
    r.commit("one", rollup.inserted(all_docs, "words-1"))
    sums = r._sums

    def meanwhile(*args):  # between the list of the compaction and its sums
        monkeypatch.setattr(r, "_sums", sums)
        assert r.commit("two", rollup.inserted(all_docs, "words-1"))
        r.compact()        # and another compaction at the same time
        return sums(*args)

    monkeypatch.setattr(r, "_sums", meanwhile)
    r.compact()
    assert totals(r.totals()) == sorted([("s", "en", "words-1", 6, 16), ("t", None, "words-1", 2, 0),
                                         (None, "de", "words-1", 2, 0)], key=str)
    assert not r.commit("two", rollup.inserted(all_docs, "words-1"))
    r.compact()
    assert {n for _, _, _, n, _ in totals(r.totals())} == {6, 2}


def test_corpus_rollup_by_hand_with_a_shuffle_join(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = ROWS + [(None, "x y", "s", "en", 0)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = totals(rollup.corpus_rollup(docs(spark, rows), labels, scratch_path(spark, "rollup")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted([("s", "en", "words-2", 2, 5), ("t", None, "words-2", 1, 0), (None, "de", "words-2", 1, 0)], key=str)
