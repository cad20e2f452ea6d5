"""Arrow batches of long texts and the words kept per worker are bounded."""

import pyarrow as pa
from pyspark.sql import functions as F

from sparkwright.llm import mil, tokens
from sparkwright.llm.common import prepared


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 100).alias("text"))
    most, rows = prepared(docs).mapInArrow(sizes, "n long, size long").agg(F.max("size"), F.sum("n")).first()
    assert most < 6 << 20 and rows == 4000


def test_a_callers_bound_stays(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "9m")
    prepared(spark.range(1))
    assert spark.conf.get(name) == "9m"
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_scores_do_not_depend_on_the_memo():
    text = " ".join(f"word{k % 700}" for k in range(3000))
    known, most = mil.passages(text), mil._MEMO
    try:
        mil._MEMO = 5
        mil._slots.clear()
        assert (mil.passages(text) == known).all() and len(mil._slots) <= 6
    finally:
        mil._MEMO = most


def test_words_kept_per_worker_are_bounded():
    assert mil._MEMO <= 100_000 and tokens.MEMO_WORDS <= 350_000 and tokens.MEMO_UNITS <= 350_000


def test_a_batch_has_the_ids_of_its_texts():
    words = ["the", "Don't", "a<|b", "<|endoftext|>", "x1y22", "\u00e9t\u00e9", "\u65e5\u672c", "\u0130I", "na\u00efve.", "\u03a3", "a\u00a0b",
             "\x1c", "a\x00b", "\U0001f600", "--", "'"]
    gaps = [" ", "\n", "\t\r", "\x0b\x0c", "  "]
    texts = [None, "", " ", "\n"] + ["".join(words[(k * j + j) % len(words)] + gaps[j % (k % 5 + 1)] for j in range(k % 40)) for k in range(300)]
    one = tokens.WordTokenizer(tokens.tokenizer_path())
    for batch in (pa.array(texts), pa.array(texts).slice(3, 50), pa.array(["it's"]), pa.array([""]), pa.array([], pa.string())):
        ids, counts = one.encode_batch(batch)
        known = [one.encode_bytes(text) for text in batch.to_pylist()]
        assert ids.dtype == "uint32" and ids.tobytes() == b"".join(known)
        assert counts.tolist() == [len(x) // 4 for x in known]


def test_a_word_is_encoded_once_per_batch():
    class Counted(dict):
        looked_up = 0

        def __getitem__(self, unit):
            self.looked_up += 1
            return super().__getitem__(unit)

    one = tokens.WordTokenizer(tokens.tokenizer_path())
    one._words.units = Counted({"often": b"\5\0\0\0", "here": b"\6\0\0\0", "\n": tokens._STOP})
    ids, counts = one.encode_batch(pa.array([" ".join(["Often here"] * 500)] * 20))
    assert ids.tolist() == [5, 6] * 10_000 and counts.tolist() == [1000] * 20
    assert one._words.units.looked_up == 4    # two words and two line ends
