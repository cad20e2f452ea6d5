import hashlib
import re

from sparkwright.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            size = min(10, len(w))
            for k in range(len(w) - size + 1 if size and item_id is not None else 0):
                for p in range(len(own) - size + 1):
                    if own[p:p + size] == w[k:k + size]:
                        hit.update(range(p, p + size))
                        found.add(str(item_id))
        names = ",".join(sorted(found))
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [(1, "Quick brown fox jumps over the lazy DOG, the quick brown fox"), (2, "a B c"), (3, None), (4, ""),
         (None, "the quick"), (5, "東京"), (20, "x"), (2, "o p"), (6, "one two three four five six seven eight nine ten eleven")]


def test_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute([(r["doc_id"], r["text"]) for r in odd.where("length(text) < 5000 or text is null").collect()], ITEMS)
    got = decontam.find_leaks(odd.where("length(text) < 5000 or text is null"), items).select(*COLS).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_documents(spark, sample):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = brute([(r["doc_id"], r["text"]) for r in sample.collect()], rows)
    assert any(r[-1] for r in want)
    got = decontam.find_leaks(sample, items).select(*COLS).collect()
    assert sorted(map(tuple, got), key=str) == want
    # a benchmark in many blocks gives the same rows
    got = decontam.find_leaks(sample, items, block_bytes=2000).select(*COLS).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_leaks(odd, none).where("contaminated").count() == 0
    assert decontam.find_leaks(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, "Keep this: A b, C! and é that"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontam.find_leaks(docs, items, clean=True).collect()}
    assert out == {1: "Keep this: ! and é that", 2: "nothing here", 3: None}


def test_odd_rows_in_many_blocks(spark, odd):
    """Null ids, repeated rows and one id with two texts: a benchmark in many blocks gives the rows of one block."""
    docs = odd.where("length(text) < 5000 or text is null").unionByName(odd.where("doc_id = 1").limit(1).selectExpr(
        "2L AS doc_id", "'see: a b c!' AS text", *odd.columns[2:]))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for run in (lambda **kw: decontam.find_leaks(docs, items, clean=True, **kw),
                lambda **kw: decontam.remove_leaks(docs, items, **kw)):
        want = sorted(map(str, run().collect()))
        assert sorted(map(str, run(block_bytes=1).collect())) == want
        assert any("doc_id=None" in r for r in want) and sum("see: " in r for r in want) <= 1


def test_set_is_compact_and_right_for_hot_grams_and_equal_hashes(monkeypatch):
    import random
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    same = " ".join(names[:30])
    items = [(str(k), " ".join(rng.choice(names) for _ in range(200)) + " " + same) for k in range(300)]
    grams = decontam.GramSet(items, 10)
    chars = sum(len(t) for _, t in items)
    assert grams.nbytes() < 10 * chars
    spans, found = grams.hits(decontam.words_of("x " + same + " y"))
    assert len(found) == 300 and decontam._merged(spans) == [(1, 31)]
    text = decontam.words_of(items[7][1])
    assert decontam._merged(grams.hits(text)[0]) == [(0, 230)] and "7" in grams.hits(text)[1]
    assert decontam.GramSet([("1", None), ("2", "")], 10).hits(text) == ([], set())
    # every window has the same hash: words alone decide
    monkeypatch.setattr(decontam, "_windows", lambda codes, n: __import__("numpy").zeros(max(len(codes) - n + 1, 0), dtype="uint64"))
    few = decontam.GramSet([("a", "one two three"), ("b", "two three four"), ("c", "one two three"), ("d", "x")], 3)
    assert few.hits([b"one", b"two", b"three", b"four"]) == ([(0, 3), (1, 4)], {"a", "b", "c"})
