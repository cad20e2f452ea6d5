import hashlib
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.llm import suffix_dedup as sd


def brute(docs, length=50):
    """docs: (doc_id, text); a null id counts as the largest."""
    big = sd._NO_ID
    low = {}
    rows = [(big if d is None else d, (t or "").encode()) for d, t in docs]
    for d, raw in rows:
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            low[s] = min(low.get(s, big), d)
    out = []
    for d, raw in rows:
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if low[raw[p:p + length]] < d:
                gone[p:p + length] = [True] * length
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out.append((None if d == big else d, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def check(spark, docs, **options):
    df = docs if not isinstance(docs, list) else spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, sd.remove_repeats(df, **options).select(*COLS).collect()), key=str)
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert got == want
    return want


def mixed(seed=3, n=120):
    """Copies, edited copies, shared passages, long runs of one sign and periodic texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]

    def prose(k):
        return " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randrange(8, 40)) for _ in range(6)]
    docs = []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and docs:
            t = rng.choice(docs)[1]
        elif kind == 1 and docs:
            t = list(rng.choice(docs)[1] or "x")
            for _ in range(3):
                t[rng.randrange(len(t))] = "Z"
            t = "".join(t)
        elif kind == 2:
            t = prose(20) + rng.choice(passages) + prose(5) + rng.choice(passages)
        elif kind == 3:
            t = "-" * rng.randrange(40, 400) + prose(3)
        elif kind == 4:
            t = ("ab" * 300)[rng.randrange(2):][:rng.randrange(45, 600)]
        else:
            t = prose(rng.randrange(1, 90))
        docs.append((i, t))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("options", [{}, {"part_bytes": 4000, "shard_bytes": 1500}, {"part_bytes": 3000, "hot_segments": 1}, {"hot_segments": 0}])
def test_mixed_texts(spark, options):
    want = check(spark, mixed(), **options)
    assert sum(r[2] for r in want) > 1000


def test_odd_rows(spark, odd):
    check(spark, odd.select("doc_id", "text", "start", "part"), part_bytes=60_000)


def test_documents(spark, sample):
    check(spark, sample, part_bytes=100_000, shard_bytes=50_000)


def test_kept_bytes_and_spans(spark):
    s = "0123456789" * 6
    out = {r["doc_id"]: r for r in sd.remove_repeats(spark.createDataFrame(
        [(1, "x" + s), (2, "head " + s + " tail")], "doc_id long, text string"), keep=True).collect()}
    assert (out[2]["starts"], out[2]["ends"], bytes(out[2]["kept"])) == ([5], [65], b"head  tail")
    assert (out[1]["starts"], bytes(out[1]["kept"])) == ([], ("x" + s).encode())


def test_a_frequent_line_between_new_neighbours_is_split():
    """Its strings reach many groups, where the anchors alone would put them into a few; few segments stay together."""
    rng = random.Random(5)
    line = b"=== terms of use, all rights kept by their owners ==="
    noise = [bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(3000)]
    many = sd.Part(list(range(3000)), [x + line + x for x in noise], 50, contexts=True)
    copies = sd.Part(list(range(3000)), [noise[0] + line + noise[1]] * 3000, 50, contexts=True)
    groups = 64

    def spread(part, hot_segments):
        names, flags = part.anchors()
        table = sd._rows(sd._ANCHORS, [(0, 0, names.tobytes(), flags.tobytes())])
        told = sd._shared_anchors(table, hot_segments)
        sizes = [len(zstandard.ZstdDecompressor().decompress(b))
                 for b in sd._segments(0, part, *sd._told(told), groups)["bytes"].to_pylist()]
        return max(sizes) / sum(sizes), int(sd._told(told)[1].sum()), int((flags >> 1).max())

    share, hot, most = spread(many, 500)
    assert hot and most in (10, 11) and share < 3 / groups
    assert spread(many, 1 << 20)[0] > 10 / groups
    assert spread(copies, 500)[1:] == (0, 0)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 40))
def test_suffix_order_and_common_prefixes(raw, depth):
    raw = bytes(b % 3 for b in raw)
    text = np.frombuffer(raw, dtype=np.uint8)
    sa = sd.suffix_array(text)
    assert sorted(sa.tolist()) == list(range(len(raw)))
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = sd.common_prefixes(text, sa, depth)
    for k in range(1, len(sa)):
        a, b = raw[sa[k - 1]:], raw[sa[k]:]
        n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(n, depth)
