import random
import re

import xxhash

from sparkwright.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fingerprint)."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for k in range(len(fps)):
        groups.setdefault(find(k), []).append(fps[k][0])
    low = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return sorted(((d, f"{f:016x}", low[find(k)]) for k, (d, f) in enumerate(fps)), key=str)


def check(docs, **options):
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()])
    got = simhash.near_duplicates(docs, **options).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_odd_rows(odd):
    check(odd)


def test_documents(sample):
    check(sample)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def near_fingerprints(n=700):
    """A dense ball, a chain of two-bit steps, and far values."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    out = {base}
    while len(out) < n // 2:
        out.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    x = rng.getrandbits(64)
    for _ in range(40):
        x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        out.add(x)
    while len(out) < n:
        out.add(rng.getrandbits(64))
    return sorted(out)


def brute_roots(fps):
    rows = brute_components(list(enumerate(fps)))
    return {d: c for d, _, c in rows}


def test_links_by_every_path_give_the_same_components(spark):
    """Pairwise buckets, probing buckets (few or many values) and the distributed look-up agree with all pairs."""
    fps = near_fingerprints()
    want = brute_roots(fps)
    classes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    place = {simhash._signed(f): k for k, f in enumerate(fps)}
    dense = simhash.DENSE
    try:
        for bucket, few in ((4096, 10_000), (4096, 2), (3, 256)):
            simhash.DENSE = few
            pairs = simhash.links(classes, 2, bucket)
            comp = {r["node"]: r["root"] for r in simhash.components(pairs).collect()}
            groups = {}
            for f, k in place.items():
                groups.setdefault(comp.get(f, f), set()).add(k)
            assert {frozenset(g) for g in groups.values()} == {
                frozenset(k for k in want if want[k] == w) for w in set(want.values())}
    finally:
        simhash.DENSE = dense
