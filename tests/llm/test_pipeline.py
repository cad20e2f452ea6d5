import re

import pytest

import corpus_pipeline
from sparkwright.llm import decontam, mil, pii, simhash
from tests.llm.test_decontam import brute as leaks
from tests.llm.packing_checks import check_packing, whole_ids
from tests.llm.test_pii import PLAIN, ok
from tests.llm.test_simhash import brute_components, brute_fingerprint

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and returned on the smallest tables."""
    top, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, D).write.parquet(f"{top}/{name}")
        rows = spark.read.parquet(f"{top}/{name}")
        out[name] = docs, rows
        docs = rows
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns_stay(spark, stages):
    names = spark.read.parquet(f"{D}/documents.parquet").columns
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][1].columns == names


def test_quality(spark, stages):
    docs, kept = stages["quality_classifier"]
    good = mil.classify(docs, spark.read.parquet(f"{D}/labels.parquet")).where("predicted = 1")
    assert rows(kept) == rows(docs.join(good.select("doc_id"), "doc_id", "left_semi").select(*docs.columns))
    assert 0 < kept.count() < docs.count()


def test_near_duplicates(stages):
    docs, kept = stages["simhash_near_dedup"]
    groups = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()])
    stay = {d for d, _, c in groups if d == c}
    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if r["doc_id"] in stay), key=str)
    assert kept.count() < docs.count()


NAMES = ["fingerprint", "group", "__rid", "__key", "__cuts", "doc", "rid", "id", "row", "starts", "text_sha256", "fp"]


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with extra columns named like columns of the operators."""
    from pyspark.sql import functions as F
    return odd.select("doc_id", "text", "lang", "source", "n_chars", *[
        (F.lit(k) if k % 2 else F.lit(f"v{k}")).alias(n) for k, n in enumerate(NAMES)])


def test_near_duplicates_of_odd_rows(spark, clashing):
    """One row per group: repeated rows, one id with two texts, rows without ids, clashing columns."""
    extra = spark.createDataFrame([(1, "T one two three four five"), (5, "T one two three four five"), (5, "U another text altogether here"),
                                   (None, "U another text altogether here"), (None, "only without an id at all"), (None, "only without an id at all")],
                                  "doc_id long, text string")
    docs = clashing.unionByName(extra, allowMissingColumns=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups, members = {}, [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = simhash.near_duplicates(docs.select("doc_id", "text")).collect()
    by_fp = {r["fingerprint"]: r["group"] for r in judged}
    for i, t in members:
        fp = f"{brute_fingerprint(t):016x}" if isinstance(brute_fingerprint(t), int) else brute_fingerprint(t)
        groups.setdefault(by_fp[fp], []).append((i is None, i, fp, t))
    got = {}
    for r in kept.collect():
        fp = brute_fingerprint(r["text"])
        got.setdefault(by_fp[f"{fp:016x}" if isinstance(fp, int) else fp], []).append((r["doc_id"], r["text"]))
    assert set(got) == set(groups) and all(len(v) == 1 for v in got.values())
    for g, own in groups.items():
        lead = min((m[:3] for m in own), key=lambda m: (m[0], m[1] or 0, m[2]))
        assert got[g][0] in {(m[1], m[3]) for m in own if m[:3] == lead}
    assert rows(simhash.keep_one(docs.limit(0))) == []


@pytest.mark.parametrize("block_bytes", [1, 1 << 25])
def test_stages_leave_clashing_columns_alone(spark, clashing, block_bytes):
    """Every filtering stage over odd rows whose other columns have the operators' names, in one and many blocks."""
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog the quick brown fox"), (2, "p"), (3, "東京")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (lambda d: decontam.remove_leaks(d, items, block_bytes=block_bytes), pii.redact, lambda d: mil.keep_good(d, labels)):
        out = stage(clashing)
        assert out.columns == clashing.columns
        for k, n in enumerate(NAMES):
            assert {r[n] for r in out.select(n).distinct().collect()} <= {k if k % 2 else f"v{k}"}
        assert rows(out.select(*plain.columns)) == rows(stage(plain)) and rows(stage(clashing.limit(0))) == []


def test_decontamination(spark, stages):
    docs, kept = stages["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    before = {d: (n, hit) for d, n, hit, *_ in leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items)}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    for d, (n, hit) in before.items():
        assert (d in left) == (hit <= n / 2)
        if d in left:
            assert (left[d] == texts[d]) == (hit == 0)
            assert len(decontam.words_of(left[d])) == n - hit
    many = decontam.remove_leaks(docs, spark.read.parquet(f"{D}/benchmark.parquet"), block_bytes=3000)
    assert rows(many) == rows(kept)


def test_personal_data(stages):
    docs, kept = stages["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert set(texts) == set(left)
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(docs).collect()}
    for d, t in texts.items():
        cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[d].split(",") if s))
        out, done = "", 0
        for a, b, k in cuts:
            if b > done:
                out += t[done:max(a, done)] + f"[{k.upper()}]"
                done = b
        assert left[d] == out + t[done:]
        for kind in ("email", "ip", "phone"):
            assert not any(ok(kind, m[0]) for m in re.finditer(PLAIN[kind], left[d], re.ASCII))


def test_packing(stages):
    docs, pieces = stages["packing"]
    assert check_packing(pieces.collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], whole_ids()) == 0


def test_run_gives_the_last_stage(spark, stages):
    got, want = corpus_pipeline.run(spark, D), stages["packing"][1]
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    total = lambda df: sorted((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert set(key) <= set(got.columns) and total(got) == total(want)
