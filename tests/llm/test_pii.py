import hashlib
import re

import pytest

from sparkwright.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def ok(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")),
            "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    found = [(kind, m.start(), m.end()) for kind, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII)
             if ok(kind, m[0])]
    return found, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


ODD = [None, "", "a@b.c_d@e.f x@y", "..a%+@b-.c.d. 1.2.3.4.5.6.7.8", "1.2.3.256 300.1.1.1 000255.0.0.1 9.9.9.99999999999999999999",
       "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
       "+1 (415) 555.2671 +12 +49-30-123456 +1234567890123456", "é😀 mail:ü.x@host.example.com😀 10.0.0.1",
       "call 415-555-2671 or jo [at] host [dot] org; ssn 123-45-6789", "a" * 2000, "1" * 2000, "1 " * 2000,
       "x@y.z " * 500, "+1" + " 2" * 5 + "+" * 1000, "a." * 1000 + "@", "4111111111111111" * 2, "5500-0000 0000-0004"]


def check(docs):
    rows = pii.find_personal_data(docs).collect()
    texts, known = {}, {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
        known[r["text"]] = known.get(r["text"]) or brute(r["text"])
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((d for d, t in texts.items() for _ in t), key=str)
    for r in rows:
        text = next((t for t in texts[r["doc_id"]] if known[t][1] == r["base_sha256"]), 0)
        assert text != 0, r
        found = known[text][0]
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in found)
        every = set(filter(None, r["spans"].split(",")))
        assert {f"{k}:{a}:{b}" for k, a, b in found} <= every
        for s in every:
            a, b = map(int, s.split(":")[1:])
            assert 0 <= a < b <= len(text or "")
    return rows


def test_odd_texts(spark, odd):
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate([*ODD, ODD[2]])], "doc_id long, text string, kind string, start long")
    check(docs.unionByName(docs.where("doc_id = 5")))
    check(odd)


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "a." * 500_000 + "@", "x@y.z " * 2000, "1.2.3." * 100_000,
             "+1" + " " * 1_000_000, "A1" * 300_000, "1-2" * 300_000, "a@" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.find_personal_data(docs).collect()}
    assert out[4]["n_email"] == 2000 and out[5]["n_ip"] == 75_000 and out[0]["spans"] == ""


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal_data(none).count() == 0 and pii.redact(none).count() == 0


def test_trees_add_spans(spark):
    """Spelled-out addresses look like addresses to trees that learned from plain ones; plain text stays clean."""
    rows = [(i, f"write jo{i}@host{i % 7}.example.org, ref {i} {i * 37 % 1000} {i * 7 % 999 + 1000}; 1.2.3.{i}") for i in range(400)]
    rows += [(1000, "contact mary.major [at] host.example [dot] com today"), (1001, "we meet at noon, dot by dot")]
    out = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1000] == "email_spelled:8:46" and out[1001] == ""


def test_named_tokens_are_found_and_thresholds_are_per_kind(spark):
    """A planted key outside the base kinds is found; words, plain numbers and unnamed identifiers stay."""
    import hashlib
    rows = []
    for i in range(300):
        key = hashlib.sha1(str(i).encode()).hexdigest()
        rows.append((i, f'text here token = "{key}" and mail jo{i}@host.example.org more'))
        rows.append((1000 + i, f"commit {key} of run {i * 7919} was on 2024; see build/{key[:24]}x{i}"))
        rows.append((2000 + i, "incomprehensibilitiesandcounterrevolutionaries 12345678901234567890123456 plain"))
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("secret:19:59" in got[i].split(",") for i in range(300)) == 300
    assert not any("secret" in got[1000 + i] for i in range(300)) and not any(got[2000 + i] for i in range(300))
    clean = pii.redact(spark.createDataFrame([rows[0]] + rows[3:], "doc_id long, text string")).where("doc_id = 0").first()["text"]
    assert clean == 'text here token = "[SECRET]" and mail [EMAIL] more'


def test_documents_hold_added_spans(spark):
    """On the sample corpus the trees decide: every named token is found, beside the base spans."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    spans = {r["doc_id"]: r["spans"].split(",") for r in pii.find_personal_data(docs).collect()}
    planted = {d: [(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "")] for d, t in texts.items()}
    assert sum(map(len, planted.values())) > 5
    for d, found in planted.items():
        assert {f"secret:{a}:{b}" for a, b in found} == {s for s in spans[d] if s.startswith("secret")}


def test_redaction(spark):
    rows = [(1, "mail é a.b@c.de, ip 10.0.0.1!", "s"), (1, "mail é a.b@c.de, ip 10.0.0.1!", "s"), (2, None, "s"), (3, "", "s"),
            (None, "clean", None), (4, "+49 30 1234567890 x", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted(map(tuple, pii.redact(docs).collect()), key=str)
    assert out == sorted([(1, "mail é [EMAIL], ip [IP]!", "s"), (1, "mail é [EMAIL], ip [IP]!", "s"), (2, None, "s"),
                          (3, "", "s"), (None, "clean", None), (4, "[PHONE] x", "t")], key=str)


@pytest.mark.parametrize("text", ODD[2:10])
def test_overlaps_become_one(spark, text):
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert not any(ok("email", m[0]) for m in re.finditer(PLAIN["email"], out))
