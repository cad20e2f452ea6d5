import re

import pytest

from sparkwright.llm import queries, urls

RULES = queries.URL_RULES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def canonical(url):
    host, path = parse(url)
    return re.sub(r"^(www|m)\.", "", host) + path.rstrip("/")


def brute(pages, listed):
    keys = {canonical(u) for u in listed if parse(u)[0]}
    out = []
    for page_id, url in pages:
        host, path = parse(url)
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.name), default=None)
        verdict = rule.verdict if rule else "block" if canonical(url) in keys else "allow"
        out.append((page_id, host, path, rule.name if rule else None, verdict))
    return sorted(out, key=str)


ODD = [None, "", "no scheme", "http://", "http://Example.ORG/es/1", "http://example.org/en/1x", "http://example.org/en/2",
       "http://example.org", "http://badexample.org/es/", "ftp://a.COM/fr/?q#f", "http://a.com/de/://x", "x://net/p/",
       "http://www.net/p", "http://m.net//p//", "HTTP://net?x/y", "http://net#", "http://com/fr/", "http://acom/fr/",
       "http://É.net/ü?", "http://net/p/", "http://net/p/", "http://" + "a" * 50_000 + ".net/" + "b/" * 50_000]


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_odd_urls(spark, broadcast_bytes):
    pages = [*enumerate(ODD), (None, "http://net/p"), (3, "http://net/p")]
    df = spark.createDataFrame([(i, u, "h", "k", 1) for i, u in pages], "page_id long, url string, host string, key string, block long")
    for listed in ([], [None, "x", "https://net/p", "https://net/p/", "http://", "http://m.www.net/p", "q://É.net/ü"]):
        rows = spark.createDataFrame([(u, 1) for u in listed], "url string, w0 long")
        got = urls.judge(df, rows, RULES, broadcast_bytes=broadcast_bytes).collect()
        assert sorted(map(tuple, got), key=str) == brute(pages, listed)
    assert urls.judge(df.limit(0), rows, RULES).count() == 0


# The contract's rules, written out: which URL gets which rule and verdict.
FIXED = [("http://a.org/x", "org/", "allow"), ("http://example.org/", "org/", "allow"), ("http://example.org/en/2", "org/", "allow"),
         ("http://example.org/es/", "example.org/es/", "block"), ("http://www.example.org/es/9?q", "example.org/es/", "block"),
         ("http://example.org/en/1", "example.org/en/1", "block"), ("http://m.Example.org/en/17", "example.org/en/1", "block"),
         ("http://a.com/fr/", "com/fr/", "allow"), ("http://com/fr/1", "com/fr/", "allow"),
         ("http://a.com/de/", "com/de/", "block"), ("http://b.a.com/de/1#x", "com/de/", "block"),
         ("http://a.com/es/", None, "block"), ("http://a.net/de/", None, "allow"), ("http://badcom/de/", None, "allow")]


def test_the_rules_of_the_query(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(FIXED)], "page_id long, url string")
    listed = spark.createDataFrame([("http://www.a.com/es",), ("http://a.com/fr/",)], "url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(df, listed, queries.URL_RULES).collect()}
    assert [got[i] for i in range(len(FIXED))] == [(rule, verdict) for _, rule, verdict in FIXED]


def test_false_positives_of_a_crowded_filter_are_removed(spark):
    pages = [(i, f"http://h{i % 50}.net/{i}") for i in range(3000)]
    listed = [u for i, u in pages if i % 3 == 0]
    df = spark.createDataFrame(pages, "page_id long, url string")
    rows = spark.createDataFrame([(u,) for u in listed], "url string")
    got = urls.judge(df, rows, RULES, bits_per_key=1).collect()
    assert sorted(map(tuple, got), key=str) == brute(pages, listed)


def test_the_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    blocks = 20_000 * urls.BITS_PER_KEY // urls.BLOCK_BITS
    blooms = urls.bloom_blocks(keys, "key", blocks)
    asked = spark.range(40_000).selectExpr("id", "concat('k', id) AS key")
    asked = asked.withColumn("block", urls._block(asked["key"], blocks)).join(blooms, "block", "left")
    hit = True
    for k, bit in enumerate(urls._bits(asked["key"])):
        hit = (asked[f"w{k}"].bitwiseAND(bit) != 0) & hit
    out = {r["listed"]: r["n"] for r in asked.where(hit).selectExpr("id < 20000 AS listed").groupBy("listed").count()
           .withColumnRenamed("count", "n").collect()}
    assert out[True] == 20_000 and out.get(False, 0) < 400
