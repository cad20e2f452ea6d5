"""Operator 9: URL filters with a blocked Bloom filter and an exact join.

Rules on hosts and path prefixes come first.  Every other URL is looked up in a
list of canonical URLs: a Bloom filter of 256-bit blocks (four words; a key sets
one bit in each word of one block) passes possible hits, and an exact join with
the list removes the false ones.

Everything is DataFrame functions.  Building is one aggregation (``bit_or`` per
block, combined map-side).  The filter grows with the list (``BITS_PER_KEY``), so
it is broadcast only below ``BROADCAST_BYTES`` of its known size and joined by
block otherwise.  Only possible hits, not all URLs, meet the list itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import prepared

BITS_PER_KEY = 20
BLOCK_BITS, WORDS = 256, 4
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, and the paths that start with ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    """Host of a URL, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path of a URL up to its query or fragment; empty for null or without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, and the path without slashes at its end."""
    return F.concat(F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"/+$", ""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest one is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit in each word of the key's block."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocked Bloom filter of a key column: ``block`` and its words ``w0`` to ``w3``."""
    own = keys.select(_block(F.col(key), blocks).alias("block"), *[b.alias(f"w{k}") for k, b in
                                                                 enumerate(_bits(F.col(key)))])
    return own.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url",
          listed_col: str = "url", bits_per_key: int = BITS_PER_KEY,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verdict of every page row: page_id, host, path, rule, verdict (``allow`` or ``block``).

    The longest fitting rule decides; without one, a URL is blocked if its
    canonical form is that of a listed URL.

    A null URL or one without ``://`` has an empty host and path, fits no rule and
    is allowed; such rows of the list are ignored.  Null ids and repeated pages
    are judged row by row; repeated list entries count once; an empty list blocks
    nothing, an empty table gives no rows; extra columns are ignored.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    keys = prepared(listed).select(host_of(F.col(listed_col)).alias("h"), path_of(F.col(listed_col)).alias("p")) \
        .where("h <> ''").select(canonical(F.col("h"), F.col("p")).alias("key")).distinct().checkpoint(eager=True)
    blocks = max(1, -(-keys.count() * bits_per_key // BLOCK_BITS))
    blooms = bloom_blocks(keys, "key", blocks)
    if blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        blooms = F.broadcast(blooms)
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"),
                           canonical(F.col("host"), F.col("path")).alias("key"))
    ruled = parsed.where("ruled IS NOT NULL").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))
    asked = parsed.where("ruled IS NULL").withColumn("block", _block(F.col("key"), blocks)).join(blooms, "block", "left")
    hit = F.lit(True)
    for k, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.coalesce(F.col(f"w{k}"), F.lit(0)).bitwiseAND(bit) != 0)
    asked = asked.withColumn("possible", hit)
    missed = asked.where("NOT possible").select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"))
    exact = asked.where("possible").join(keys.withColumn("listed", F.lit(True)), "key", "left") \
        .select("page_id", "host", "path", "rule",
                F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return ruled.unionByName(missed).unionByName(exact)
