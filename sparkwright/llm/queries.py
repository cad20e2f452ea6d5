"""Registered queries of this subpackage (thin: each calls its operator)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import content_sort, decontam, mil, oracles as sql, packing, pii, quality_rules, rollup, simhash, suffix_dedup, turn_repair, urls, wavelet, whitening
from sparkwright.llm.common import prepared, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes in all documents."""
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("starts", "ends", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, one row per piece."""
    return packing.pack(_table(spark, sf_dir, "documents")).drop("ids")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics and calibrated isolation-forest verdicts of all documents."""
    out = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "score")


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after an insert, a revising and a deleting batch, the last one delivered twice."""
    docs = prepared(_table(spark, sf_dir, "documents"))
    return rollup.corpus_rollup(docs, _table(spark, sf_dir, "labels"), scratch_path(spark, "rollup"))


def op5_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as wavelet-matrix shards and read back."""
    return wavelet.round_trip(_table(spark, sf_dir, "documents"))


def op6_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at two bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark in all documents."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")) \
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return mil.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


# Rules of the URL query (fixed values) and the signs whose runs mark a junk page.
URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]
JUNK_RUNS, JUNK_COUNT = ("###", "***", "$$$", "%%%"), 40


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; the list holds the URLs of pages full of symbol runs."""
    pages = _table(spark, sf_dir, "pages")
    html = F.col("html")
    runs = sum((F.length(html) - F.length(F.replace(html, F.lit(r)))) / 3 for r in JUNK_RUNS)
    return urls.judge(pages, pages.where(runs >= JUNK_COUNT).select("url"), URL_RULES)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repairs of all conversations after the contract's damage."""
    return turn_repair.report(turn_repair.damage(_table(spark, sf_dir, "conversations")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings, whitened to eight components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in all documents."""
    return content_sort.exact_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_rollups": op4_token_rollups,
    "op5_wavelet_shards": op5_wavelet_shards,
    "op6_covering_simhash": op6_covering_simhash,
    "op7_decontamination": op7_decontamination,
    "op8_attention_quality": op8_attention_quality,
    "op9_url_filters": op9_url_filters,
    "op10_personal_data": op10_personal_data,
    "op11_turn_repair": op11_turn_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES: dict[str, str] = {
    "op4_token_rollups": sql.TOKEN_ROLLUPS,
    "op7_decontamination": sql.DECONTAMINATION,
    "op9_url_filters": sql.URL_FILTERS,
    "op11_turn_repair": sql.TURN_REPAIR,
    "op13_exact_dedup": sql.EXACT_DEDUP,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
