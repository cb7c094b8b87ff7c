"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import bpe, divergence, exact, jaccard, mixing, packing, quality, secrets, sharding, substring, tokenbin, warc, whitening


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"), least=1000)


#: Bytes of text in a shard of the query op2_extendible_shards.
SHARD_BYTES = 2 << 20


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary(), capacity=1024, end_id=2)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = jaccard.Rule(words=4, num=85, den=100)
    return jaccard.near_groups(_table(spark, sf_dir, "documents"), rule).drop("text_hash")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_ids(_table(spark, sf_dir, "documents"), _vocabulary(), end_id=2)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=50)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), _vocabulary())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_extendible_shards": op2_extendible_shards,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_token_ids": op7_token_ids,
    "op8_mix_sources": op8_mix_sources,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_whitening": op12_whitening,
    "op13_divergence_audit": op13_divergence_audit,
}
SQL = {"op9_substring_dedup": substring.REPEATS_SQL, "op1_warc_archives": warc.WARC_SQL, "op2_extendible_shards": sharding.shard_sql(SHARD_BYTES), "op6_quality_rules": quality.QUALITY_SQL, "op8_mix_sources": mixing.MIX_SQL, "op10_exact_dedup": exact.EXACT_SQL, "op13_divergence_audit": divergence.AUDIT_SQL}
