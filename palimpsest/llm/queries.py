"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bbit_minhash, fair_mix, hard_negatives, license_scan, line_crf, line_dedup, mixture_langid, oracles, positional_index, quality_rules, simhash_trie, token_counts, warc_chain, whitening
from palimpsest.runtime import read_table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies; the same path on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    kept = quality_rules.passes(quality_rules.BASE) & quality_rules.passes(quality_rules.DEFAULT)
    base = (~quality_rules.passes(quality_rules.BASE)).alias("base_failed")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, kept.alias("kept"), "failures")


def op2_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_file()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = line_crf.score(docs, line_crf.train(docs, read_table(spark, sf_dir, "labels")))
    held_out = F.coalesce(line_crf.fold_of("doc_id") == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def op5_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positional_index.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "license", F.round("dice", 6).alias("dice"), "n_matches", F.array_join("licenses", ",").alias("licenses"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fair_mix.mix(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.orderBy("virtual_finish", "source", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op8_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = mixture_langid.identify(docs, mixture_langid.train(docs))
    held_out = F.coalesce(mixture_langid.fold_of("doc_id") == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_deleted_lines", "n_deleted_words", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chain.round_trip(read_table(spark, sf_dir, "pages")).drop("url")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_simhash_trie, op3_token_counts, op4_line_crf, op5_positional_index, op6_license_scan, op7_fair_mix, op8_mixture_langid, op9_line_dedup, op10_warc_chain, op11_hard_negatives, op12_whitening, op13_bbit_minhash)}


def oracle_sql() -> dict[str, str]:
    """The others hash as DuckDB can't, or learn or align; tests/llm holds them against brute force and held-out rows."""
    return {"op1_quality_rules": oracles.QUALITY_RULES, "op5_positional_index": oracles.CONTAMINATION, "op7_fair_mix": oracles.FAIR_MIX, "op10_warc_chain": oracles.WARC, "op11_hard_negatives": oracles.HARD_NEGATIVES}
