"""Registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import imatch, importance, langid, mixing, neardup, packing, quality, runs, tokenfile, toxicity, trie, urltree, warc
from corvane.llm.common import table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is on this machine; queries take its path from here, operators as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.op4(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op5(table(spark, sf_dir, "documents"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op6(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op9(table(spark, sf_dir, "pages"))


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.op10(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op11(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.op12(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_best_fit_packing, op3_quality_rules, op4_url_filter, op5_minhash_near_dedup, op6_token_binary, op7_toxicity, op8_source_mixing, op9_warc_derivatives,
        op10_imatch_fingerprints, op11_exact_dedup, op12_periodic_runs, op13_importance_resampling,
    )
}
ORACLE_SQL: dict[str, str] = {"op5_minhash_near_dedup": neardup.OP5_SQL, "op8_source_mixing": mixing.OP8_SQL, "op11_exact_dedup": trie.OP11_SQL, "op13_importance_resampling": importance.OP13_SQL}
