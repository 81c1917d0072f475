"""The registered queries of the training-data operators: op1 to op10 and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _judged(rows: DataFrame, level: float) -> DataFrame:
    from .neural import fold

    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")  # a row without id is in no fold
    return rows.select("doc_id", held, "score", (F.col("score") >= level).cast("int").alias("predicted"))


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_mil import fit, score

    docs = table(spark, sf_dir, "documents")
    return _judged(score(docs, fit(docs, table(spark, sf_dir, "labels"))), 0.5)


def op3_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, predict
    from .neural import fold

    docs = table(spark, sf_dir, "documents")
    rows = predict(docs, fit(docs))
    return rows.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import grouped_digests

    return grouped_digests(table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths, so each gets source/thousands/hundreds/doc_id; a row without doc_id has none and inherits nothing."""
    from .licenses import scan

    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.expr("doc_id div 1000"), F.expr("doc_id div 100"), F.col("doc_id"))
    path = F.when(F.col("doc_id").isNotNull(), path)
    return scan(docs, path)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op8_window_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import LEVEL, fit, score

    docs = table(spark, sf_dir, "documents")
    return _judged(score(docs, fit(docs, table(spark, sf_dir, "labels"))), LEVEL)


def op9_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_table

    return token_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_benchmark_leaks,
        op2_attention_quality,
        op3_byte_gru_language,
        op4_canonical_digest,
        op5_licence_scan,
        op6_simhash_groups,
        op7_bootstrapped_pii,
        op8_window_toxicity,
        op9_dp_packing,
        op10_elias_fano_tokens,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
