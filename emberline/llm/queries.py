"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import bytepairs, chat, leaks, lines, lm, near, pieces, quality, resample, revisits, secrets, toxic, variants
from emberline.llm.common import documents


def piece_model_path() -> str:
    """The public vocabulary file that operator 10 uses."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_vocabulary_path() -> str:
    """The public vocabulary file that operator 12 uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_line_digests(documents(spark, sf_dir))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir), size=2, percent=80)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.report(revisits.resolve(revisits.page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.read_back(chat.windows(chat.with_probe(turns)))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(documents(spark, sf_dir), piece_model_path())


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op12_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.encode_digests(documents(spark, sf_dir), byte_vocabulary_path())


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": leaks.ORACLE, "op2_line_dedup": lines.ORACLE, "op3_near_duplicates": near.ORACLE, "op8_revisits": revisits.ORACLE, "op9_chat": chat.ORACLE, "op11_variants": variants.ORACLE, "op13_resample": resample.ORACLE}
