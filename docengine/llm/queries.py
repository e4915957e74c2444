"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, line_rules, mixing, oracles, packing, pii, pivots, quality_fm, simhash, tokens, url_filter
from .common import fold_of, table


def definition(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """The text of a tokenizer file, read where the driver runs and sent to the workers."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), count="n_replaced")


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    found = language.identify(docs, ~F.col("held_out"), columns=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def op4_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold_of(F.col("doc_id")) == 0)
    machine = quality_fm.train(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id")) != 0)
    found = quality_fm.scored(docs, machine, columns=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_rules.judged(table(spark, sf_dir, "documents"), columns=["doc_id"], cleaned=False)
    return found.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), definition())


def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), definition())


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_pii, op3_ppm_language, op4_fm_quality, op5_line_rules, op6_simhash, op7_link_trust, op8_pattern_packing, op9_pivot_index, op10_token_counts)}
ORACLES: dict[str, str] = {
    "op1_source_mix": oracles.SOURCE_MIX,
    "op5_line_rules": oracles.LINE_RULES,
    "op9_pivot_index": oracles.PIVOT_INDEX,
}
