"""The registered queries of the corpus operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, compression_rules, decontamination, fill_in_middle, hard_negatives, html_text, line_dedup, minhash, mixing, passage_dedup, quality_gam, token_output, toxicity
from . import sql
from .common import crc_fold, read_table

THRESHOLD = 0.7


def _predict(scored: DataFrame, held_out: Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, num=85, den=100)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read_table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), use=~held_out)
    return _predict(toxicity.score(docs, model), held_out)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.digest_repeats(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest_lines(read_table(spark, sf_dir, "documents"))


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules.compression_rules(read_table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.tokens_of(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read_table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), 4) == 2
    model = quality_gam.train(docs, read_table(spark, sf_dir, "labels"), use=~held_out)
    return _predict(quality_gam.score(docs, model), held_out)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(read_table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(spark, read_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(spark, read_table(spark, sf_dir, "embeddings"), hard_negatives.shifted_labels(), F.col("vec_id") % 100 == 0)


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets that op5_mixing meets, by source."""
    return mixing.targets_of(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_minhash, op2_toxicity, op3_passages, op4_decontamination, op5_mixing, op6_lines, op7_compression, op8_tokens, op9_quality, op10_html, op11_fill_in_middle, op12_chat, op13_hard_negatives, mix_targets)}

ORACLE_SQL: dict[str, str] = {"op1_minhash": sql.MINHASH, "op3_passages": sql.PASSAGES, "op6_lines": line_dedup.SQL, "mix_targets": mixing.TARGETS_SQL, "op11_fill_in_middle": fill_in_middle.SQL, "op12_chat": chat_format.SQL, "op13_hard_negatives": hard_negatives.SQL}
