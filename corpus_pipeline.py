"""A corpus from raw documents to token files: quality, near duplicates, test leaks, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of `documents`.

Defined cases, of every stage, as its operator has them: a null or empty text is scored as one without words by `quality`,
linked with nothing by `near_duplicates`, leaks nothing, has size 0 in `mix_sources` (kept once where its source has
words) and is the end id alone in `tokens`; a null doc_id passes every stage and comes first in the token files; very
long texts are one row's work; rows that repeat a doc_id stay or go together as near duplicates, count one by one
elsewhere; of near duplicates the smallest doc_id stays, and the mixture orders documents by a hash of id and text; an empty table gives no rows in any stage; extra columns, whatever
their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import decontamination, minhash, mixing, quality_gam, token_output
from siftlake.llm.common import Scratch, crc_fold, free_name, read_table

#: Documents scored lower are rejected.
LEAST_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier, fitted on the labelled rows outside the held-out fold."""
    model = quality_gam.train(docs, read_table(spark, sf_dir, "labels"), use=crc_fold(F.col("doc_id"), 4) != 2)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    into = free_name("_score", docs.columns)
    scored = quality_gam.score(docs, model, keep=rest, into=into)
    return scored.where(F.col(into) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, size=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    return decontamination.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document comes as often as its copies say."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, read back: doc_id, start, n_tokens, ids."""
    scratch = Scratch(spark, "pipeline-tokens")
    token_output.write_tokens(docs, scratch.path("files"))
    return token_output.read_tokens(spark, scratch.path("files"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: No SQL: the quality model, the tokenizer and the order by hash have no counterpart there.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            scratch.drop(f"{i - 1}-{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
