"""Corpus preparation in five stages over ``documents``.

Toxic documents go, repeated lines go, of each near-duplicate group one
document stays, documents with benchmark passages go, and what is left is
packed into training sequences. Each stage works on all rows its predecessor
kept; all but the last return the columns of ``documents``.

Defined results
    null or empty texts: never toxic by a rule of their own (the score decides),
    empty after the line stage, near duplicates of nothing, without benchmark
    passages, packed as the end token alone. Null ``doc_id``: passes every stage
    by its own text; it is near duplicate of nothing. Repeated rows are judged
    each by itself, so rows equal in ``doc_id`` and text stay or go together.
    Empty table: empty results of the same columns. Without labels, or with one
    label only, the toxicity stage scores all alike. Other columns pass through
    under any name; ``n_chars`` is counted anew in the line stage, and so are
    ``n_lines`` and ``n_dropped`` where ``documents`` has them. Very long texts
    are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxlink.llm import decontam, line_dedup, near_dedup, packing, toxicity
from rxlink.llm.common import written
from rxlink.llm.queries import BYTE_MODEL, table, tokenizer_file

#: Least shingle similarity, in per cent, of the near duplicates that go.
NEAR_PER_CENT = 80


def _like(docs: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return _like(docs, toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; texts and n_chars change."""
    return _like(docs, line_dedup.dedup_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return _like(docs, near_dedup.keep_one(docs, NEAR_PER_CENT))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _like(docs, decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048."""
    return packing.pack_documents(docs, tokenizer_file(BYTE_MODEL))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Boosted trees and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
