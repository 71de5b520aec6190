"""A training-data pipeline over `documents`: quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and is written and read
again before the next one.  All but the last return the columns they got, whatever else they are called; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import frames, near_copies, packing, private, quality
from parlance.llm.queries import surrogate_key, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  Null and empty texts have too few words and are rejected; repeated rows are judged alike, each by itself."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of smallest doc_id; of repeated rows one, those without doc_id all."""
    return near_copies.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the texts give way to surrogates of the same length, so n_chars stays true.  Rows stay; null texts stay null."""
    return private.replaced(docs, surrogate_key(spark))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences.  A null or empty text is its end id alone; repeated rows have a place each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("best_fit_packing", best_fit_packing)]

#: SQL can't express suffix arrays, ProbMinHash, keyed surrogates or byte-pair encoding; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = frames.kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
