"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. Between stages
``run`` writes Parquet into the shared folder and reads it again, so that a lost executor costs one
stage's part at most; a stage's folder goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptloom.llm import bpe, near_texts, quality_rules, secret_scan, source_mixing
from promptloom.llm.common import cut, remove_folder, shared_folder, table
from promptloom.llm.queries import TARGETS, labelled_domains, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the learned rules reject."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose texts share 0.8 of their five-word shingles, that of the smallest doc_id."""
    return near_texts.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; keeps every document."""
    return secret_scan.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that expected token totals meet the target shares; leaves none out."""
    model = source_mixing.fit_domains(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), sorted(TARGETS))
    mix = source_mixing.fit_mix(cut(source_mixing.profile(docs, model)), model, TARGETS, floor=1.0)
    return source_mixing.mixed(docs, mix)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and decodes them again: digests and counts for each row."""
    return bpe.encode_digests(docs, vocabulary())


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Rules, domains and rates are learned, so SQL cannot express the result; tests/llm checks it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result of the last."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
