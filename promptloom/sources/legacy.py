"""Trees of older layouts: two files a run, met by what their paths say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .results import scanned

#: Both files of a run, the one with its scores and the one with its search, in one schema.
FILE = (
    "primary_metric double, metrics struct<accuracy:double>, token_usage struct<total_tokens:long,prompt_tokens:long,completion_tokens:long>, model string, "
    "best_score double, best_prompt string, elapsed_seconds double, num_generations int, total_llm_calls long, _corrupt string"
)
# The places of the two layouts below a root, and which file holds what.
SEED_FOLDERS = r"^([^/]+)/\1/(.+)_seed(\d+)/\2_\1_\1_seed\3_(metrics|optimization)\.json$"
METHOD_FOLDERS = r"^([^/]+)/([^/]+)/seed(\d+)/([^/]+)/(summary|history)\.json$"
SEED_FOLDER_DATASETS = ("gsm8k", "humaneval")


def seed_folder_files(files: DataFrame) -> DataFrame:
    """Files under ``dataset/dataset/method_seedN/``: method, task, seed, and whether a file holds the scores."""
    part = lambda i: F.regexp_extract("place", SEED_FOLDERS, i)
    placed = files.withColumn("place", F.array_join("path", "/")).where(F.regexp_like("place", F.lit(SEED_FOLDERS)))
    return placed.withColumns({"method": part(2), "task": part(1), "seed": part(3).cast("long"), "scores": part(4) == "metrics"}).where(F.col("task").isin(*SEED_FOLDER_DATASETS))


def method_folder_files(files: DataFrame) -> DataFrame:
    """Files under ``dataset/task/seedN/method/``; a dataset without tasks has its own name as task."""
    part = lambda i: F.regexp_extract("place", METHOD_FOLDERS, i)
    placed = files.withColumn("place", F.array_join("path", "/")).where(F.regexp_like("place", F.lit(METHOD_FOLDERS)))
    task = F.when(part(1) == "bbh", F.concat(F.lit("bbh_"), part(2))).otherwise(part(1))
    told = placed.withColumns({"method": part(4), "task": task, "seed": part(3).cast("long"), "scores": part(5) == "summary"})
    return told.where((part(1) == "bbh") | (part(1) == part(2)))


def runs_of(files: DataFrame, methods: Sequence[str] | None = None) -> DataFrame:
    """One row a run of what either of its files says; runs of which neither can be read are left out.

    Files meet by an aggregate, which is a full outer join of a key with itself. A score of 0 in the first
    place gives way to the accuracy, as an elapsed time of 0 does to the other file's.
    """
    wanted = files.where(F.col("method").isin(*methods)) if methods else files
    told = wanted.where(F.col("_corrupt").isNull())
    of = lambda c, scores: F.max(F.when(F.col("scores") == scores, c))
    other_than_0 = lambda c: F.nullif(F.col(c), F.lit(0.0))

    def known(c: Column, kind: str = "long") -> Column:
        return F.coalesce(c, F.lit(0).cast(kind))

    score = F.coalesce(other_than_0("primary_metric"), F.col("metrics.accuracy"))
    return told.groupBy("method", "task", "seed").agg(
        known(of(score, True), "double").alias("test_score"), known(of(F.col("best_score"), False), "double").alias("best_score"),
        F.coalesce(of(F.col("best_prompt"), False), F.lit("")).alias("best_prompt"),
        F.coalesce(of(other_than_0("elapsed_seconds"), False), of(F.col("elapsed_seconds"), True), F.lit(0.0)).alias("total_time"),
        known(of(F.col("num_generations"), False), "int").alias("num_iterations"), known(of(F.col("total_llm_calls"), False)).alias("calls"),
        known(of(F.col("token_usage.total_tokens"), True)).alias("tokens"), known(of(F.col("token_usage.prompt_tokens"), True)).alias("prompt_tokens"),
        known(of(F.col("token_usage.completion_tokens"), True)).alias("completion_tokens"), F.coalesce(of(F.col("model"), True), F.lit("")).alias("model"),
    )


def read_seed_folders(spark: SparkSession, root: str, methods: Sequence[str] | None = None) -> DataFrame:
    """Runs kept as ``method_seedN`` folders, each with a file of metrics and one of the optimisation."""
    return runs_of(seed_folder_files(scanned(spark, root, "*_seed*_{metrics,optimization}.json", FILE)), methods)


def read_method_folders(spark: SparkSession, root: str, methods: Sequence[str] | None = None) -> DataFrame:
    """Runs kept as ``seedN/method`` folders, each with a summary and a history."""
    return runs_of(method_folder_files(scanned(spark, root, "{summary,history}.json", FILE)), methods)
