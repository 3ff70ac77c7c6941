"""Readers of task datasets: each gives ``dataset, split, sample_id, input, target`` as rows.

Files are JSON (one array, or one object of splits) or Parquet. Splits are a column. ``split_by_seed``
deals rows that come without splits.
"""

from __future__ import annotations

import base64
import pickletools
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import task_type
from ..functions.text import found, strip
from ..operators import select as S
from ..operators.rank import numbered
from .storage import ship

# The tasks of BIG-Bench Hard, and the letters of options.
BBH_TASKS = (
    "boolean_expressions causal_judgement date_understanding disambiguation_qa dyck_languages formal_fallacies geometric_shapes hyperbaton "
    "logical_deduction_five_objects logical_deduction_seven_objects logical_deduction_three_objects movie_recommendation multistep_arithmetic_two navigate "
    "object_counting penguins_in_a_table reasoning_about_colored_objects ruin_names salient_translation_error_detection snarks sports_understanding "
    "temporal_sequences tracking_shuffled_objects_five_objects tracking_shuffled_objects_seven_objects tracking_shuffled_objects_three_objects web_of_lies word_sorting"
).split()
OPTION_LETTERS = "ABCDEFGHIJ"


def raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("multiLine", True).json(path)


def _either(df: DataFrame, *names: str) -> Column:
    """The first of these columns that there are and that is not null, as text."""
    return F.coalesce(*(F.col(n).cast("string") for n in names if n in df.columns), F.lit(None).cast("string"))


def _samples(df: DataFrame, dataset: str, sample: Column, target: Column, split: Column | None = None) -> DataFrame:
    rows = df.select(F.lit(dataset).alias("dataset"), (split if split is not None else F.lit(None).cast("string")).alias("split"), sample.alias("input"), target.alias("target"))
    rows = rows.where("length(input) > 0 and length(target) > 0")
    # the id is a matter of the content, so that it does not depend on partitions; samples that occur again are numbered
    again = F.row_number().over(W.partitionBy("split", "input", "target").orderBy("dataset")) - 1
    numbered = rows.withColumn("_again", again)
    return numbered.withColumn("sample_id", F.when(F.col("_again") == 0, F.xxhash64("input", "target")).otherwise(F.xxhash64("input", "target", "_again"))).drop("_again")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A flat list of samples, or an object of train, dev (or validation) and test lists."""
    df = raw(spark, path)
    splits = [c for c in ("train", "dev", "validation", "test") if c in df.columns]
    if not splits:
        return _samples(df, path, _either(df, "input", "question"), _either(df, "target", "answer"))
    parts = [df.select(F.lit("dev" if c == "validation" else c).alias("split"), F.explode(c).alias("s")).select("split", "s.*") for c in splits if not (c == "validation" and "dev" in splits)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return _samples(whole, path, _either(whole, "input", "question"), _either(whole, "target", "answer"), F.col("split"))


def read_bbh(spark: SparkSession, path: str, task: str = "") -> DataFrame:
    if task and task not in BBH_TASKS:
        raise ValueError(f"no such task: {task}")
    df = raw(spark, path)
    if "examples" in df.columns:
        df = df.select(F.explode("examples").alias("e")).select("e.*")
    return _samples(df, f"bbh/{task}", _either(df, "input", "question"), _either(df, "target", "answer"))


def read_livebench_math(spark: SparkSession, path: str, task: str = "") -> DataFrame:
    df = raw(spark, path)
    df = df.where(F.col("task") == task) if task else df
    return _samples(df, "livebench_math", F.try_element_at("turns", F.lit(1)), F.col("ground_truth").cast("string"))


def gsm8k_target(answer: Column) -> Column:
    """What stands after ``####`` without separators of thousands, else the text itself."""
    return F.coalesce(strip(F.replace(found(answer, r"####\s*([^\n]+)"), F.lit(","), F.lit(""))), strip(answer))


def read_gsm8k(spark: SparkSession, path: str) -> DataFrame:
    df = raw(spark, path)
    return _samples(df, "gsm8k", F.col("question"), gsm8k_target(F.col("answer")))


def svamp_target(value: Column) -> Column:
    """Whole numbers without a decimal point."""
    number = value.try_cast("double")
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(value.cast("string"))


def read_svamp(spark: SparkSession, path: str) -> DataFrame:
    df = raw(spark, path)
    return _samples(df, "svamp", F.concat_ws(" ", _either(df, "Body", "body"), _either(df, "Question", "question")), svamp_target(_either(df, "Answer", "answer")))


def read_humaneval(spark: SparkSession, path: str) -> DataFrame:
    """Targets are JSON of prompt, test and entry point; for train rows the canonical solution."""
    df = raw(spark, path)
    spec = F.to_json(F.struct("prompt", "test", "entry_point"))
    split = F.col("split") if "split" in df.columns else F.lit(None).cast("string")
    return _samples(df, "humaneval", F.col("prompt"), F.when(split == "train", F.col("canonical_solution")).otherwise(spec), split)


_CASES = "array<struct<input:string,output:string,testtype:string>>"


def packed_text(raw: str | None) -> str | None:
    """The text in a base64 of a zlib stream of a pickled string. The pickle is read as a list of steps and never run:
    only one that holds a single string and nothing else counts; null for all others."""
    try:
        steps = [(op.name, value) for op, value, _ in pickletools.genops(zlib.decompress(base64.b64decode(raw or "")))]
    except Exception:  # whatever is not such a stream
        return None
    held = [value for name, value in steps if name not in ("PROTO", "FRAME", "MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT", "STOP")]
    names = [name for name, _ in steps]
    return held[0] if len(held) == 1 and any("UNICODE" in name for name in names) else None


def unpacked(raw: Column) -> Column:
    """Test cases as JSON text, whether they come so or packed; what is JSON already does not go through Python."""

    @F.pandas_udf("string")
    def texts(packed: pd.Series) -> pd.Series:
        return packed.map(packed_text, na_action="ignore")

    plain = F.try_parse_json(raw).isNotNull()
    return F.coalesce(F.when(plain, raw), texts(F.when(~plain, raw)))


def read_livebench_coding(spark: SparkSession, path: str) -> DataFrame:
    """Public and private test cases together; packed private ones are unpacked without running their pickles."""
    ship(spark)
    df = raw(spark, path)
    df = df.withColumn("private_test_cases", unpacked(F.col("private_test_cases")))
    cases = F.filter(F.concat(*(F.coalesce(F.from_json(F.col(c), _CASES), F.array().cast(_CASES)) for c in ("public_test_cases", "private_test_cases"))), lambda c: c["input"].isNotNull())
    text = F.try_element_at("turns", F.lit(1)) if "turns" in df.columns else F.col("question_content")
    made = F.to_json(F.struct(cases.alias("test_cases"), F.coalesce(_either(df, "starter_code"), F.lit("")).alias("starter_code"), F.coalesce(_either(df, "func_name"), F.lit("")).alias("func_name")))
    return _samples(df, "livebench_coding", text, F.when(F.size(cases) > 0, made))


def lettered_options(options: Column) -> Column:
    letters = F.array(*map(F.lit, OPTION_LETTERS))
    return F.array_join(F.transform(F.slice(options, 1, len(OPTION_LETTERS)), lambda o, i: F.concat(F.lit("("), F.get(letters, i), F.lit(") "), o)), "\n")


def read_mmlu_pro(spark: SparkSession, path: str, category: str = "") -> DataFrame:
    df = raw(spark, path)
    df = df.where(F.lower("category") == category.lower()) if category else df
    return _samples(df, "mmlu_pro", F.concat(F.col("question"), F.lit("\n"), lettered_options(F.col("options"))), F.upper("answer"))


READERS: dict[str, Callable[..., DataFrame]] = {
    "bbh": read_bbh, "livebench_math": read_livebench_math, "livebench/math": read_livebench_math, "gsm8k": read_gsm8k, "svamp": read_svamp, "humaneval": read_humaneval,
    "livebench_coding": read_livebench_coding, "livebench/coding": read_livebench_coding, "livecodebench": read_livebench_coding,
    "mmlu_pro": read_mmlu_pro, "mmlu-pro": read_mmlu_pro, "mmlupro": read_mmlu_pro, "json": read_json,
}


def load_dataset(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Samples of a dataset by name; names are not case-sensitive."""
    if name.lower() not in READERS:
        raise ValueError(f"unknown dataset: {name}; there are {', '.join(sorted(READERS))}")
    return READERS[name.lower()](spark, path, **options)


def split_by_seed(samples: DataFrame, seed: int = 42, ratio: float = 0.0, json_style: bool = False, limit: int | None = None) -> DataFrame:
    """Splits for samples without them: the test rows by a fixed seed, the others by the run's."""
    total = samples.count()
    if json_style:
        samples = samples.orderBy(S.shuffled(samples, "sample_id", 42), "sample_id").limit(limit) if limit else samples
        train, _, test = S.json_split_sizes(total, limit)
    else:
        train, _, test = S.split_sizes(total, ratio)
    # places by the test's order, then the rest by the run's: no task sees all rows
    placed = numbered(samples.drop("split"), [S.shuffled(samples, "sample_id", 42), F.col("sample_id")], "_t")
    rest = placed.where(F.col("_t") > test).drop("_t")
    dealt = numbered(rest, [S.shuffled(rest, "sample_id", seed), F.col("sample_id")], "_r").withColumn("split", F.when(F.col("_r") <= train, "train").otherwise("dev")).drop("_r")
    return dealt.unionByName(placed.where(F.col("_t") <= test).drop("_t").withColumn("split", F.lit("test")))


def detected_type(samples: DataFrame, seq: str = "sample_id") -> DataFrame:
    """The task type that the first twenty targets suggest: one row."""
    first = samples.select(seq, "target").orderBy(seq).limit(20)
    return first.agg(task_type(F.transform(F.array_sort(F.collect_list(F.struct(seq, "target"))), lambda x: x["target"])).alias("task_type"))
