"""Result and audit trees: scans that turn paths into columns, and the writers of the same files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = (
    "method_name string, dataset_name string, best_prompt string, best_score double, test_score double, "
    "optimization_history array<struct<generation:int,best_score:double,mean_score:double,population_size:int,best_record_id:string,operator_counts:map<string,int>,timestamp:string>>, "
    "llm_usage struct<total_calls:long,total_input_tokens:long,total_output_tokens:long,total_tokens:long,total_time:double>, total_time double, num_iterations int, _corrupt string"
)
RECORD = (
    "struct<id:string,text:string,text_hash:string,score:double,scores:map<string,double>,parent_ids:array<string>,operator:string,operator_params:map<string,string>,"
    "generation_created:int,generation_last_active:int,metadata:map<string,string>,performance_vector:array<int>,is_complete:boolean>"
)
AUDIT = f"history struct<run_id:string,method_name:string,dataset_name:string,started_at:string,records:map<string,{RECORD}>>, _corrupt string"


def scanned(spark: SparkSession, root: str, pattern: str, schema: str, modified_after: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    reader = reader.option("modifiedAfter", modified_after) if modified_after else reader
    df = reader.json(root)
    below = F.element_at(F.split("_metadata.file_path", F.regexp_replace(F.lit(root.rstrip("/").split(":")[-1]), r"([^\w/])", r"\\$1")), -1)
    # paths come as URIs; folders of a partitioned writer are named column=value, with a value that is encoded once more
    decoded = lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
    column = r"^(?:model|method|task|seed)="
    named = lambda p: F.when(F.regexp_like(p, F.lit(column)), decoded(F.regexp_replace(p, column, ""))).otherwise(p)
    return df.withColumn("path", F.transform(F.filter(F.split(below, "/"), lambda p: p != ""), lambda p: named(F.coalesce(decoded(p), p))))


def read_results(spark: SparkSession, root: str, methods: list[str] | None = None, modified_after: str | None = None, default_model: str = "default") -> DataFrame:
    """One row a result file: model, method, task and seed come from a path of 4 or 5 parts.

    ``load_error`` tells files that are not JSON; those of methods that are not asked for are left out.
    """
    df = scanned(spark, root, "{result_*,part-*}.json", RESULT, modified_after)
    five = F.size("path") >= 5
    part = lambda i: F.get(F.col("path"), F.when(five, i).otherwise(i - 1))
    usage = lambda n: F.coalesce(F.col(f"llm_usage.{n}"), F.lit(0))
    made = df.select(
        F.when(five, F.get("path", F.lit(0))).otherwise(default_model).alias("model"), part(1).alias("method"), part(2).alias("task"),
        F.regexp_extract(F.coalesce(part(3), F.lit("")), r"(\d+)$", 1).try_cast("long").alias("seed"),
        "best_score", F.nullif("test_score", F.lit(0.0)).alias("test_score"), "best_prompt", usage("total_calls").alias("calls"), usage("total_tokens").alias("tokens"),
        "total_time", "num_iterations", "optimization_history", F.col("_corrupt").alias("load_error"),
    )
    return made.where(F.col("method").isin(methods) | F.col("load_error").isNotNull()) if methods else made


def trajectories(results: DataFrame) -> DataFrame:
    """One row for each generation of each run."""
    return results.select("model", "method", "task", "seed", F.explode("optimization_history").alias("g")).select("model", "method", "task", "seed", "g.*").withColumn("at", F.try_to_timestamp("timestamp"))


def read_records(spark: SparkSession, root: str, task: str | None = None) -> DataFrame:
    """One row for each prompt record of each audit file; missing keys have their defaults."""
    df = scanned(spark, root, "{audit_*,part-*}.json", AUDIT)
    df = df.where(F.contains(F.array_join("path", "/"), F.lit(task))) if task else df
    r = df.select("history.run_id", F.explode(F.map_values("history.records")).alias("r")).select("run_id", "r.*")
    return r.withColumns({"parent_ids": F.coalesce("parent_ids", F.array().cast("array<string>")), "operator": F.coalesce("operator", F.lit("seed")), "is_complete": F.coalesce("is_complete", F.lit(True)), "dev": F.col("scores")["dev"]})


def _windows_characters() -> tuple[str, str]:
    """The controls of Latin-1 that Windows-1252 uses for characters, and those characters."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs if c)


def decoded(content: Column) -> Column:
    """The text of a file: UTF-8 where it is valid, else Windows-1252 where all bytes have a meaning there, else Latin-1."""
    plain = F.decode(content, "ISO-8859-1")
    controls, characters = _windows_characters()
    unused = "[" + "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in controls) + "]"
    other = F.when(F.regexp_like(plain, F.lit(unused)), plain).otherwise(F.translate(plain, controls, characters))
    return F.coalesce(F.try_validate_utf8(content.cast("string")), other)


def method_root(folder: str, method: str) -> str | None:
    """The nearest folder at or above ``folder`` that has the method's name; None where there is none."""
    parts = folder.rstrip("/").split("/")
    at = max((i for i, part in enumerate(parts) if part == method), default=None)
    return None if at is None else "/".join(parts[: at + 1])


def operator_scores(files: DataFrame, operators: list[str] | None = None, task: str | None = None) -> DataFrame:
    """``operator, n, mean, std`` of the dev scores in audit files of any encoding (``path, content``); one score has no spread.

    ``task`` keeps files whose path names it. Files that are not JSON are left out.
    """
    wanted = files.where(F.contains("path", F.lit(task))) if task else files
    audit = F.from_json(decoded(F.col("content")), AUDIT.removesuffix(", _corrupt string"))
    r = wanted.select(F.explode(F.map_values(audit["history"]["records"])).alias("r")).select("r.operator", F.col("r.scores")["dev"].alias("dev"))
    kept = r.where(F.col("operator").isNotNull() & F.col("dev").isNotNull())
    kept = kept.where(F.col("operator").isin(operators)) if operators is not None else kept
    return kept.groupBy("operator").agg(F.count("*").alias("n"), F.avg("dev").alias("mean"), F.coalesce(F.stddev_samp("dev"), F.lit(0.0)).alias("std"))


def past_operator_scores(spark: SparkSession, folder: str, method: str, operators: list[str] | None = None, task: str | None = None) -> DataFrame | None:
    """``operator_scores`` of all earlier runs of a method in the experiment that ``folder`` belongs to."""
    root = method_root(folder, method)
    if root is None:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"audit_{method}_*.json").load(root)
    return operator_scores(files.select("path", "content"), operators, task)


def broken_results(results: DataFrame, least_best: float = 0.0) -> DataFrame:
    """Runs that have a prompt and a dev score but no test score."""
    return results.where((F.col("best_prompt") != "") & F.col("test_score").isNull() & (F.col("best_score") >= least_best))


def detected_dataset(name: Column, path: Column, tasks: list[str]) -> Column:
    """``dataset/task`` from a name, else from a path, else from the file's name; null where nothing tells."""
    known = "|".join(sorted(tasks, key=len, reverse=True))
    task = lambda c: F.nullif(F.regexp_extract(F.lower(c), f"({known})", 1), F.lit(""))
    other = lambda c: F.nullif(F.regexp_extract(F.lower(c), "(gsm8k|svamp|humaneval|livebench_math|livebench_coding|mmlu_pro)", 1), F.lit(""))
    bbh = lambda c: F.concat(F.lit("bbh/"), task(c))
    return F.coalesce(bbh(name), other(name), bbh(path), other(path))


def write_generations(snapshots: DataFrame, path: str, final: DataFrame | None = None) -> None:
    """Generation metrics as CSV: counts as JSON, and a last row with the test score where there is one."""
    columns = ["generation", "best_score", "mean_score", "population_size", "best_record_id", "operator_counts", "timestamp", "test_score"]
    rows = snapshots.withColumns({"generation": F.col("generation").cast("string"), "operator_counts": F.to_json("operator_counts"), "test_score": F.lit(None).cast("double")}).select(*columns)
    if final is not None:
        last = final.where("test_score is not null and test_score <> 0").select(F.lit("final").alias("generation"), "best_score", "timestamp", "test_score")
        rows = rows.unionByName(last, allowMissingColumns=True)
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_audit(records: DataFrame, path: str) -> None:
    """Records as audit documents, one file a run, in a folder of its own; ``read_records`` reads them again.

    A run has some thousands of records at most, which its document holds together.
    """
    wanted = [f.name for f in T.StructType.fromDDL(f"r {RECORD}")["r"].dataType.fields]
    record = F.struct(*(F.col(c) for c in wanted if c in records.columns))
    runs = records.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("id", record))).alias("records"))
    runs.select(F.struct("run_id", "records").alias("history")).write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """One result file a run, under folders of model, method, task and seed; ``read_results`` reads them again."""
    usage = F.struct(F.col("calls").alias("total_calls"), F.col("tokens").alias("total_tokens"))
    more = [c for c in ("best_prompt", "best_score", "test_score", "total_time", "num_iterations", "optimization_history") if c in results.columns]
    rows = results.select("model", "method", "task", "seed", *more, usage.alias("llm_usage"))
    rows.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("model", "method", "task", "seed").json(path)


def summary(results: DataFrame) -> DataFrame:
    """A benchmark summary, best first, prompts cut to 200 characters."""
    return results.select("model", "method", "task", "seed", F.substring("best_prompt", 1, 200).alias("best_prompt"), "best_score", "test_score").orderBy(F.desc_nulls_last("best_score"), "model", "method", "task", "seed")


def not_done(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of a sweep without a result."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(rows: DataFrame, path: str, keys: list[str], newest: str | None = None, buckets: int = 64) -> None:
    """Put ``rows`` into the keyed table at ``path``: of rows with a key that is there already, the new ones win.

    The table is Parquet in folders of a hash of the key (``bucket``). Only buckets that get rows are read and written again, by
    dynamic partition overwrite, and files are replaced when the job commits, so a lost executor costs its tasks only, and
    the same call made again changes nothing. Of new rows with one key the greatest by ``newest`` stays (null least), then by the other
    columns in their order. Null keys are keys. The number of buckets must stay that of the first call.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    order = [newest] if newest else []
    new = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    latest = new.groupBy("bucket", *keys).agg(F.max(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in rest))).alias("_r"))
    merged = latest.select(*keys, *(F.col(f"_r._{c}").alias(c) for c in rest), "bucket")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        touched = F.broadcast(new.select("bucket").distinct())  # at most ``buckets`` rows
        old = spark.read.schema(merged.schema).parquet(path).join(touched, "bucket", "left_semi")
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("bucket", *keys)]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        kept = old.alias("o").join(merged.alias("n"), condition, "left_anti").select(*merged.columns)
        merged = kept.unionByName(merged)
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``upsert`` keeps."""
    return spark.read.parquet(path).drop("bucket")
