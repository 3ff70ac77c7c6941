"""Queries over readers and writers: what is written in their formats and read again, beside its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as C
from ..functions import text as X
from ..sources import datasets as D
from ..sources import legacy as L
from ..sources import results as R
from ..sources.fixtures import PROMPTS_SQL, named, prompts, runs, table, with_runs
from ..sources.storage import cut, remove_folder, shared_folder, spread
from ..sources.tree_source import FORMAT, register

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def read_again(spark: SparkSession, name: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` gives of what ``write`` has put into a shared folder, which is deleted then."""
    folder = shared_folder(spark, name)
    try:
        write(folder)
        return cut(read(folder))
    finally:
        remove_folder(spark, folder)


def _array_file(rows: DataFrame, *columns: str) -> Callable[[str], None]:
    """Writes a small table (the benchmark's items are a fixed number) as one JSON array."""
    return lambda folder: rows.agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value")).coalesce(1).write.text(folder)


@query("result_tree", with_runs("select model, method, task, seed, best_dev as best_score, nullif(test_score, 0) as test_score, method || ' on ' || task as best_prompt, calls, cast(tokens as bigint) as tokens from runs"))
def _(s, d):
    made = runs(s, d).select("model", "method", "task", "seed", F.col("best_dev").alias("best_score"), "test_score", F.concat_ws(" on ", "method", "task").alias("best_prompt"), "calls", F.col("tokens").cast("long").alias("tokens"))
    read = read_again(s, "results", lambda f: R.write_results(made, f), lambda f: R.read_results(s, f))
    return read.select("model", "method", "task", "seed", "best_score", "test_score", "best_prompt", "calls", "tokens")


@query("audit_tree", named("prompts", PROMPTS_SQL, "select 'run' || record_id // 64 as run_id, 'p' || record_id as id, text, score, list_transform(parent_ids, lambda p: 'p' || p)[1] as first_parent, cast(len(parent_ids) as integer) as parents, operator, generation as generation_created, true as is_complete from prompts"))
def _(s, d):
    p = prompts(s, d)
    made = p.select(
        F.concat(F.lit("run"), F.floor(F.col("record_id") / 64)).alias("run_id"), F.concat(F.lit("p"), "record_id").alias("id"), "text", "score",
        F.transform("parent_ids", lambda x: F.concat(F.lit("p"), x)).alias("parent_ids"), "operator", F.col("generation").alias("generation_created"),
    )
    read = read_again(s, "audit", lambda f: R.write_audit(made, f), lambda f: R.read_records(s, f))
    return read.select("run_id", "id", "text", "score", F.try_element_at("parent_ids", F.lit(1)).alias("first_parent"), F.size("parent_ids").alias("parents"), "operator", "generation_created", "is_complete")


@query("generation_csv", """with g as (select user_id as generation, round(max(value), 4) as best_score, round(avg(value), 4) as mean_score, count(*) as population_size from events group by all)
select cast(generation as varchar) as generation, best_score, mean_score, cast(population_size as integer) as population_size, cast(null as double) as test_score from g union all select 'final', 100.0, null, null, 0.5""")
def _(s, d):
    g = table(s, d, "events").groupBy(F.col("user_id").alias("generation")).agg(F.round(F.max("value"), 4).alias("best_score"), F.round(F.avg("value"), 4).alias("mean_score"), F.count("*").alias("population_size"))
    snapshots = g.withColumns({"best_record_id": F.lit("r"), "operator_counts": F.create_map(F.lit("x"), F.lit(1)), "timestamp": F.lit("2026-01-01T00:00:00")})
    final = s.createDataFrame([(100.0, "2026-01-01T00:00:00", 0.5)], "best_score double, timestamp string, test_score double")
    schema = "generation string, best_score double, mean_score double, population_size int, best_record_id string, operator_counts string, timestamp string, test_score double"
    read = read_again(s, "generations", lambda f: R.write_generations(snapshots, f, final), lambda f: s.read.schema(schema).option("header", True).option("escape", '"').csv(f))
    return read.select("generation", "best_score", "mean_score", "population_size", "test_score")


@query("json_samples", "select text as input, cast(item_id as varchar) as target from benchmark where length(text) > 0")
def _(s, d):
    items = table(s, d, "benchmark").select(F.col("text").alias("question"), F.col("item_id").cast("string").alias("answer"))
    return read_again(s, "samples", _array_file(items, "question", "answer"), lambda f: D.load_dataset(s, "JSON", f)).select("input", "target")


@query("gsm8k_samples", "select text as input, cast(item_id * 1000 + 7 as varchar) as target from benchmark where length(text) > 0")
def _(s, d):
    number = F.format_number(F.col("item_id") * 1000 + 7, 0)
    items = table(s, d, "benchmark").select(F.col("text").alias("question"), F.concat(F.lit("First 3, then\n#### "), number).alias("answer"))
    return read_again(s, "gsm8k", _array_file(items, "question", "answer"), lambda f: D.load_dataset(s, "gsm8k", f)).select("input", "target")


@query("mmlu_pro_samples", "select text || chr(10) || '(A) ' || item_id || chr(10) || '(B) none' as input, case when item_id % 2 = 0 then 'A' else 'B' end as target from benchmark where item_id % 3 <> 0 and length(text) > 0")
def _(s, d):
    n = F.col("item_id")
    items = table(s, d, "benchmark").select(F.col("text").alias("question"), F.array(n.cast("string"), F.lit("none")).alias("options"), F.when(n % 2 == 0, "a").otherwise("B").alias("answer"), F.when(n % 3 == 0, "law").otherwise("Math").alias("category"))
    return read_again(s, "mmlu", _array_file(items, "question", "options", "answer", "category"), lambda f: D.load_dataset(s, "mmlu_pro", f, category="math")).select("input", "target")


@query("json_split_counts", """with n as (select count(*) as n from orders), t as (select n, greatest(3, n // 5) as train from n)
select split, cast(rows as bigint) as rows from (select 'train' as split, train as rows from t union all select 'test', (n - train) // 2 from t union all select 'dev', n - train - (n - train) // 2 from t) where rows > 0""")
def _(s, d):
    samples = table(s, d, "orders").select(F.lit("d").alias("dataset"), F.col("o_orderkey").cast("string").alias("input"), F.lit("t").alias("target"), F.col("o_orderkey").alias("sample_id"))
    return D.split_by_seed(samples, json_style=True).groupBy("split").agg(F.count("*").alias("rows"))


@query("prompt_by_sample", "select r_regionkey as record_id, item_id as sample_id, r_name || '.' || chr(10) || chr(10) || text as prompt from region cross join benchmark")
def _(s, d):
    records = table(s, d, "region").select(F.col("r_regionkey").alias("record_id"), F.concat("r_name", F.lit(".")).alias("text"))
    items = table(s, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("input"))
    return items.crossJoin(F.broadcast(records)).select("record_id", "sample_id", X.evaluation_prompt(F.col("text"), F.col("input")).alias("prompt"))


@query("detected_datasets", """select n_nationkey as id, case n_nationkey % 4 when 0 then 'bbh/navigate' when 1 then 'gsm8k' when 2 then 'bbh/snarks' end as dataset from nation""")
def _(s, d):
    k = F.col("n_nationkey") % 4
    name = F.when(k == 0, F.concat(F.lit("run_navigate_"), F.lower("n_name"))).otherwise(F.lower("n_name"))
    path = F.when(k == 1, F.lit("/out/GSM8K/f.json")).when(k == 2, F.lit("/out/snarks/f.json")).otherwise(F.lit("/out/f.json"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("id"), R.detected_dataset(name, path, D.BBH_TASKS).alias("dataset"))


@query("code_and_truncation", """select l_orderkey as id, l_linenumber as line, 'x = ' || l_partkey || chr(10) as code, l_linenumber % 3 = 0 as empty, l_linenumber % 3 = 2 as truncated from lineitem""")
def _(s, d):
    i = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = F.col("l_linenumber") % 3
    reply = F.when(k == 0, F.lit(" \n")).when(k == 1, F.concat(F.lit("a long way to go, and so on: the answer is "), "l_partkey")).otherwise(F.lit("a long way to go, and so on, and on"))
    code = F.concat(F.lit("Here:\n```python\nx = "), "l_partkey", F.lit("\n```\nand\n```\ny\n```"))
    return i.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), C.code_block(code).alias("code"), C.is_empty_reply(reply).alias("empty"), C.is_truncated(reply, F.lit(10)).alias("truncated"))


@query("score_by_type", "select l_orderkey as id, l_linenumber as line, t.task_type, cast(l_partkey % 2 = 0 as integer) as score from lineitem, (select unnest(['math', 'mcq', 'boolean', 'auto']) as task_type) t where true")
def _(s, d):
    i = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    right = F.col("l_partkey") % 2 == 0
    cases = {"math": ("#### 7", "7", "8"), "mcq": ("(B)", "B", "C"), "boolean": ("The answer is yes", "yes", "no"), "auto": ("The answer is 12", "12", "13")}
    scored = [C.score(t, F.lit(said), F.when(right, yes).otherwise(no)).alias(t) for t, (said, yes, no) in cases.items()]
    return spread(i).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *scored).unpivot(["id", "line"], list(cases), "task_type", "score")


@query("operator_scores", named("prompts", PROMPTS_SQL, "select operator || chr(8211) || 'é' as operator, count(*) as n, round(avg(dev), 6) as mean, round(coalesce(stddev_samp(dev), 0), 6) as std from prompts where dev is not null and record_id % 3 <> 2 group by operator"))
def _(s, d):
    p = prompts(s, d).where("record_id % 3 <> 2")  # two of three runs are of the task
    record = F.struct(F.concat("operator", F.lit("–é")).alias("operator"), F.create_map(F.lit("dev"), F.col("dev")).alias("scores"))
    runs_of = p.groupBy(F.col("record_id") % 3, F.floor(F.col("record_id") / 64)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("record_id").cast("string"), record))).alias("records"), F.min("record_id").alias("run"))
    text = F.to_json(F.struct(F.struct("records").alias("history")))
    # half of the files are UTF-8, half are of one byte a character, where a dash is 0x96
    one_byte = F.encode(F.translate(text, "–", "\x96"), "ISO-8859-1")
    files = runs_of.select(F.concat(F.lit("/out/navigate/audit_"), "run").alias("path"), F.when(F.col("run") % 2 == 0, F.encode(text, "UTF-8")).otherwise(one_byte).alias("content"))
    made = R.operator_scores(files, task="navigate")
    return made.select("operator", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("older_layouts", with_runs("""select method, 'bbh_' || task as task, seed, test_score, best_dev as best_score, cast(calls as bigint) as calls, cast(tokens as bigint) as tokens
from (select 'm' || row_number() over (order by model, method, task, seed) as method, 't' || seed as task, seed, case when seed % 3 = 0 then 0 else test_score end as test_score, case when seed % 3 = 1 then 0 else best_dev end as best_dev, case when seed % 3 = 1 then 0 else calls end as calls, case when seed % 3 = 0 then 0 else tokens end as tokens from runs)"""))
def _(s, d):
    r = runs(s, d).withColumn("m", F.concat(F.lit("m"), F.row_number().over(W.orderBy("model", "method", "task", "seed"))))  # some hundreds of runs
    scores, search = F.col("seed") % 3 != 0, F.col("seed") % 3 != 1
    path = lambda kind: F.array(F.lit("bbh"), F.concat(F.lit("t"), "seed"), F.concat(F.lit("seed"), "seed"), F.col("m"), F.lit(f"{kind}.json"))
    usage = F.struct(F.col("tokens").cast("long").alias("total_tokens"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    summary = r.where(scores).select(path("summary").alias("path"), F.lit(0.0).alias("primary_metric"), F.struct(F.col("test_score").alias("accuracy")).alias("metrics"), usage.alias("token_usage"), F.lit("x").alias("model"), none("double", "best_score"), none("string", "best_prompt"), none("double", "elapsed_seconds"), none("int", "num_generations"), none("long", "total_llm_calls"), none("string", "_corrupt"))
    history = r.where(search).select(path("history").alias("path"), F.col("best_dev").alias("best_score"), F.lit("p").alias("best_prompt"), F.col("calls").alias("total_llm_calls"))
    files = L.method_folder_files(summary.unionByName(history, allowMissingColumns=True))
    return L.runs_of(files).select("method", "task", "seed", "test_score", "best_score", "calls", "tokens")


@query("packed_cases", "select item_id, '[{\"input\": \"' || item_id || '\"}]' as cases from benchmark where item_id % 2 = 0 union all select item_id, null from benchmark where item_id % 2 = 1")
def _(s, d):
    n = F.col("item_id").cast("string")
    plain = F.concat(F.lit('[{"input": "'), n, F.lit('"}]'))
    return table(s, d, "benchmark").select("item_id", D.unpacked(F.when(F.col("item_id") % 2 == 0, plain).otherwise("not a stream")).alias("cases"))


def _object_file(rows: DataFrame, field: str, *columns: str) -> Callable[[str], None]:
    """Writes a small table as one JSON object that holds it under ``field``."""
    return lambda folder: rows.agg(F.to_json(F.struct(F.collect_list(F.struct(*columns)).alias(field))).alias("value")).coalesce(1).write.text(folder)


@query("bbh_samples", "select 'bbh/navigate' as dataset, text as input, case when item_id % 2 = 0 then 'Yes' else 'No' end as target from benchmark where length(text) > 0")
def _(s, d):
    items = table(s, d, "benchmark").select(F.col("text").alias("input"), F.when(F.col("item_id") % 2 == 0, "Yes").otherwise("No").alias("target"))
    return read_again(s, "bbh", _object_file(items, "examples", "input", "target"), lambda f: D.load_dataset(s, "BBH", f, task="navigate")).select("dataset", "input", "target")


@query("livebench_math_samples", "select text as input, 'x^' || item_id as target from benchmark where item_id % 3 = 1 and length(text) > 0")
def _(s, d):
    n = F.col("item_id")
    items = table(s, d, "benchmark").select(F.array("text", F.lit("and then?")).alias("turns"), F.concat(F.lit("x^"), n).alias("ground_truth"), F.when(n % 3 == 1, "AMPS_Hard").otherwise("olympiad").alias("task"))
    return read_again(s, "livebench", _array_file(items, "turns", "ground_truth", "task"), lambda f: D.load_dataset(s, "livebench/math", f, task="AMPS_Hard")).select("input", "target")


@query("svamp_samples", "select concat_ws(' ', text, 'How many?') as input, case when item_id % 2 = 0 then cast(item_id as varchar) else item_id || '.5' end as target from benchmark")
def _(s, d):
    n = F.col("item_id")
    items = table(s, d, "benchmark").select(F.col("text").alias("Body"), F.lit("How many?").alias("Question"), (n + F.when(n % 2 == 0, 0.0).otherwise(0.5)).alias("Answer"))
    return read_again(s, "svamp", _array_file(items, "Body", "Question", "Answer"), lambda f: D.load_dataset(s, "svamp", f)).select("input", "target")


@query("humaneval_samples", "select 'def f' || item_id || '():' as input, case when item_id % 2 = 0 then null else 'f' || item_id end as entry_point, case when item_id % 2 = 0 then '    return ' || item_id end as solution from benchmark")
def _(s, d):
    n = F.col("item_id")
    items = table(s, d, "benchmark").select(
        F.concat(F.lit("def f"), n, F.lit("():")).alias("prompt"), F.lit("assert candidate()").alias("test"), F.concat(F.lit("f"), n).alias("entry_point"),
        F.concat(F.lit("    return "), n).alias("canonical_solution"), F.when(n % 2 == 0, "train").otherwise("test").alias("split"),
    )
    read = read_again(s, "humaneval", _array_file(items, "prompt", "test", "entry_point", "canonical_solution", "split"), lambda f: D.load_dataset(s, "HumanEval", f))
    train = F.col("split") == "train"
    return read.select("input", F.when(~train, F.get_json_object("target", "$.entry_point")).alias("entry_point"), F.when(train, F.col("target")).alias("solution"))


@query("livebench_coding_samples", "select text as input, cast(1 + case item_id % 3 when 2 then 0 else 1 end as integer) as cases, case item_id % 3 when 2 then null else 'p' || item_id end as private_input from benchmark where length(text) > 0")
def _(s, d):
    @F.pandas_udf("string")
    def packed(plain):  # as the files hold them: base64 of a zlib stream of a pickled text
        import base64
        import pickle
        import zlib

        return plain.map(lambda t: base64.b64encode(zlib.compress(pickle.dumps(t))).decode())

    n = F.col("item_id")
    case = lambda text: F.to_json(F.array(F.struct(text.alias("input"), F.lit("1").alias("output"), F.lit("stdin").alias("testtype"))))
    private = case(F.concat(F.lit("p"), n))
    items = table(s, d, "benchmark").select(
        F.col("text").alias("question_content"), case(F.concat(F.lit("q"), n)).alias("public_test_cases"),
        F.when(n % 3 == 0, private).when(n % 3 == 1, packed(private)).otherwise("no stream").alias("private_test_cases"),
    )
    read = read_again(s, "coding", _array_file(items, "question_content", "public_test_cases", "private_test_cases"), lambda f: D.load_dataset(s, "livebench_coding", f))
    cases = F.from_json(F.get_json_object("target", "$.test_cases"), "array<struct<input:string>>")
    return read.select("input", F.size(cases).alias("cases"), F.get(cases, F.lit(1))["input"].alias("private_input"))


@query("result_tree_since", with_runs("select 'past' as since, method, count(*) as runs from runs group by method"))
def _(s, d):
    made = runs(s, d).select("model", "method", "task", "seed", F.col("best_dev").alias("best_score"), "test_score", "calls", F.col("tokens").cast("long").alias("tokens"))

    def read(folder):
        since = {"past": "2000-01-01T00:00:00", "future": "2900-01-01T00:00:00"}
        past, future = (R.read_results(s, folder, modified_after=at).groupBy(F.lit(name).alias("since"), "method").agg(F.count("*").alias("runs")) for name, at in since.items())
        return past.unionByName(future)

    return read_again(s, "since", lambda f: R.write_results(made, f), read)


@query("benchmark_summary", with_runs("select model, method, task, seed, method || repeat('x', 200 - length(method)) as best_prompt, best_dev as best_score, test_score from runs"))
def _(s, d):
    made = runs(s, d).withColumns({"best_prompt": F.concat("method", F.repeat(F.lit("x"), F.lit(300))), "best_score": F.col("best_dev")})
    return R.summary(made)


@query("sweep_upserted", with_runs("select model, method, task, seed, case when seed % 2 = 0 then calls + 1000 else calls end as calls, case when seed % 2 = 0 then 'again' else 'first' end as written from runs"))
def _(s, d):
    keys = ["model", "method", "task", "seed"]
    first = runs(s, d).select(*keys, "calls", F.lit("first").alias("written"))
    again = runs(s, d).where("seed % 2 = 0").select(*keys, (F.col("calls") + 1000).alias("calls"), F.lit("again").alias("written"))

    def write(folder):
        R.upsert(first, folder, keys)
        for _ in range(2):  # half of the cells come again, and the sweep is resumed once
            R.upsert(again.unionByName(again.withColumn("calls", F.col("calls") - 500)), folder, keys, newest="calls")

    return read_again(s, "sweep", write, lambda f: R.read_keyed(s, f))


@query("result_source", with_runs("""select model, method, task, seed, best_dev as best_score, nullif(test_score, 0) as test_score, method || ' on ' || task as best_prompt, calls, cast(tokens as bigint) as tokens
from runs where seed in (select min(seed) from runs union select max(seed) from runs) and test_score > 0.3"""))
def _(s, d):
    register(s)
    made = runs(s, d).select("model", "method", "task", "seed", F.col("best_dev").alias("best_score"), "test_score", F.concat_ws(" on ", "method", "task").alias("best_prompt"), "calls", F.col("tokens").cast("long").alias("tokens"))
    ends = made.agg(F.min("seed").alias("a"), F.max("seed").alias("b")).first()
    read = read_again(s, "source", lambda f: R.write_results(made, f), lambda f: s.read.format(FORMAT).load(f).where(F.col("seed").isin(ends["a"], ends["b"]) & (F.col("test_score") > 0.3)))
    return read.select("model", "method", "task", "seed", "best_score", "test_score", "best_prompt", "calls", "tokens")
