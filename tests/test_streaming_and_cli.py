import json
import math
import random

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from promptloom import cli
from promptloom.operators import select as S
from promptloom.sources import results as R
from promptloom.sources import tree_source as T
from promptloom.streaming import outcomes as O
from promptloom.streaming.racing import advanced


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    made = O.snapshots(O.stream(spark, str(tmp_path / "in"), events.schema, files=1), late="3650 days")
    q = made.writeStream.outputMode("complete").format("memory").queryName("pl_snapshots").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("pl_snapshots").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("start"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got == want
    for _ in range(2):
        O.write_once(O.stream(spark, str(tmp_path / "in"), events.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_cli_lists_and_runs(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and len(json.loads(capsys.readouterr().out)["methods"]) == 29
    assert cli.main(["query", "usage_merge", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q")).count() == 5
    (tmp_path / "d.json").write_text(json.dumps([{"input": f"q{i}", "target": "yes"} for i in range(40)]))
    (tmp_path / "c.json").write_text(json.dumps({"dataset": {"name": "json", "path": str(tmp_path / "d.json")}, "method": "baseline_seed", "prompts": ["Say yes."], "task_type": "text"}))
    assert cli.main(["run", str(tmp_path / "c.json")]) == 0 and "best_prompt" in capsys.readouterr().out


def test_weighted_sample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 10, 1000.0).when(F.col("id") < 900, 1.0).otherwise(0.0).alias("w"))
    got = {r["id"] for r in S.weighted_sample(df, "w", 10, "id", 1).collect()}
    assert len(got) == 10 and len([i for i in got if i < 10]) >= 6 and not any(i >= 900 for i in got)


def test_races_end_alike_in_any_order():
    rng = random.Random(3)
    for _ in range(60):
        outcomes = {n: float(rng.random() < 0.5) for n in range(1, 60)}
        right, want = 0.0, None
        for n, c in outcomes.items():
            right += c
            if want is None and n >= 10 and right / n + math.sqrt(math.log(40) / (2 * n)) < 0.75:
                want = n
        order = rng.sample(sorted(outcomes), 59)
        state = (1, 0.0, None, [], [])
        for at in range(0, 59, 7):  # batches share two outcomes each
            state = advanced(state, {n: outcomes[n] for n in order[at : at + 9]}, 0.75, 10, 0.05)
        assert state[2] == want


def test_upsert_keeps_other_rows_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    R.upsert(spark.createDataFrame([(1, 1.0), (2, 2.0), (None, 3.0)], "k int, v double"), path, ["k"], buckets=2)
    R.upsert(spark.createDataFrame([(None, 4.0), (2, None), (2, 1.0), (5, 9.0)], "k int, v double"), path, ["k"], newest="v", buckets=2)
    assert {(r["k"], r["v"]) for r in R.read_keyed(spark, path).collect()} == {(1, 1.0), (2, 1.0), (None, 4.0), (5, 9.0)}
    R.upsert(spark.createDataFrame([], "k int, v double"), path, ["k"], buckets=2)
    assert R.read_keyed(spark, path).count() == 4


def test_result_source_opens_only_the_cells_that_are_asked_for(spark, tmp_path):
    for place, text in {
        "m1/apex/navigate/seed_3/result_a.json": '{"best_score": 1, "test_score": 0, "llm_usage": {"total_calls": 4}}', "model=m%202/method=apex/task=x/seed=4/part-0.json": '{"test_score": 0.5}',
        "evo/x/seed5/result_b.json": "no json", "evo/x/none/result_c.json": "[]", "evo/x/seed5/notes.json": "{}",
    }.items():
        (tmp_path / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / place).write_text(text)
    root = str(tmp_path)
    T.register(spark)
    rows = {tuple(r) for r in spark.read.format(T.FORMAT).load(root).collect()}
    assert rows == {
        ("m1", "apex", "navigate", 3, 1.0, None, None, 4, 0, None), ("m 2", "apex", "x", 4, None, 0.5, None, 0, 0, None),
        ("default", "evo", "x", 5, None, None, None, 0, 0, "no json"), ("default", "evo", "x", None, None, None, None, 0, 0, "[]"),
    }
    reader = T.ResultReader(root, 1, "default")
    left = list(reader.pushFilters([EqualTo(("method",), "apex"), In(("seed",), (4, 5)), GreaterThan(("test_score",), 0.1)]))
    assert left == [GreaterThan(("test_score",), 0.1)] and [c for p in reader.partitions() for _, c in p.found] == [("m 2", "apex", "x", 4)]
    some = spark.read.format(T.FORMAT).option("files", 1).load(root).where("method = 'evo' and seed = 5")
    assert [r["load_error"] for r in some.collect()] == ["no json"]
    (tmp_path / "empty").mkdir()
    assert spark.read.format(T.FORMAT).load(str(tmp_path / "empty")).count() == 0
