import base64
import json
import math
import pickle
import zlib

import pytest
from pyspark.sql import functions as F

from promptloom.functions import text as X
from promptloom.operators import analysis as A
from promptloom.operators import evaluate as E
from promptloom.operators import lineage as L
from promptloom.operators import select as S
from promptloom.operators.rank import front, rank_order, top_k
from promptloom.plans import catalogue
from promptloom.plans.budget import Budget, BudgetExceeded, load_config, merged
from promptloom.search import techniques
from promptloom.search.client import StubClient, generate, retry_delay
from promptloom.search.loop import Search
from promptloom.search.methods import METHODS, method
from promptloom.sources import datasets as D
from promptloom.sources import legacy
from promptloom.sources import results as R


def outcomes(spark, vectors):
    return spark.createDataFrame([(r, s, v) for r, vs in enumerate(vectors) for s, v in enumerate(vs)], "record_id long, sample_id long, correct int")


def test_power(spark):
    at = lambda p, n: spark.range(1).select(A.minimum_detectable(F.lit(p), F.lit(n)).alias("x")).first()["x"]
    assert 0.085 <= at(0.85, 115) <= 0.100 and at(0.75, 14) > 0.25 and at(0.5, 0) == 1.0
    assert at(0.5, 100) / at(0.5, 400) == pytest.approx(2, abs=1e-6) and at(0.0, 50) > 0


def test_racing_stops_the_hopeless(spark):
    t = spark.createDataFrame([(0, n, 0) for n in range(1, 41)] + [(1, n, 1) for n in range(1, 41)], "record_id long, n long, correct int")
    stops = {r["record_id"]: r["stop_n"] for r in E.racing(t, 0.9, batch=8).collect()}
    assert stops == {0: 8, 1: None}
    assert {r["record_id"]: r["evaluated"] for r in E.raced(t, E.racing(t, 0.9)).collect()} == {0: 10, 1: 40}


def test_calibration_and_retention(spark):
    assert [r["sample_id"] for r in E.calibrated_pool(outcomes(spark, [[1, 1, 0, 0], [1, 0, 1, 0]]), 2).orderBy("sample_id").collect()] == [1, 2]
    assert E.calibrated_pool(outcomes(spark, [[1, 1, 0, 0, 1], [1, 1, 0, 0, 0]]), 4).count() == 4
    ev = outcomes(spark, [[1, 1, 0], [1, 0, 1], [0, 0, 0], [1]])
    edges = spark.createDataFrame([(1, 0), (0, 2), (3, 0)], "child_id long, parent_id long")
    assert {(r["child_id"], r["parent_id"]): r["retention"] for r in E.retention(ev, edges).collect()} == {(1, 0): 0.5, (0, 2): 1.0, (3, 0): 0.5}


def test_fronts(spark):
    df = spark.createDataFrame([(0, 0.8, 10.0), (1, 0.8, 20.0), (2, 0.9, 30.0), (3, 0.7, 30.0), (4, 0.8, 10.0)], "id int, s double, c double")
    assert sorted(r["id"] for r in front(df, "s", "c").collect()) == [0, 2, 4]
    assert sorted(r["id"] for r in front(df, "s", "c", strict_both=True).collect()) == [0, 1, 2, 4]


def test_bandit_forces_the_young_and_ranks_the_rest(spark):
    pulls = spark.createDataFrame([("a", 0.5)] * 8 + [("b", 0.1)] * 4 + [(x, -1.0) for x in "cdefg" for _ in range(5)], "arm string, reward double")
    arms = spark.createDataFrame([(x,) for x in "abcdefgh"], "arm string")
    rows = S.chosen_arms(S.ucb1(S.pulls_summary(pulls, arms, "arm", "reward")), "arm").orderBy("place").collect()
    assert rows[0]["arm"] == "h" and rows[0]["forced"] and [r["arm"] for r in rows][1:3] == ["a", "b"] and len(rows) == 4


def test_rank_order_prefers_dev(spark):
    df = spark.createDataFrame([(0, None, 0.99), (1, 0.5, 0.5), (2, 0.5, 0.5)], "record_id long, dev double, score double")
    assert [r["record_id"] for r in top_k(df, 3, rank_order()).collect()] == [1, 2, 0]


def test_export_keeps_the_best_and_each_operator(spark):
    df = spark.createDataFrame([(i, i / 10, "x" if i else "seed") for i in range(5)], "record_id long, score double, operator string")
    rows = S.export_flags(df, 2).collect()
    assert {r["record_id"] for r in rows if r["keep_text"]} == {4, 3, 0} and {r["record_id"] for r in rows if r["keep_details"]} == {4}


def test_lineage_with_a_cycle(spark):
    df = spark.createDataFrame([(0, [2]), (1, [0]), (2, [1, 9])], "record_id long, parent_ids array<long>")
    got = {(r["start_id"], r["ancestor_id"]): r["depth"] for r in L.ancestors(df, df.where("record_id = 2")).collect()}
    assert got == {(2, 2): 0, (2, 1): 1, (2, 0): 2}


def test_split_sizes():
    assert S.split_sizes(250) == (8, 127, 115) and S.split_sizes(173) == (8, 50, 115) and S.split_sizes(100) == (3, 33, 64) and S.split_sizes(28, 0.5) == (8, 10, 10)
    assert S.json_split_sizes(15) == (3, 6, 6) and S.holdout_size(40) == 28 and E.phase_sizes(40) == [16, 20, 30, 40]


def test_small_statistics():
    s = A.bradley_terry([[0, 3, 3], [1, 0, 2], [1, 2, 0]])
    assert s[0] > s[1] == pytest.approx(s[2]) and sum(s) == pytest.approx(3)


def test_budget():
    now = [0.0]
    b = Budget(seconds=1000, calls=3, total_tokens=100, clock=lambda: now[0])
    assert b.new_tokens(40, 2, 512) == 30 and b.exhausted() is None
    now[0] = 830
    assert b.exhausted() is None and b.exhausted(search=True) == "time_reserved_for_finalize"
    b.spend(3, 50, 10)
    assert b.exhausted() == "calls"
    with pytest.raises(BudgetExceeded):
        b.new_tokens(1, 1, 1)
    assert retry_delay(0) == 2 and retry_delay(9) == 60 and retry_delay(1, retry_after=7) == 7


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("PL_MODEL", "m1")
    (tmp_path / "c.json").write_text('{"llm": {"name": "${PL_MODEL}", "key": "${PL_UNSET}"}, "seed": 1}')
    assert load_config(str(tmp_path / "c.json"), {"llm": {"key": "k"}}) == {"llm": {"name": "m1", "key": "k"}, "seed": 1}
    assert merged({"a": {"b": 1}}, {"a": 2}) == {"a": 2}
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.json"))


def test_dataset_readers(spark, tmp_path):
    (tmp_path / "flat.json").write_text('[{"input": "q1", "target": "yes"}, {"question": "q2", "answer": "no"}, {"input": "", "target": "x"}]')
    (tmp_path / "parts.json").write_text('{"train": [{"input": "a", "target": "1"}], "validation": [{"input": "b", "target": "2"}], "test": [{"input": "c", "target": "3"}]}')
    (tmp_path / "gsm.json").write_text('[{"question": "q", "answer": "so\\n#### 1,234"}, {"question": "r", "answer": " plain "}]')
    (tmp_path / "mmlu.json").write_text('[{"question": "q", "options": ["x", "y"], "answer": "b", "category": "Math"}]')
    (tmp_path / "code.json").write_text('[{"turns": ["do"], "public_test_cases": "[{\\"input\\": \\"1\\", \\"output\\": \\"2\\"}]", "private_test_cases": "gASV", "starter_code": ""}]')
    rows = D.load_dataset(spark, "JSON", str(tmp_path / "flat.json")).collect()
    assert {(r["input"], r["target"]) for r in rows} == {("q1", "yes"), ("q2", "no")}
    assert {r["split"] for r in D.read_json(spark, str(tmp_path / "parts.json")).collect()} == {"train", "dev", "test"}
    assert {r["target"] for r in D.load_dataset(spark, "gsm8k", str(tmp_path / "gsm.json")).collect()} == {"1234", "plain"}
    m = D.load_dataset(spark, "mmlu_pro", str(tmp_path / "mmlu.json"), category="math").first()
    assert m["input"] == "q\n(A) x\n(B) y" and m["target"] == "B"
    assert '"input":"1"' in D.load_dataset(spark, "livecodebench", str(tmp_path / "code.json")).first()["target"]
    assert D.detected_type(D.read_json(spark, str(tmp_path / "flat.json"))).first()["task_type"] == "boolean"
    with pytest.raises(ValueError):
        D.load_dataset(spark, "none", "x")
    dealt = D.split_by_seed(spark.range(30).select(F.lit("d").alias("dataset"), F.col("id").cast("string").alias("input"), F.lit("t").alias("target"), F.col("id").alias("sample_id")), json_style=True)
    assert {r["split"]: r["count"] for r in dealt.groupBy("split").count().collect()} == {"train": 6, "dev": 12, "test": 12}


def test_result_tree(spark, tmp_path):
    good = tmp_path / "m1" / "apex" / "bbh_navigate" / "seed7"
    good.mkdir(parents=True)
    (good / "result_a.json").write_text('{"best_prompt": "p", "best_score": 0.9, "test_score": 0.0, "llm_usage": {"total_calls": 3, "total_tokens": 9}, "optimization_history": [{"generation": 0, "best_score": 0.5, "timestamp": "2026-01-01T00:00:00"}, {"generation": 1, "best_score": 0.9, "timestamp": "bad"}]}')
    (good / "audit_apex.json").write_text('{"history": {"run_id": "r", "records": {"a": {"id": "a", "text": "t", "scores": {"dev": 0.5}, "operator": "x"}, "b": {"id": "b", "parent_ids": ["a"]}}}}')
    other = tmp_path / "swift" / "gsm8k" / "seed1"
    other.mkdir(parents=True)
    (other / "result_b.json").write_text("{broken")
    rows = {r["method"]: r for r in R.read_results(spark, str(tmp_path)).collect()}
    a = rows["apex"]
    assert (a["model"], a["task"], a["seed"], a["calls"], a["test_score"]) == ("m1", "bbh_navigate", 7, 3, None) and rows["swift"]["model"] == "default" and rows["swift"]["load_error"]
    results = R.read_results(spark, str(tmp_path), methods=["apex"]).where("load_error is null")
    assert R.broken_results(results).count() == 1
    assert [r["at"] is None for r in R.trajectories(results).orderBy("generation").collect()] == [False, True]
    records = {r["id"]: r for r in R.read_records(spark, str(tmp_path)).collect()}
    assert records["a"]["dev"] == 0.5 and records["b"]["operator"] == "seed" and records["b"]["parent_ids"] == ["a"] and records["b"]["is_complete"]
    assert R.read_records(spark, str(tmp_path), task="other").count() == 0
    snapshots = spark.createDataFrame([(0, 0.5, 0.4, 3, "a", {"x": 2}, "t")], "generation int, best_score double, mean_score double, population_size int, best_record_id string, operator_counts map<string,int>, timestamp string")
    final = spark.createDataFrame([(0.5, "t", 0.7)], "best_score double, timestamp string, test_score double")
    R.write_generations(snapshots, str(tmp_path / "csv"), final)
    assert {r["generation"]: r["operator_counts"] for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()}["final"] is None
    found = spark.range(1).select(R.detected_dataset(F.lit("run_navigate"), F.lit("/x/y"), D.BBH_TASKS).alias("a"), R.detected_dataset(F.lit("r"), F.lit("/out/gsm8k/f"), D.BBH_TASKS).alias("b")).first()
    assert tuple(found) == ("bbh/navigate", "gsm8k")


def samples(spark):
    rows = [(i, "train" if i < 4 else "dev" if i < 30 else "test", f"question {i}", ["yes", "no", "maybe"][i % 3]) for i in range(40)]
    return spark.createDataFrame(rows, "sample_id long, split string, input string, target string")


def test_generation_is_the_same_at_every_run(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "i int, prompt string")
    a, b = (sorted(map(tuple, generate(df.repartition(n), StubClient).collect())) for n in (1, 5))
    assert a == b and all(r[3] == 1 for r in a)


@pytest.mark.parametrize("name", ["baseline_seed", "apex", "gepa", "swift"])
def test_search_methods(spark, name):
    import dataclasses

    m = dataclasses.replace(method(name), generations=min(1, method(name).generations), operators=method(name).operators[:3])
    run = lambda: Search(spark, samples(spark), StubClient, m, "text", population=3).run(["Answer the question. Be brief.", "Say yes or no."])
    r = run()
    assert 0 <= r.best_score <= 1 and r.test_score is not None and r.records.count() >= 2
    if name != "baseline_seed":
        assert r.outcomes.count() > 0 and r.snapshots[0]["generation"] == 0
    if name == "swift":
        again = run()
        assert (again.best_prompt, again.best_score) == (r.best_prompt, r.best_score) and again.records.select("text").collect() == r.records.select("text").collect()


def searched(spark, **settings):
    import dataclasses

    rows = [(i, "train" if i < 4 else "dev" if i < 68 else "test", f"question {i}", "right") for i in range(70)]
    data = spark.createDataFrame(rows, "sample_id long, split string, input string, target string")
    wrong = lambda: StubClient(("wrong",))
    return Search(spark, data, wrong, dataclasses.replace(method("swift"), operators=("semantic_var",), generations=1, gate=False, **settings), "text", population=3)


def test_racing_asks_less_of_who_is_beaten(spark):
    counts = {}
    for racing in (False, True):
        s = searched(spark, racing=racing)
        s._add("One.", "seed", [], 0)
        s._add("Two.", "seed", [], 0)
        s._measure(list(s.records), 0.9)
        counts[racing] = s.evaluated
        assert s.raced_out == ({0, 1} if racing else set()) and set(s.scores.values()) == {0.0}
    assert counts[False] == 2 * 64 and 0 < counts[True] < counts[False]
    s = searched(spark, racing=True)
    s._add("One.", "seed", [], 0)
    s._measure(list(s.records), 0.0)  # nobody is beaten: all of dev
    assert s.evaluated == 64 and not s.raced_out


def test_leaders_are_asked_the_rest_of_dev(spark):
    s = searched(spark, racing=True, holdout=True)
    s._add("One.", "seed", [], 0)
    s._measure(list(s.records), 0.9)
    whole, before = s.samples.where("split = 'dev'").count(), s.outcomes.count()
    s._finalise()
    assert before < whole == s.outcomes.count() == s.outcomes.select("sample_id").distinct().count()
    s._finalise()  # nothing is left to ask
    assert s.outcomes.count() == whole


def test_pool_has_the_best_and_winners_of_bouts(spark):
    s = searched(spark)
    for i in range(8):
        s._add(f"Text {i}.", "x", [], 0)
    s.scores = {i: i / 10 for i in range(8)}
    s.outcomes = spark.createDataFrame([(i, 0, int(i == 2)) for i in range(8)], "record_id long, sample_id long, correct int")
    pool = [r["record_id"] for r in s._pool()]
    assert pool[0] == 7 and len(pool) == 3 == len(set(pool))
    known = spark.createDataFrame([(r["record_id"], r["text"], s.scores[r["record_id"]]) for r in s.records], "record_id long, text string, score double")
    shown = techniques.members(known, []).select(techniques.series()["best"]).first()[0]
    assert [line[:13] for line in shown.split("\n")] == [f"- Score 0.{i}00" for i in range(3, 8)]


def test_retention_decides_who_is_admitted(spark):
    for retention in (False, True):
        s = searched(spark, retention=retention)
        for text, parents in (("Parent.", []), ("Keeps.", [0]), ("Loses.", [0])):
            s._add(text, "x", parents, len(parents))
        right = {0: {1, 2}, 1: {1, 2}, 2: {3, 4}}
        s.outcomes = spark.createDataFrame([(r, i, int(i in right[r])) for r in right for i in range(6)], "record_id long, sample_id long, correct int")
        s.scores = {0: 2 / 6, 1: 2 / 6, 2: 2 / 6}
        if retention:
            s._admit(s.records[1:])
        assert s.not_admitted == ({2} if retention else set()) and set(s.scores) == ({0, 1} if retention else {0, 1, 2})
    s.scores = {0: 2 / 6, 2: 2 / 6}
    s._admit(s.records[2:])  # none else is left
    assert 2 in s.scores


def test_written_trees_are_read_again(spark, tmp_path):
    rows = [("m", "apex", "bbh_navigate", 7, 0.0, 0.5, "p", 3, 9), ("m", "swift", "gsm8k", 1, 0.25, None, "q é", 4, 8)]
    results = spark.createDataFrame(rows, "model string, method string, task string, seed long, best_score double, test_score double, best_prompt string, calls long, tokens long")
    R.write_results(results, str(tmp_path / "results"))
    read = R.read_results(spark, str(tmp_path / "results"))
    assert sorted(tuple(r) for r in read.select(*results.columns).collect()) == sorted(rows) and all(r["load_error"] is None for r in read.collect())
    records = spark.createDataFrame([("r1", "a", "t", 0.0, [], "x"), ("r1", "b", "u", None, ["a"], None), ("r2", "a", "v", 0.5, [], "y")], "run_id string, id string, text string, score double, parent_ids array<string>, operator string")
    R.write_audit(records, str(tmp_path / "audit"))
    got = R.read_records(spark, str(tmp_path / "audit")).select("run_id", "id", "text", "score", "parent_ids", "operator")
    assert sorted(map(str, got.collect())) == sorted(map(str, records.fillna("seed", ["operator"]).collect()))


def test_samples_that_occur_again_have_ids_of_their_own(spark, tmp_path):
    (tmp_path / "again.json").write_text('[{"input": "q", "target": "a"}, {"input": "q", "target": "a"}, {"input": "r", "target": "a"}]')
    rows = D.read_json(spark, str(tmp_path / "again.json")).collect()
    assert len(rows) == 3 == len({r["sample_id"] for r in rows})


def _put(root, place, told):
    file = root / place
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(told))


def test_older_layouts(spark, tmp_path):
    a = tmp_path / "a"
    _put(a, "gsm8k/gsm8k/apex_seed3/apex_gsm8k_gsm8k_seed3_metrics.json", {"primary_metric": 0, "metrics": {"accuracy": 0.5}, "elapsed_seconds": 9.0, "token_usage": {"total_tokens": 7}})
    _put(a, "gsm8k/gsm8k/apex_seed3/apex_gsm8k_gsm8k_seed3_optimization.json", {"best_score": 0.75, "best_prompt": "p", "elapsed_seconds": 0, "total_llm_calls": 4})
    _put(a, "gsm8k/gsm8k/see_seed1/see_gsm8k_gsm8k_seed1_metrics.json", {"primary_metric": 0.25})
    _put(a, "svamp/svamp/see_seed1/see_svamp_svamp_seed1_metrics.json", {"primary_metric": 0.25})
    (a / "gsm8k/gsm8k/x_seed2").mkdir()
    (a / "gsm8k/gsm8k/x_seed2/x_gsm8k_gsm8k_seed2_metrics.json").write_text("{broken")
    got = sorted(legacy.read_seed_folders(spark, str(a)).select("method", "task", "seed", "test_score", "best_score", "total_time", "calls", "tokens").collect())
    assert [tuple(r) for r in got] == [("apex", "gsm8k", 3, 0.5, 0.75, 9.0, 4, 7), ("see", "gsm8k", 1, 0.25, 0.0, 0.0, 0, 0)]
    b = tmp_path / "b"
    _put(b, "bbh/snarks/seed2/apex/summary.json", {"primary_metric": 0.5})
    _put(b, "bbh/snarks/seed2/apex/history.json", {"best_score": 1})
    _put(b, "gsm8k/gsm8k/seed1/see/history.json", {"best_score": 0.5})
    _put(b, "gsm8k/other/seed1/see/history.json", {"best_score": 0.5})
    got = sorted(legacy.read_method_folders(spark, str(b)).select("method", "task", "seed", "test_score", "best_score").collect())
    assert [tuple(r) for r in got] == [("apex", "bbh_snarks", 2, 0.5, 1.0), ("see", "gsm8k", 1, 0.0, 0.5)]
    assert [r["method"] for r in legacy.read_method_folders(spark, str(b), ["see"]).collect()] == ["see"]


def test_past_scores_are_read_in_any_encoding(spark, tmp_path):
    runs = tmp_path / "exp" / "funnel"
    for i, encoding in enumerate(("utf-8", "cp1252", "latin-1")):
        told = {"history": {"records": {"a": {"operator": "é" + ("\x81" if encoding == "latin-1" else "–"), "scores": {"dev": i / 2}}, "b": {"operator": "x"}, "c": {"operator": "few", "scores": {"dev": i / 2}}}}}
        (runs / f"bbh_t/seed_{i}").mkdir(parents=True)
        (runs / f"bbh_t/seed_{i}/audit_funnel_{i}.json").write_bytes(json.dumps(told, ensure_ascii=False).encode(encoding))
    (runs / "bbh_t/seed_0/audit_funnel_x.json").write_text("{")
    here = str(runs / "bbh_t" / "seed_9")
    got = {r["operator"]: (r["n"], r["mean"], r["std"]) for r in R.past_operator_scores(spark, here, "funnel", task="bbh_t").collect()}
    assert got == {"é–": (2, 0.25, pytest.approx(0.5 / 2**0.5)), "é\x81": (1, 1.0, 0.0), "few": (3, 0.5, 0.5)}
    assert R.past_operator_scores(spark, here, "other") is None
    assert R.past_operator_scores(spark, here, "funnel", ["few"], "bbh_u").count() == 0


class _Opens:
    def __reduce__(self):
        return (open, ("/nowhere",))


def test_packed_cases_are_read_and_never_run():
    def packed(value, protocol):
        return base64.b64encode(zlib.compress(pickle.dumps(value, protocol))).decode()

    for protocol in (0, 2, 4, 5):
        assert D.packed_text(packed('[{"input": "é"}]', protocol)) == '[{"input": "é"}]'
    assert [D.packed_text(x) for x in (packed(_Opens(), 4), packed(["a", "b"], 4), packed(7, 4), "", None, "!!")] == [None] * 6


def test_strengths_of_drawn_blocks(spark):
    rows = spark.createDataFrame([(i, m, float(v)) for i in range(12) for m, v in (("a", 3), ("b", 2 if i % 3 else 4), ("c", 1 if i % 2 else 3.5))], "block long, method string, value double")
    got = {r["method"]: (r["low"], r["high"]) for r in A.bradley_terry_bootstrap(rows, ["block"], "method", "value", draws=60).collect()}
    again = {r["method"]: (r["low"], r["high"]) for r in A.bradley_terry_bootstrap(rows.repartition(5), ["block"], "method", "value", draws=60).collect()}
    assert all(got[m] == pytest.approx(again[m]) for m in got)
    pairs = {(r["a"], r["b"]): r["wins"] + r["ties"] / 2 for r in A.pair_counts(rows, ["block"], "method", "value").collect()}
    whole = dict(zip("abc", A.bradley_terry([[pairs.get((x, y), 0.0) for y in "abc"] for x in "abc"])))
    assert set(got) == set("abc") and all(got[m][0] <= whole[m] <= got[m][1] for m in got)


def test_parts_and_fields_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a\n\nExamples:",)], "t string")
    got = [tuple(r) for r in rows.select(X.rendered_parts(X.parts_of(F.col("t"))), X.rendered_fields(X.field_values(F.col("t"))), X.answer_only(F.col("t")), X.written_part("examples", F.col("t"))).collect()]
    assert got == [("", "Solve the task.", "", None), ("", "Solve the task.", "", None), ("a", "a\n\nExamples:", "a", "Examples:")]


def test_registry():
    assert len(METHODS) == 29 and method("APEX").choose == "bandit" and not math.isnan(1)
    with pytest.raises(ValueError):
        method("none")


def test_signed_rank_p_against_all_signs(spark):
    import itertools
    import random

    from promptloom.operators import analysis as A

    rng = random.Random(3)
    groups = {0: [], 1: [0.0, 0.0], 2: [1.0], 3: [3.0, -1.0, 2.0], 4: [1.0, -1.0, 2.0], 5: [rng.uniform(-1, 2) for _ in range(11)], 6: [rng.choice([-2.0, -1.0, 1.0, 2.0, 3.0, 0.0]) for _ in range(40)], 7: [float(i + 1) for i in range(60)]}
    rows = [(g, d) for g, ds in groups.items() for d in ds]
    s = A.signed_ranks(spark.createDataFrame(rows, "g int, d double"), ["g"], "d")
    got = {r["g"]: r["p"] for r in s.select("g", A.wilcoxon_p(F.col("n"), F.col("up"), F.col("down"), F.col("tied")).alias("p")).collect()}
    assert got[1] == 1.0 and got[2] == 1.0
    for g in (3, 5):  # every way to set the signs
        size = sorted(map(abs, groups[g]))
        ranks = [size.index(abs(d)) + 1 for d in groups[g]]
        w = min(sum(r for r, d in zip(ranks, groups[g]) if d > 0), sum(r for r, d in zip(ranks, groups[g]) if d < 0))
        sums = [sum(r for r, up in zip(ranks, signs) if up) for signs in itertools.product([0, 1], repeat=len(ranks))]
        assert abs(got[g] - min(1.0, 2 * sum(x <= w for x in sums) / len(sums))) < 1e-12
    for g in (4, 6, 7):  # the normal law with ties
        from statistics import NormalDist

        d = [x for x in groups[g] if x]
        size = sorted(map(abs, d))
        ranks = [size.index(abs(x)) + (size.count(abs(x)) + 1) / 2 for x in d]
        tied = sum(size.count(x) ** 2 - 1 for x in size)
        n, w = len(d), min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
        p = 2 * NormalDist().cdf((w - n * (n + 1) / 4) / ((n * (n + 1) * (2 * n + 1) - tied / 2) / 24) ** 0.5)
        assert abs(got[g] - min(1.0, p)) < 1e-12


def test_bootstrap_does_not_gather_groups(spark):
    from promptloom.operators import analysis as A

    df = spark.range(20000).select((F.col("id") % 2).alias("g"), (F.col("id") % 100 / 100.0).alias("v"), F.col("id").cast("string").alias("k"))
    rows = {r["g"]: r for r in A.bootstrap_interval(df, ["g"], "v", F.col("k"), 200).collect()}
    for r in rows.values():  # 10,000 values of deviation 0.29: 0.0057 at either side
        assert 0.49 - 0.01 < r["low"] < r["high"] < 0.5 + 0.01 and 0.008 < r["high"] - r["low"] < 0.015
    w = spark.range(20000).select(A.resampling_weight(F.col("id").cast("string"), F.lit(1)).alias("a"), A.resampling_weight(F.col("id").cast("string"), F.lit(2)).alias("b"))
    m = w.agg(F.avg("a").alias("a"), F.var_pop("a").alias("v"), F.corr("a", "b").alias("c")).first()
    assert abs(m["a"] - 1) < 0.03 and abs(m["v"] - 1) < 0.06 and abs(m["c"]) < 0.03


def test_tournaments(spark):
    from promptloom.operators import select as S
    from promptloom.operators.rank import rank_order

    df = spark.range(500).select(F.col("id").alias("record_id"), (F.col("id") * 37 % 500 / 500.0).alias("dev"), (F.col("id") * 37 % 500 / 500.0).alias("score"), (F.col("id") % 3).alias("coverage"))
    rows = S.tournaments(df, rank_order(), 20, 3, coverage="coverage", pull=0.5, seed="a").collect()
    assert len({r["record_id"] for r in rows}) == len(rows) <= 20 and rows[0]["bout_no"] == 0 and max(r["score"] for r in rows) == rows[0]["score"]
    assert len(S.tournaments(df.limit(2), rank_order(), 20).collect()) == 2 and len(S.tournaments(df.limit(0), rank_order(), 20).collect()) == 0


def test_budget_and_running_totals_have_one_order(spark):
    from promptloom.operators.rank import running_totals
    from promptloom.plans.budget import admitted

    df = spark.range(1000).repartition(7).select("id", F.lit(1).alias("calls"), F.lit(0).alias("seconds"), (F.col("id") % 3).alias("input_tokens"), F.lit(0).alias("output_tokens"))
    got = {r["id"]: r["calls_so_far"] for r in running_totals(df, [F.col("id")], ["calls"]).collect()}
    assert got == {i: i + 1 for i in range(1000)}
    refused = {r["id"]: r["refused"] for r in admitted(df, [F.col("id")], {"calls": 500, "input_tokens": 300}).collect()}
    assert refused[299] is None and refused[301] == "input_tokens" and refused[499] == "input_tokens" and refused[500] == "calls"


def test_first_parents_of_more_rows_than_recursion_allows(spark):
    parents = {i: [i // 2] if i else [] for i in range(600)} | {1000: [1001], 1001: [1000], 2000: [2000], 3000: [9999], 4000: []} | {5000 + i: [4999 + i] for i in range(1, 40)}
    df = spark.createDataFrame(list(parents.items()), "record_id long, parent_ids array<long>")

    def walk(i, hops, limit):
        return walk(parents[i][0], hops + 1, limit) if hops < limit and parents.get(i) else (hops, i)

    for limit in (1, 6, 13):
        got = {r["start_id"]: (r["hops"], r["root_id"]) for r in L.first_parent_roots(df, limit).collect()}
        assert got == {i: walk(i, 0, limit) for i in parents}
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        assert catalogue.QUERIES["first_parent_chain"](spark, "/root/testdata/sf0.001").agg({"hops": "max"}).head()[0] > 5
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
