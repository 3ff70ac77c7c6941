"""Techniques as rows: what they show, what they skip, how replies become prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptloom.search import techniques as T
from promptloom.search.client import generate
from promptloom.search.methods import METHODS

RECORDS = [("s", 1, "Add the numbers. Say the sum.", 0.5), ("s", 2, "Count. Then tell.", 0.9), ("s", 3, None, 0.8), ("s", 4, "", 1.0), ("s", 5, "Unscored.", None), ("lone", 6, "Only me. Here.", 0.1)]


def answering(reply):
    """A client of one answer, made within so that it travels to the workers."""

    class Client:
        def generate(self, prompts):
            return [reply for _ in prompts]

    return Client


def made(spark, picks, outcomes=(), samples=(), client=answering("  NEW  ")):
    records = spark.createDataFrame(RECORDS, "by string, record_id long, text string, score double")
    pools = T.members(records, ["by"])
    df = spark.createDataFrame(picks, "by string, technique string, record_id long, second_id long, draw long")
    facts = spark.createDataFrame(list(outcomes), "record_id long, seq long, input string, target string, reply string, correct int")
    shots = T.shots(spark.createDataFrame(list(samples), "by string, sample_id long, input string, target string"), ["by"], 1)
    plan = T.planned(df, records.select("record_id", "text"), pools, facts, shots, ["by"])
    return {(r["technique"], r["record_id"]): r for r in T.offspring(plan, client).collect()}, {(r["technique"], r["record_id"]): r for r in plan.collect()}


def test_methods_name_known_techniques():
    assert {o for m in METHODS.values() for o in m.operators} <= set(T.TECHNIQUES)
    requests = [t.request for t in T.TECHNIQUES.values() if t.request]
    assert len(set(requests)) == len(requests)


def test_replies_become_prompts_by_take(spark):
    fails = [(1, 1, "2+2", "4", "5", 0), (1, 2, "1+1", "2", "2", 1)]
    picks = [("s", t, 1, 2, 1) for t in ("semantic_var", "autohint", "grips_add", "grips_paraphrase", "reflective_mutation", "ampo_branch", "crossover", "trajectory", "grips_swap")]
    got, plan = made(spark, picks, fails)
    text = {t: r["child"] for (t, _), r in got.items()}
    assert text["semantic_var"] == text["crossover"] == text["trajectory"] == text["reflective_mutation"] == "NEW"
    assert text["autohint"] == text["ampo_branch"] == "Add the numbers. Say the sum. NEW"
    assert text["grips_add"] == "Add the numbers. Say the sum. NEW" and text["grips_paraphrase"] == "Add the numbers. NEW"
    assert text["grips_swap"] == "Say the sum. Add the numbers."
    assert {t: r["calls"] for (t, _), r in got.items()} == {t: 0 if t == "grips_swap" else 2 if t in ("reflective_mutation", "ampo_branch") else 1 for t in text}
    asked = plan["reflective_mutation", 1]["before"]
    assert "- Input: 2+2\n  Expected: 4\n  Got: 5" in asked and "Cases it solves:\n- Input: 1+1" in asked
    assert "- Score 0.500: Add the numbers. Say the sum.\n- Score 0.900: Count. Then tell." in plan["trajectory", 1]["request"]


def test_what_lacks_something_shown_is_skipped_without_a_call(spark):
    picks = [("s", "failure_guided", 2, 1, 0), ("lone", "crossover", 6, None, 0), ("lone", "trajectory", 6, None, 0), ("s", "few_shot", 1, 2, 0), ("s", "lamarckian", 1, 2, 0), ("s", "unknown", 1, 2, 0), ("s", "semantic_var", 99, 1, 0), ("s", "semantic_var", None, None, 0), ("s", "instruction_only", 1, 2, 0), ("none", "semantic_var", 1, 2, None)]
    got, _ = made(spark, picks)
    assert len(got) == len(picks)
    assert all(r["skipped"] and r["child"] is None and r["calls"] == 0 for k, r in got.items() if k != ("semantic_var", 1))
    assert got["semantic_var", 1]["child"] == "NEW"


def test_silence_is_asked_once_more_and_makes_nothing(spark):
    got, _ = made(spark, [("s", "semantic_var", 1, 2, 0), ("s", "facet_edit", 1, 2, 0)], client=answering(""))
    assert {k[0]: (r["child"], r["calls"]) for k, r in got.items()} == {"semantic_var": (None, 2), "facet_edit": (None, 2)}


def test_demonstrations_come_of_samples(spark):
    samples = [("s", i, f"in{i}", f"out{i}") for i in range(9)] + [("s", 9, None, None)]
    got, plan = made(spark, [("s", t, 1, 2, d) for d, t in ((0, "few_shot"), (1, "few_shot_fixed"), (2, "format_constraint"), (3, "lamarckian"))], samples=samples)
    text = {t: r["child"] for (t, _), r in got.items()}
    assert text["few_shot"].count("Input: ") == 1 and text["few_shot_fixed"].count("Input: ") == 3
    assert "exactly in the same format" in text["format_constraint"] and text["lamarckian"] == "NEW"
    assert "Add the numbers" not in plan["lamarckian", 1]["request"]


def test_pools_and_draws(spark):
    records = spark.createDataFrame(RECORDS, "by string, record_id long, text string, score double")
    pools = T.members(records, ["by"])
    assert {r["by"]: ([x["record_id"] for x in r["leaders"]], [x["record_id"] for x in r["last"]]) for r in pools.collect()} == {"s": ([2, 1], [2, 1]), "lone": ([6], [6])}
    for r in T.drawn(pools, F.array(*map(F.lit, T.TECHNIQUES)), ["by"], 3).collect():
        assert (r["record_id"], r["second_id"]) in ({(1, 2), (2, 1)} if r["by"] == "s" else {(6, None)})
    assert T.members(records.limit(0), ["by"]).count() == 0


def test_null_prompts_pass_unasked(spark):
    rows = spark.createDataFrame([(2**60 + 1, "a b"), (None, None)], "k long, prompt string")
    assert [tuple(r) for r in generate(rows.coalesce(1), answering("  NEW  ")).collect()] == [(2**60 + 1, "a b", "  NEW  ", 1, 2, 1), (None, None, None, 0, 0, 0)]
