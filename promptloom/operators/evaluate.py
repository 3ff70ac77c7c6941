"""Evaluation facts: racing, accuracy, discrimination, retention, gates, phases, agreement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count
from .analysis import hoeffding_bound


def accuracy(df: DataFrame, by: Sequence[str], correct: str = "correct") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(correct).alias("num_correct"), F.count(correct).alias("num_total"), F.coalesce(F.try_divide(F.sum(correct), F.count(correct)), F.lit(0.0)).alias("score"))


def deploy_cost(records: DataFrame, outcomes: DataFrame, input_weight: float = 1.0, output_weight: float = 1.0) -> DataFrame:
    """What each use of a prompt costs in words: its own and, on average, those of its replies; without replies its own."""
    said = outcomes.groupBy("record_id").agg(F.avg(word_count(F.col("reply"))).alias("_out"))
    own = records.select("record_id", word_count(F.col("text")).alias("prompt_words"))
    cost = input_weight * F.col("prompt_words") + output_weight * F.coalesce("_out", F.lit(0.0))
    return own.join(said, "record_id", "left").select("record_id", "prompt_words", F.coalesce("_out", F.lit(0.0)).alias("reply_words"), cost.alias("deploy_cost"))


def search_cost(usage: DataFrame, by: Sequence[str], calls: str = "calls", tokens: str = "tokens", slots: str = "slots") -> DataFrame:
    """What a search took, and its tokens for each place in a generation that it filled: what compares methods of unlike budgets."""
    spent = usage.groupBy(*by).agg(F.sum(calls).alias("search_calls"), F.sum(tokens).alias("search_tokens"), F.greatest(F.lit(1), F.sum(slots)).alias("search_slots"))
    return spent.withColumn("tokens_per_slot", F.col("search_tokens") / F.col("search_slots"))


def racing(df: DataFrame, baseline: float, by: str = "record_id", n: str = "n", correct: str = "correct", min_n: int = 10, alpha: float = 0.05, batch: int | None = None, min_batches: int = 1) -> DataFrame:
    """Retrospective racing: ``stop_n`` of each candidate, null where it is never beaten for sure.

    With ``batch`` the bound is looked at after whole batches only, and never at the last sample.
    """
    order = W.partitionBy(by).orderBy(n)
    seen = df.withColumn("_score", F.sum(correct).over(order.rowsBetween(W.unboundedPreceding, 0)) / F.col(n))
    beaten = F.col("_score") + hoeffding_bound(F.col(n), alpha) < baseline
    if batch:
        seen = seen.withColumn("_total", F.count("*").over(W.partitionBy(by)))
        at = (F.col(n) % batch == 0) & (F.col(n) >= batch * min_batches) & (F.col(n) < F.col("_total"))
    else:
        at = F.col(n) >= min_n
    return seen.groupBy(by).agg(F.min(F.when(at & beaten, F.col(n))).alias("stop_n"), F.count("*").alias("available"))


def raced(df: DataFrame, stops: DataFrame, by: str = "record_id", n: str = "n", correct: str = "correct") -> DataFrame:
    """What a raced evaluation would have spent and found."""
    met = df.join(stops.select(F.col(by).alias("_by"), "stop_n"), F.col(by) == F.col("_by"))
    used = met.where(F.col("stop_n").isNull() | (F.col(n) <= F.col("stop_n")))
    return used.groupBy(by).agg(F.count("*").alias("evaluated"), F.sum(correct).alias("num_correct"), F.max(F.col("stop_n").isNotNull()).alias("terminated"))


def discrimination(df: DataFrame, sample: str = "sample_id", correct: str = "correct") -> DataFrame:
    """Variance of outcomes across candidates for each sample: zero where all agree."""
    return df.groupBy(sample).agg(F.sum(correct).alias("solved"), F.count("*").alias("n")).withColumn("discrimination", (F.col("solved") / F.col("n")) * (1 - F.col("solved") / F.col("n")))


def calibrated_pool(df: DataFrame, floor: int, sample: str = "sample_id", correct: str = "correct") -> DataFrame:
    """Samples that discriminate, topped up in order to ``floor``."""
    d = discrimination(df, sample, correct).select(sample, "discrimination")
    useful = d.where("discrimination > 0")
    # the top-up is no larger than the floor, so it is a bounded top-k
    more = d.where("discrimination <= 0").orderBy(sample).limit(floor).withColumn("_place", F.row_number().over(W.orderBy(sample)))
    room = useful.limit(floor).agg(F.count("*").alias("_useful"))
    topped = more.crossJoin(F.broadcast(room)).where(F.col("_place") <= floor - F.col("_useful"))
    return useful.unionByName(topped.select(sample, "discrimination"))


def family_switch(df: DataFrame, family: Sequence[str], baseline: str, needed: int, operator: str = "operator", score: str = "score", n: str = "n") -> DataFrame:
    """One row: the best of a family of operators against the baseline, both over ``needed`` samples at least.

    ``disabled`` is true where the family gains nothing; null where one of the two has not been evaluated so far.
    """
    known = df.where(F.col(n) >= needed)
    best = known.agg(F.max(F.when(F.col(operator).isin(*family), F.col(score))).alias("family_best"), F.max(F.when(F.col(operator) == baseline, F.col(score))).alias("baseline_score"))
    return best.withColumn("disabled", F.col("family_best") <= F.col("baseline_score"))


def retention(children: DataFrame, edges: DataFrame, record: str = "record_id", sample: str = "sample_id", correct: str = "correct") -> DataFrame:
    """For each (child, parent) edge: the share of the parent's solved samples that the child solves; 1 where it solved none."""
    solved = children.where(F.col(correct) > 0).select(F.col(record).alias("_r"), F.col(sample).alias("_s"))
    parents = edges.join(solved, F.col("parent_id") == F.col("_r"), "left").select("child_id", "parent_id", "_s")
    kept = solved.select(F.col("_r").alias("_c"), F.col("_s").alias("_cs"))
    met = parents.join(kept, (F.col("child_id") == F.col("_c")) & (F.col("_s") == F.col("_cs")), "left")
    return met.groupBy("child_id", "parent_id").agg(F.coalesce(F.try_divide(F.count("_cs"), F.count("_s")), F.lit(1.0)).alias("retention"))


def guarded_acceptance(retained: DataFrame, scores: DataFrame, floor: float = 0.5) -> DataFrame:
    """Reject a child only if it gains nothing and keeps less than ``floor`` of its best-kept parent."""
    s = scores.select("record_id", "score")
    met = retained.join(s.select(F.col("record_id").alias("child_id"), F.col("score").alias("child_score")), "child_id", "left").join(s.select(F.col("record_id").alias("parent_id"), F.col("score").alias("parent_score")), "parent_id", "left")
    g = met.groupBy("child_id").agg(F.max("retention").alias("retention"), F.max("child_score").alias("child_score"), F.max("parent_score").alias("parent_best"))
    known = F.col("child_score").isNotNull() & F.col("parent_best").isNotNull()
    return g.withColumn("admitted", ~known | (F.col("child_score") > F.col("parent_best")) | (F.col("retention") >= floor))


def minibatch_gate(df: DataFrame, baseline: float, slack: float, minibatch: int, by: str = "record_id", n: str = "n", correct: str = "correct") -> DataFrame:
    """Score on a first minibatch decides who gets the full evaluation; the others keep the small score."""
    g = df.groupBy(by).agg(F.avg(F.when(F.col(n) <= minibatch, F.col(correct))).alias("mb"), F.avg(correct).alias("full"))
    passed = F.col("mb") + slack >= baseline
    return g.select(by, F.when(passed, "passed").otherwise("rejected").alias("gate"), F.when(passed, F.col("full")).otherwise(F.col("mb")).alias("score"))


def phase_rows(df: DataFrame, sizes: Sequence[int], by: str = "record_id", n: str = "n") -> DataFrame:
    """Rows that each phase of nested prefixes adds."""
    phase = F.when(F.col(n) <= sizes[0], 1)
    for i, size in enumerate(sizes[1:], 2):
        phase = phase.when(F.col(n) <= size, i)
    return df.withColumn("phase", phase).where(F.col("phase").isNotNull())


def phase_sizes(total: int, fractions: Sequence[float] = (0.25, 0.5, 0.75, 1.0), floor: int = 16) -> list[int]:
    """Sizes of nested prefixes: rounded half to even, at least ``floor``, never falling, never above the total."""
    out: list[int] = []
    for f in fractions:
        size = min(total, max(floor, round(total * f)))
        out.append(max(size, out[-1] if out else 0))
    return out


def solved_by(df: DataFrame, sample: str, correct: str = "correct") -> DataFrame:
    """How many samples are solved by how many candidates; 0 are those that none solves."""
    return df.groupBy(sample).agg(F.sum(correct).alias("k")).groupBy("k").agg(F.count("*").alias("n_samples"))


def jaccard(df: DataFrame, item: str, sample: str, correct: str = "correct") -> DataFrame:
    """Overlap of solved samples for pairs of items; null where neither solves any. Items are few, samples many."""
    solved = df.where(F.col(correct) > 0).select(item, sample).distinct()
    sizes = df.select(item).distinct().join(solved.groupBy(item).agg(F.count("*").alias("n")), item, "left").select(item, F.coalesce("n", F.lit(0)).alias("n"))
    both = solved.select(F.col(item).alias("a"), sample).join(solved.select(F.col(item).alias("b"), sample), sample).where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    pairs = sizes.select(F.col(item).alias("a"), F.col("n").alias("na")).join(sizes.select(F.col(item).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    met = pairs.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return met.select("a", "b", "common", F.try_divide("common", F.col("na") + F.col("nb") - F.col("common")).alias("jaccard"))


def majority(df: DataFrame, by: Sequence[str], correct: str = "correct") -> DataFrame:
    return df.groupBy(*by).agg((2 * F.sum(correct) >= F.count("*")).alias("solved"))


def instance_coverage(df: DataFrame, record: str = "record_id", sample: str = "sample_id", value: str = "correct", positive: bool = True) -> DataFrame:
    """Samples on which a record has the best value, ties included; with ``positive`` a best of 0 has no winner."""
    met = df.withColumn("_best", F.max(value).over(W.partitionBy(sample)))
    if positive:
        met = met.where("_best > 0")
    return met.where(F.col(value) == F.col("_best")).groupBy(record).agg(F.count("*").alias("coverage"))


def best_so_far(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("best_so_far", F.max(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def hop_delta(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Change against the previous value that is not null."""
    before = F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("delta", F.col(value) - before)


def patience_stop(df: DataFrame, by: Sequence[str], order: str, value: str, patience: int, eps: float = 1e-12) -> DataFrame:
    """The first step at which the best has not risen for ``patience`` steps; null where it always rises in time."""
    seq = W.partitionBy(*by).orderBy(order)
    best = F.max(value).over(seq.rowsBetween(W.unboundedPreceding, -1))
    placed = df.withColumn("_i", F.row_number().over(seq)).withColumn("_up", best.isNull() | (F.col(value) > best + eps))
    last = F.max(F.when(F.col("_up"), F.col("_i"))).over(seq.rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("_last", last).groupBy(*by).agg(F.min(F.when(F.col("_i") - F.col("_last") >= patience, F.col("_i"))).cast("bigint").alias("stop_at"))


def anytime_area(df: DataFrame, by: Sequence[str], elapsed: str, best: str) -> DataFrame:
    """Area under best against time, both scaled by their last values; groups without elapsed time are left out."""
    order = W.partitionBy(*by).orderBy(elapsed, best)
    seg = df.withColumn("_x", F.lead(elapsed).over(order)).withColumn("_y", F.lead(best).over(order))
    area = F.sum(F.when(F.col("_x").isNotNull(), (F.col("_x") - F.col(elapsed)) * (F.col(best) + F.col("_y")) / 2))
    g = seg.groupBy(*by).agg(area.alias("a"), F.max(elapsed).alias("t"), F.max(best).alias("b"), F.count("*").alias("n")).where("t > 0 and n >= 2")
    return g.select(*by, (F.col("a") / F.col("t") / F.when(F.col("b") > 0, F.col("b")).otherwise(1.0)).alias("auc"))


def interpolate(df: DataFrame, by: Sequence[str], x: str, y: str, grid: Column) -> DataFrame:
    """y at the points of a grid (an array column of the same for all): linear between, flat outside."""
    order = W.partitionBy(*by).orderBy(x)
    seg = df.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1"), F.row_number().over(order).alias("_i"))
    points = seg.withColumn("g", F.explode(grid))
    inside = (F.col("g") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("g") < F.col("x1")))
    before = (F.col("_i") == 1) & (F.col("g") < F.col("x0"))
    value = F.when(before | F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("g") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return points.where(inside | before).select(*by, "g", value.alias("y"))
