"""Selection: bandits over operators, pruning from history, rewards, allocation, splits, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def operator_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean and sample deviation (0 for one) of each operator."""
    return df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def pruned(stats: DataFrame, by: str, min_n: int = 40, z_limit: float = 1.64) -> DataFrame:
    """Each operator with its z below the pool and whether it is dropped; needs two judged operators."""
    judged = F.col("n") >= min_n
    pool = stats.where(judged).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_pool"), F.count("*").alias("_judged"))
    error = F.when(F.col("std") > 0, F.col("std") / F.sqrt("n")).otherwise(1e-6)
    z = (F.col("mean") - F.col("_pool")) / error
    met = stats.crossJoin(F.broadcast(pool))
    return met.select(by, "n", F.when(judged & (F.col("_judged") >= 2), z).alias("z"), F.coalesce(judged & (F.col("_judged") >= 2) & (z <= -z_limit), F.lit(False)).alias("dropped"))


def pulls_summary(pulls: DataFrame, arms: DataFrame | None, arm: str, reward: str) -> DataFrame:
    """Pulls, mean and population variance of each arm, and all pulls; arms never pulled have 0."""
    g = pulls.groupBy(arm).agg(F.count(reward).alias("n"), F.avg(reward).alias("mean"), F.var_pop(reward).alias("var"))
    if arms is not None:
        g = arms.join(g, arm, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total))


def ucb1(summary: DataFrame, c: float = 1.0) -> DataFrame:
    """Upper confidence bounds; infinite for an arm without a pull."""
    bound = F.col("mean") + c * F.sqrt(F.ln(F.greatest(F.col("total"), F.lit(2))) / F.col("n"))
    return summary.withColumn("ucb", F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(bound))


def ucb1_tuned(summary: DataFrame, generation: int, c: float = 1.0) -> DataFrame:
    """Variance-aware bounds whose exploration decays with the generation."""
    log = F.ln(F.greatest(F.col("total"), F.lit(2))) / F.col("n")
    spread = F.when(F.col("n") > 1, F.col("var")).otherwise(0.25) + F.sqrt(2 * log)
    bound = F.col("mean") + (generation + 1) ** -0.5 * c * F.sqrt(log * F.least(F.lit(0.25), spread))
    return summary.withColumn("ucb", F.when(F.col("n") == 0, F.lit(float("inf"))).otherwise(bound))


def free_and_filled(bounds: DataFrame, arm: str, top: int, produced: Column, free: Column) -> DataFrame:
    """``place, chosen`` of each arm by its bound: the first ``top`` of those that ``produced`` something (an arm that cannot apply gives its
    place to the next), and the ``free`` ones in any case, which cost nothing."""
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("ucb"), arm)  # a row an arm
    placed = bounds.withColumn("place", F.row_number().over(order)).withColumn("_used", F.sum(produced.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return placed.withColumn("chosen", (produced & (F.col("_used") <= top)) | free).drop("_used")


def hashed_unit(seed: str, *keys: str) -> Column:
    """A number in (0, 1] from a seed and keys: 52 bits of a hash, equal on every engine."""
    text = F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def tournaments(df: DataFrame, order: Sequence[Column], size: int, bout: int = 3, key: str = "record_id", coverage: str | None = None, pull: float = 0.0, seed: str = "0") -> DataFrame:
    """``df`` with ``bout_no`` for the ``size`` parents of tournaments: the best of all (0) and the winner of each bout (1 to size - 1).

    The others are dealt to bouts without replacement, by hashes of their keys; a bout's winner is the first by ``order``. With the chance ``pull`` one of the front (positive
    ``coverage``), drawn in proportion to it by exponential keys, joins a bout. One that wins several bouts counts once, in its first.
    Bouts are groups, so the population may be of any size.
    """
    best = df.orderBy(*order).limit(1).withColumn("bout_no", F.lit(0))
    rest = df.join(best.select(F.col(key).alias("_best")), F.col(key) == F.col("_best"), "left_anti")
    drawn = rest.withColumn("_u", hashed_unit(f"{seed}|draw", key)).orderBy("_u", key).limit(bout * (size - 1))
    dealt = drawn.withColumn("bout_no", (F.floor((F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_u", key)) - 1) / bout) + 1).cast("int")).drop("_u")  # bout * size rows
    entries = dealt
    if coverage and pull > 0:
        bouts = df.sparkSession.range(1, size).select(F.col("id").cast("int").alias("bout_no")).where(hashed_unit(f"{seed}|pull", "bout_no") < pull)
        front = rest.where(F.col(coverage) > 0).crossJoin(F.broadcast(bouts))  # bouts are a parameter
        keyed = front.withColumn("_e", -F.ln(hashed_unit(f"{seed}|front", "bout_no", key)) / F.col(coverage))
        pulled = keyed.groupBy("bout_no").agg(F.min_by(key, F.struct("_e", key)).alias("_p")).join(rest, F.col("_p") == F.col(key)).select(*df.columns, "bout_no")
        entries = entries.unionByName(pulled).distinct()
    first = F.row_number().over(W.partitionBy("bout_no").orderBy(*order))
    winners = entries.withColumn("_place", first).where("_place = 1").drop("_place")
    once = F.row_number().over(W.partitionBy(key).orderBy("bout_no"))
    return best.unionByName(winners.withColumn("_once", once).where("_once = 1").drop("_once"))


def stagnation(df: DataFrame, by: Sequence[str], seq: str, value: str, tolerance: float, most: int, perfect: float = 1.0) -> DataFrame:
    """``by, stop, reason``: where each run ends: at the first value that is ``perfect``, or after ``most`` steps in a row that gain less than ``tolerance``.
    Runs that do neither have nulls."""
    order = W.partitionBy(*by).orderBy(seq)
    gain = F.round(F.col(value) - F.lag(value).over(order), 9)
    gained = df.withColumn("_head", F.coalesce(gain >= tolerance, F.lit(True)).cast("int"))
    grouped = gained.withColumn("_stretch", F.sum("_head").over(order.rowsBetween(W.unboundedPreceding, 0)))
    streak = grouped.withColumn("_streak", F.row_number().over(W.partitionBy(*by, "_stretch").orderBy(seq)) - 1)
    ends = streak.groupBy(*by).agg(F.min(F.when(F.col(value) >= perfect, F.col(seq))).alias("_perfect"), F.min(F.when(F.col("_streak") >= most, F.col(seq))).alias("_stuck"))
    stop = F.least("_perfect", "_stuck")
    return ends.select(*by, stop.alias("stop"), F.when(F.col("_perfect") <= stop, "perfect").when(stop.isNotNull(), "stagnation").alias("reason"))


def mode_families(df: DataFrame, mode: Column, score: str, best: float, slack: float = 0.0) -> DataFrame:
    """``mode, best, alive``: the best score of each family of modes, and whether it comes within ``slack`` of the overall best."""
    return df.groupBy(mode.alias("mode")).agg(F.max(score).alias("best")).withColumn("alive", F.col("best") > best - slack)


def chosen_arms(bounds: DataFrame, arm: str, top: int = 4, min_pulls: int = 4, seq: str | None = None) -> DataFrame:
    """Arms short of ``min_pulls`` in any case, others by bound until ``top`` are chosen."""
    forced = F.col("n") < min_pulls
    order = W.partitionBy(F.lit(0)).orderBy(forced.desc(), F.desc("ucb"), seq or arm)  # a row an arm
    placed = bounds.withColumn("place", F.row_number().over(order)).withColumn("forced", forced)
    return placed.where(F.col("forced") | (F.col("place") <= top))


def warm_started(pulls: DataFrame, history: DataFrame, arm: str, reward: str, prior: int) -> DataFrame:
    """Pulls with ``prior`` pseudo-pulls at each arm's historical mean."""
    pseudo = history.select(arm, F.col("mean").alias(reward)).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(prior)))).drop("_k")
    return pulls.select(arm, reward).unionByName(pseudo)


def weighted_sample(df: DataFrame, weight: str, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows without replacement, by weight: the smallest exponential keys, drawn from a hash of the row's key."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11) + 1) / F.lit(float((1 << 53) + 1))
    return df.where(F.col(weight) > 0).orderBy(-F.ln(u) / F.col(weight), key).limit(n)


def rewards(pulls: DataFrame, records: DataFrame, elite: Column, slack: float) -> DataFrame:
    """One reward a pull: mean gain over the elite, ``-slack`` for a rejected record, 0 for an empty pull."""
    met = pulls.join(records, "pull_id", "left")
    gain = F.when(F.col("gate") == "rejected", -slack).otherwise(F.col("score") - elite)
    return met.groupBy("pull_id", "operator").agg(F.coalesce(F.avg(gain), F.lit(0.0)).alias("reward"))


def allocation(weights: DataFrame, total: int, name: str = "name", weight: str = "weight", seq: str = "seq") -> DataFrame:
    """Whole shares of ``total`` by weight; what is left goes to the heaviest."""
    share = weights.withColumn("n", F.floor(F.lit(total) * F.col(weight)).cast("bigint"))
    left = total - F.sum("n").over(W.partitionBy(F.lit(0)))
    top = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(weight), seq)) == 1
    return share.withColumn("_left", left).withColumn("n", F.col("n") + F.when(top & (F.col("_left") > 0), F.col("_left")).otherwise(0)).select(name, "n")


def shuffled(df: DataFrame, key: str, seed: int | str) -> Column:
    """A fixed order that looks random: the hash of the key and a seed. Equal on every engine."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")), 256)


def split_sizes(total: int, ratio: float = 0.0) -> tuple[int, int, int]:
    """Train, dev and test sizes of the fixed-seed split."""
    if ratio > 0:
        train = 8 if total >= 28 else 3
        dev = max(1, round((total - train) * ratio))
        return train, dev, total - train - dev
    train, spare = (8, 50) if total >= 173 else (3, 33)
    test = min(115, max(1, total - train - spare))
    return train, total - test - train, test


def json_split_sizes(total: int, limit: int | None = None) -> tuple[int, int, int]:
    n = min(total, limit) if limit else total
    train = max(3, n // 5)
    test = (n - train) // 2
    return train, n - train - test, test


def holdout_size(total: int) -> int:
    """How many samples stay for optimisation when a holdout is carved."""
    return max(1, total - max(12, round(0.3 * total)))


def fixed_split(df: DataFrame, key: str, sizes: DataFrame, by: Sequence[str], test_seed: int = 42, seed: int = 0) -> DataFrame:
    """Test rows by a fixed seed, the rest dealt to train and dev by the run's seed; ``sizes`` has n_train, n_test for each group."""
    test_order = W.partitionBy(*by).orderBy(shuffled(df, key, test_seed), key)
    met = df.join(sizes, list(by)).withColumn("_t", F.row_number().over(test_order))
    is_test = F.col("_t") <= F.col("n_test")
    rest_order = W.partitionBy(*by, is_test).orderBy(shuffled(df, key, seed), key)
    met = met.withColumn("_r", F.row_number().over(rest_order))
    split = F.when(is_test, "test").when(F.col("_r") <= F.col("n_train"), "train").otherwise("dev")
    return met.withColumn("split", split).select(*df.columns, "split")


def export_flags(df: DataFrame, top: int, score: str = "score", seq: str = "record_id", operator: str = "operator") -> DataFrame:
    """Whose text and whose details are kept at export: the best ``top`` and the best of each operator; details of the best only.

    The best are found as a bounded top-k, not by numbering all rows.
    """
    order = [F.desc(score), F.col(seq)]
    best = df.orderBy(*order).limit(top).select(F.col(seq).alias("_b"), F.lit(True).alias("_top"))
    first = df.orderBy(*order).limit(1).select(F.col(seq).alias("_f"), F.lit(True).alias("_first"))
    ops = df.groupBy(operator).agg(F.max(F.struct(F.col(score), -F.col(seq))).alias("m")).select((-F.col("m")["col2"]).alias("_o"), F.lit(True).alias("_op"))
    met = df.join(F.broadcast(best), F.col(seq) == F.col("_b"), "left").join(F.broadcast(first), F.col(seq) == F.col("_f"), "left").join(ops, F.col(seq) == F.col("_o"), "left")
    return met.withColumn("keep_text", F.coalesce("_top", "_op", F.lit(False))).withColumn("keep_details", F.coalesce("_first", F.lit(False))).select(*df.columns, "keep_text", "keep_details")
