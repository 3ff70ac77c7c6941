"""Analysis of run tables: coverage, macro scores, costs, paired comparisons, variance shares."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import cut, ship
from .rank import average_rank, first_of, front, numbered

# Studentised range at .05 over the root of two, by number of methods.
NEMENYI_Q = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031}
# Bounds of the effect sizes of Cliff's delta.
CLIFF_BOUNDS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))
# Weights of the composite rank.
COMPOSITE_WEIGHTS = {"accuracy": 0.40, "stability": 0.20, "generalization": 0.15, "token_cost": 0.15, "speed": 0.10}

mean = lambda c: F.round(F.avg(c), 9)  # noqa: E731  free of the order of summation, so that ties stay ties


def summary(df: DataFrame, by: Sequence[str], value: str = "test_score") -> DataFrame:
    """Mean, sample deviation (0 for one row) and count of each group."""
    return df.groupBy(*by).agg(mean(value).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 9).alias("std"), F.count(value).alias("n"))


def complete_cells(df: DataFrame, cell: Sequence[str], unit: str, wanted: int | None = None) -> DataFrame:
    """Cells with all units: as many different ones as ``wanted``, or as the fullest cell has."""
    counts = df.groupBy(*cell).agg(F.count_distinct(unit).alias("n_units"))
    if wanted is not None:
        return counts.where(F.col("n_units") == wanted)
    most = counts.agg(F.max("n_units").alias("_most"))
    return counts.join(F.broadcast(most), F.col("n_units") == F.col("_most")).drop("_most")


def incomplete_grid(df: DataFrame, rows: str, columns: str, unit: str) -> DataFrame:
    """Cells of the full grid short of the most units; -1 where a cell has no row at all."""
    counts = df.groupBy(rows, columns).agg(F.count(unit).alias("_n"))
    grid = df.select(rows).distinct().crossJoin(df.select(columns).distinct())  # two small dimensions
    met = grid.join(counts, [rows, columns], "left").withColumn("n", F.coalesce("_n", F.lit(-1)))
    most = counts.agg(F.max("_n").alias("_most"))
    return met.join(F.broadcast(most), F.col("n") < F.col("_most")).select(rows, columns, "n")


def macro_scores(df: DataFrame, by: Sequence[str], task: str = "task", seed: str = "seed", value: str = "test_score", tasks: int | None = None) -> DataFrame:
    """Mean over tasks for each seed that has all of them."""
    return df.groupBy(*by, seed).agg(mean(value).alias("macro"), F.count_distinct(task).alias("n_tasks")).where(F.col("n_tasks") == tasks if tasks else F.lit(True))


def block_means(df: DataFrame, block: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    """Mean of each item in each block, blocks that have all items only."""
    cells = df.groupBy(*block, item).agg(mean(value).alias("value"))
    per = W.partitionBy(*block)
    all_items = df.agg(F.count_distinct(item).alias("_k"))
    return cells.withColumn("_n", F.count("*").over(per)).join(F.broadcast(all_items), F.col("_n") == F.col("_k")).drop("_n", "_k")


def block_ranks(df: DataFrame, block: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    return block_means(df, block, item, value).withColumn("rank", average_rank(F.col("value"), block))


def mean_ranks(df: DataFrame, block: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    return block_ranks(df, block, item, value).groupBy(item).agg(F.round(F.avg("rank"), 9).alias("avg_rank"), F.count("*").alias("n_blocks"))


def friedman(df: DataFrame, block: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    """The Friedman statistic with correction for ties, from sums of exact ranks."""
    ranks = block_ranks(df, block, item, value)
    sums = ranks.groupBy(item).agg(F.sum("rank").alias("r"), F.count("*").alias("n")).agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.max("n").alias("n"), F.count("*").alias("k"))
    ties = ranks.groupBy(*block, "rank").agg(F.count("*").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    plain = 12 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    return sums.crossJoin(ties).select("k", "n", (plain / (1 - F.col("ties") / (n * (k * k * k - k)))).alias("statistic"))


def nemenyi(df: DataFrame, block: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    """The critical difference for as many items and blocks as there are."""
    q = F.create_map(*(F.lit(x) for kv in NEMENYI_Q.items() for x in kv))
    ranks = block_means(df, block, item, value)
    size = ranks.agg(F.count_distinct(item).alias("k"), F.count("*").alias("rows")).select("k", (F.col("rows") / F.col("k")).cast("bigint").alias("n"))
    return size.select("k", "n", (q[F.col("k").cast("int")] * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))


def cd_groups(df: DataFrame, block: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    """Longest runs of items, by mean rank, that lie within the critical difference: first, last, size."""
    ranks = mean_ranks(df, block, item, value)
    order = W.orderBy("avg_rank", item)  # as many rows as items
    placed = ranks.withColumn("i", F.row_number().over(order)).crossJoin(F.broadcast(nemenyi(df, block, item, value).select("cd")))
    a, b = placed.alias("a"), placed.select("i", "avg_rank", item).alias("b")
    reach = a.join(b, (F.col("b.i") >= F.col("a.i")) & (F.col("b.avg_rank") - F.col("a.avg_rank") <= F.col("a.cd"))).groupBy("a.i").agg(
        F.max("b.i").alias("last_i"), F.first(f"a.{item}").alias("first_item"), F.max_by(f"b.{item}", "b.i").alias("last_item")
    )
    before = F.max("last_i").over(W.orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    kept = reach.withColumn("_before", before).where((F.col("last_i") > F.col("i")) & (F.col("_before").isNull() | (F.col("last_i") > F.col("_before"))))
    return kept.select("first_item", "last_item", (F.col("last_i") - F.col("i") + 1).cast("bigint").alias("size"))


def pair_counts(df: DataFrame, block: Sequence[str], item: str, value: str) -> DataFrame:
    """For each ordered pair of items: blocks in which the first is better, as good, worse. One row an item and block comes in."""
    a = df.select(*block, F.col(item).alias("a"), F.col(value).alias("_x"))
    b = df.select(*block, F.col(item).alias("b"), F.col(value).alias("_y"))
    return a.join(b, list(block)).where("a <> b").groupBy("a", "b").agg(
        F.count_if(F.col("_x") > F.col("_y")).alias("wins"), F.count_if(F.col("_x") == F.col("_y")).alias("ties"), F.count_if(F.col("_x") < F.col("_y")).alias("losses")
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided p: twice the lower binomial tail, at most 1; 1 without a decision."""
    n, k = (wins + losses).cast("int"), F.least(wins, losses).cast("int")
    # C(n, i) / 2^n by i, built up from one term to the next
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("term"), F.pow(F.lit(0.5), n.cast("double")).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1).cast("double") / i.cast("double")
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, p: str, seq: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values in ``p_holm``."""
    part = W.partitionBy(*partition) if partition else W.partitionBy(F.lit(0))
    order = part.orderBy(F.col(p), *seq)
    m, r = F.count("*").over(part), F.row_number().over(order) - 1
    return df.withColumn("_raw", F.least(F.lit(1.0), (m - r) * F.col(p))).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_raw")


def lcb_winner(df: DataFrame, by: Sequence[str], item: str, value: str = "test_score") -> DataFrame:
    """Winner of each group by the lower confidence bound, its exact equals, and ties within a pooled error of the top mean."""
    s = summary(df, [*by, item], value).withColumn("lcb", F.round(F.col("mean") - F.col("std") / F.sqrt("n"), 9))
    w = first_of(s, by, "lcb", [item]).select(*(F.col(c).alias(f"_{c}") for c in by), F.col(item).alias("winner"), F.col("mean").alias("w_mean"), F.col("std").alias("w_std"), F.col("n").alias("w_n"))
    met = s.withColumn("top_mean", F.max("mean").over(W.partitionBy(*by))).join(w, [F.col(c) == F.col(f"_{c}") for c in by])
    equal = (F.abs(F.col("mean") - F.col("w_mean")) < 1e-9) & (F.abs(F.col("std") - F.col("w_std")) < 1e-9)
    other = F.col(item) != F.col("winner")
    error = F.sqrt(F.col("w_std") * F.col("w_std") / F.col("w_n") + F.col("std") * F.col("std") / F.col("n"))
    tie = other & ~equal & (F.col("top_mean") - F.col("mean") <= error)
    return met.groupBy(*by, "winner").agg(F.max("w_mean").alias("mean"), F.count_if(other & equal).alias("co_winners"), F.count_if(tie).alias("ties"))


def composite_rank(df: DataFrame, item: str = "method", task: str = "task", weights: dict[str, float] = COMPOSITE_WEIGHTS) -> DataFrame:
    """Weighted mean of an item's ranks in accuracy, stability, generalisation, tokens and speed (calls stand for time)."""
    stability = df.groupBy(item, task).agg(F.coalesce(F.stddev_samp("test_score"), F.lit(0.0)).alias("s")).groupBy(item).agg(mean("s").alias("stability"))
    dims = df.groupBy(item).agg(mean("test_score").alias("accuracy"), F.round(F.avg("best_dev") - F.avg("test_score"), 9).alias("generalization"), mean("tokens").alias("token_cost"), mean("calls").alias("speed")).join(stability, item)
    total = None
    for d, w in weights.items():
        dims = dims.withColumn(f"rank_{d}", average_rank(F.col(d), [], descending=d == "accuracy"))
        total = F.col(f"rank_{d}") * w if total is None else total + F.col(f"rank_{d}") * w
    return dims.select(item, *(f"rank_{d}" for d in weights), total.alias("composite"))


def anova_shares(df: DataFrame, row: str = "model", column: str = "method", value: str = "macro") -> DataFrame:
    """Percent of variance by row, column, their interaction and within cells (unweighted cell means)."""
    cells = df.groupBy(row, column).agg(F.avg(value).alias("m"), F.count("*").alias("n"), F.var_pop(value).alias("v"))
    r, c = cells.groupBy(row).agg(F.avg("m").alias("rm")), cells.groupBy(column).agg(F.avg("m").alias("cm"))
    g = cells.agg(F.avg("m").alias("g"))
    met = cells.join(r, row).join(c, column).crossJoin(F.broadcast(g))
    sq = lambda x: x * x
    sums = met.agg(
        F.sum(sq(F.col("rm") - F.col("g"))).alias("a"), F.sum(sq(F.col("cm") - F.col("g"))).alias("b"),
        F.sum(F.col("n") * sq(F.col("m") - F.col("rm") - F.col("cm") + F.col("g"))).alias("i"), F.sum(F.col("n") * F.col("v")).alias("w"),
    )
    total = F.col("a") + F.col("b") + F.col("i") + F.col("w")
    return sums.select(*((100 * F.col(s) / total).alias(n) for s, n in (("a", "row_share"), ("b", "column_share"), ("i", "interaction_share"), ("w", "within_share"))))


def kendall_w(ranks: DataFrame, block: Sequence[str], item: str, rank: str = "rank") -> DataFrame:
    """Agreement of blocks on the ranks of items."""
    sums = ranks.groupBy(item).agg(F.sum(rank).alias("r"), F.count("*").alias("m"))
    s = sums.agg(F.sum(F.col("r") * F.col("r")).alias("ss"), F.sum("r").alias("sr"), F.count("*").alias("n"), F.max("m").alias("m"))
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    return s.select(F.col("m"), F.col("n"), (12 * (F.col("ss") - F.col("sr") * F.col("sr") / n) / (m * m * (n * n * n - n))).alias("w"))


def rank_correlation(ranks: DataFrame, block: str, item: str, rank: str = "rank") -> DataFrame:
    """Spearman's correlation of each pair of blocks, from the ranks of their items."""
    a = ranks.select(F.col(block).alias("a"), item, F.col(rank).alias("_x"))
    b = ranks.select(F.col(block).alias("b"), item, F.col(rank).alias("_y"))
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.round(F.corr("_x", "_y"), 6).alias("rho"))


def cliffs_delta(df: DataFrame, item: str, value: str) -> DataFrame:
    """For each pair of items how much more often a value of the first exceeds one of the second.

    Counts come from a running total over the sorted values, so pairs of rows are never formed: items
    are few, rows are not.
    """
    values = df.groupBy(item, value).agg(F.count("*").alias("n"))
    ladder = values.withColumn("below", F.sum("n").over(W.partitionBy(item).orderBy(value)) - F.col("n"))
    sizes = values.groupBy(item).agg(F.sum("n").alias("size"))
    # at every distinct value of all items, how many of an item lie below and at it
    points = df.select(value).distinct().crossJoin(F.broadcast(df.select(item).distinct()))
    filled = points.join(ladder, [item, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    at = filled.withColumn("below", F.sum("n").over(W.partitionBy(item).orderBy(value)) - F.col("n"))
    a = at.where("n > 0").select(F.col(item).alias("a"), value, F.col("n").alias("na"))
    b = at.select(F.col(item).alias("b"), value, F.col("n").alias("nb"), F.col("below").alias("lb"))
    pairs = a.join(b, value).where("a <> b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("lb")).alias("gt"), F.sum(F.col("na") * F.col("nb")).alias("eq"))
    sa, sb = sizes.select(F.col(item).alias("a"), F.col("size").alias("sa")), sizes.select(F.col(item).alias("b"), F.col("size").alias("sb"))
    met = pairs.join(sa, "a").join(sb, "b")
    total = F.col("sa") * F.col("sb")
    delta = (2 * F.col("gt") + F.col("eq") - total) / total
    size = F.when(F.abs(delta) < CLIFF_BOUNDS[0][0], CLIFF_BOUNDS[0][1])
    for bound, name in CLIFF_BOUNDS[1:]:
        size = size.when(F.abs(delta) < bound, name)
    return met.select("a", "b", F.round(delta, 9).alias("delta"), size.otherwise("large").alias("magnitude"))


def expected_max(df: DataFrame, by: Sequence[str], value: str, draws: Sequence[int]) -> DataFrame:
    """Expected best of n draws with replacement, for each n."""
    placed = df.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(W.partitionBy(*by).orderBy(value))).withColumn("N", F.count("*").over(W.partitionBy(*by)))
    spread = placed.withColumn("n_draws", F.explode(F.array(*map(F.lit, draws))))
    term = F.col(value) * (F.pow(F.col("i") / F.col("N"), F.col("n_draws")) - F.pow((F.col("i") - 1) / F.col("N"), F.col("n_draws")))
    return spread.groupBy(*by, "n_draws").agg(F.round(F.sum(term), 6).alias("expected_max"))


def minimum_detectable(p: Column, n: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    """Smallest difference that n samples at rate p can tell; 1 without samples."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    p = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return F.when(n <= 0, 1.0).otherwise(z * F.sqrt(F.greatest(p * (1 - p), 1.0 / n) / n))


def hoeffding_bound(n: Column, alpha: float = 0.05) -> Column:
    return F.sqrt(F.lit(math.log(2.0 / alpha)) / (2 * n))


def trap_test(rate: Column, base: Column, n: Column, alpha: float = 0.05, least_n: int = 16) -> tuple[Column, Column]:
    """z of a rate below its base, and whether it is a trap."""
    critical = 1.645 if alpha <= 0.05 else 1.282
    z = (rate - base) / F.sqrt(F.greatest(base * (1 - base), F.lit(1e-9)) / n)
    return z, (n >= least_n) & (z <= -critical)


def barrier_score(mean_score: Column, words: Column, start: float, cap: float, weight: float = 1.0) -> Column:
    over = F.greatest(F.lit(0.0), (words - start) / max(1.0, cap - start))
    return F.greatest(F.lit(0.0), mean_score - weight * over * over * over)


def bradley_terry(wins: list[list[float]], rounds: int = 200, eps: float = 1e-9) -> list[float]:
    """Strengths by minorisation; the matrix has as many rows as there are methods."""
    n = len(wins)
    s = [1.0] * n
    for _ in range(rounds):
        new = [sum(wins[i]) / max(eps, sum((wins[i][j] + wins[j][i]) / (s[i] + s[j]) for j in range(n) if j != i)) for i in range(n)]
        total = sum(new)
        new = [x / total * n for x in new]
        if max(abs(a - b) for a, b in zip(s, new)) < eps:
            return new
        s = new
    return s


def bradley_terry_bootstrap(df: DataFrame, block: Sequence[str], item: str, value: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """``item, low, high``: the middle 95 % of strengths over draws of as many blocks as there are, with replacement.

    A draw's blocks are picked by a hash of draw, turn and seed, counted, and met with the pairs that each block decides;
    each draw's matrix, of as many rows as there are items, is fitted in one task of its own.
    """
    ship(df.sparkSession)
    places = cut(numbered(df.select(*block).distinct(), [F.col(c) for c in block], "_place"))
    n = places.count()
    a = df.select(*block, F.col(item).alias("a"), F.col(value).alias("_x"))
    b = df.select(*block, F.col(item).alias("b"), F.col(value).alias("_y"))
    won = a.join(b, list(block)).where("a <> b").select(*block, "a", "b", F.when(F.col("_x") > F.col("_y"), 1.0).when(F.col("_x") == F.col("_y"), 0.5).otherwise(0.0).alias("won"))
    turns = df.sparkSession.range(draws * n).select((F.col("id") / F.lit(max(1, n))).cast("long").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n))) + 1).alias("_place"))
    picked = turns.groupBy("draw", "_place").agg(F.count("*").alias("times"))
    matrices = won.join(places, list(block)).join(picked, "_place").groupBy("draw", "a", "b").agg(F.sum(F.col("won") * F.col("times")).alias("won"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows["a"]))
        known = {(x, y): w for x, y, w in zip(rows["a"], rows["b"], rows["won"])}
        return pd.DataFrame({"item": names, "strength": bradley_terry([[known.get((x, y), 0.0) for y in names] for x in names])})

    fitted = matrices.groupBy("draw").applyInPandas(fit, "item string, strength double")
    return fitted.groupBy(F.col("item").alias(item)).agg(F.percentile("strength", F.lit(0.025)).alias("low"), F.percentile("strength", F.lit(0.975)).alias("high"))


def signed_ranks(df: DataFrame, by: Sequence[str], difference: str) -> DataFrame:
    """``by, n, up, down, tied`` of each group: differences that are not 0, their rank sums above and below, and t^3 - t over ties.

    Ranks are average ranks of the absolute differences; groups without a difference have 0 throughout.
    """
    some = df.withColumn("_d", F.when(F.col(difference) != 0, F.abs(F.col(difference))))
    per = [*by, "_d"]
    ties = F.when(F.col("_d").isNotNull(), F.count("*").over(W.partitionBy(*per)))
    # nulls come first and are no part of the ranks
    place = F.rank().over(W.partitionBy(*by, F.col("_d").isNull()).orderBy("_d"))
    ranked = some.withColumn("_t", ties).withColumn("_rank", place + (F.col("_t") - 1) / F.lit(2.0))
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("_rank"))), F.lit(0.0))
    return ranked.groupBy(*by).agg(
        F.count("_d").alias("n"), total(F.col(difference) > 0).alias("up"), total(F.col(difference) < 0).alias("down"), F.coalesce(F.sum(F.col("_t") * F.col("_t") - 1), F.lit(0)).alias("tied")
    )


def normal_below(z: Column) -> Column:
    """The standard normal distribution: its density times a series of odd powers, to the last digits of a double."""
    start = F.struct(z.cast("double").alias("term"), z.cast("double").alias("sum"))

    def step(s: Column, k: Column) -> Column:
        term = s["term"] * z * z / (2.0 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["sum"])
    inside = F.lit(0.5) + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(z < -8, 0.0).when(z > 8, 1.0).otherwise(inside)


def wilcoxon_p(n: Column, up: Column, down: Column, tied: Column, exact: int = 50) -> Column:
    """Two-sided p of signed ranks: exact without ties up to ``exact`` differences, else normal with tie correction; 1 without a difference.

    The exact one counts the subsets of 1..n by their sums, an array that each number shifts and adds to itself.
    """
    w = F.least(up, down)
    top = F.floor(w).cast("int")
    zeros = lambda k: F.array_repeat(F.lit(0.0), k)
    # numbers beyond the sum cannot be part of it
    add = lambda ways, k: F.zip_with(ways, F.concat(zeros(k), F.slice(ways, F.lit(1), F.size(ways) - k)), lambda a, b: a + b)
    ways = F.aggregate(F.filter(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda k: k <= top), F.concat(F.array(F.lit(1.0)), zeros(top)), add)
    below = F.aggregate(ways, F.lit(0.0), lambda a, x: a + x)
    few = (tied == 0) & (n <= exact)
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - tied / F.lit(2.0)) / F.lit(24.0))
    z = (w - n * (n + 1) / F.lit(4.0)) / spread
    p = F.when(few, 2 * below / F.pow(F.lit(2.0), n.cast("double"))).otherwise(2 * normal_below(z))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


#: The distribution of the Poisson law with mean 1, up to 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974149)
_PRIME = 2147483647


def resampling_weight(key: Column, draw: Column) -> Column:
    """How often a row is drawn in a resample: Poisson with mean 1, from its key (a text) and the draw, by whole numbers alone."""
    start = F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")
    mixed = F.pmod((start + 1) * 48271 + draw.cast("bigint") * 69621, F.lit(_PRIME))
    for _ in range(2):
        mixed = F.pmod(mixed * mixed + 12345, F.lit(_PRIME))
    u = mixed / F.lit(float(_PRIME))
    return sum(((u >= p).cast("bigint") for p in POISSON[1:]), (u >= POISSON[0]).cast("bigint"))


def bootstrap_interval(df: DataFrame, by: Sequence[str], value: str, key: Column, resamples: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean of each group, by Poisson resampling.

    Each row draws its weight in every resample by itself, and weights and weighted values are added up where the
    rows are; so no task holds a group, and rows may come in any order. ``key`` names a row, as a text.
    """
    drawn = df.where(F.col(value).isNotNull()).select(*by, value, key.alias("_k")).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    weighed = drawn.withColumn("_w", resampling_weight(F.col("_k"), F.col("_b"))).where("_w > 0")
    means = weighed.groupBy(*by, "_b").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("_m"))
    return means.groupBy(*by).agg(F.percentile("_m", F.lit(alpha / 2)).alias("low"), F.percentile("_m", F.lit(1 - alpha / 2)).alias("high"))


def method_report(df: DataFrame) -> DataFrame:
    """For each model and method with all tasks and seeds: macro mean, deviation, mean rank over tasks, cost, whether it is on the cost front, its place."""
    tasks = df.agg(F.count_distinct("task").alias("_t"))
    macro = df.groupBy("model", "method", "seed").agg(mean("test_score").alias("macro"), F.count_distinct("task").alias("_n")).join(F.broadcast(tasks), F.col("_n") == F.col("_t"))
    scores = summary(macro, ["model", "method"], "macro").withColumnRenamed("n", "n_seeds")
    ranks = block_ranks(df, ["model", "task"], "method").groupBy("model", "method").agg(F.round(F.avg("rank"), 9).alias("avg_rank"))
    cost = df.groupBy("model", "method").agg(mean("tokens").alias("tokens"))
    met = scores.join(ranks, ["model", "method"]).join(cost, ["model", "method"])
    on = front(met, "mean", "tokens", strict_both=True, partition=["model"]).select("model", "method", F.lit(True).alias("on_front"))
    placed = met.join(on, ["model", "method"], "left").withColumn("on_front", F.coalesce("on_front", F.lit(False)))
    return placed.withColumn("place", F.row_number().over(W.partitionBy("model").orderBy(F.desc("mean"), "method")))
