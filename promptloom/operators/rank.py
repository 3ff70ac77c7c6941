"""Ranking operators: ties by insertion order, average-tie ranks, fronts, first of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import cut


def average_rank(value: Column, partition: Sequence[str], descending: bool = True) -> Column:
    """Ranks within a block where ties share their mean rank."""
    order = W.partitionBy(*partition).orderBy(value.desc() if descending else value.asc())
    return (F.rank().over(order) + (F.count("*").over(W.partitionBy(*partition, value)) - 1) / F.lit(2.0)).cast("double")


def numbered(df: DataFrame, order: Sequence[Column], into: str) -> DataFrame:
    """``df`` with the place of each row by ``order``, from 1, over all rows and without a task that sees them all.

    Rows are dealt by ranges and sorted within; a range's rows begin after those of the ranges before it, of
    which there are as many as shuffle partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumns({"_range": F.spark_partition_id(), "_within": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = placed.groupBy("_range").agg(F.count("*").alias("_n")).select(F.col("_range").alias("_begins"), before.alias("_before"))
    met = placed.join(F.broadcast(begins), F.col("_range") == F.col("_begins"))
    return met.withColumn(into, F.col("_before") + F.col("_within") + 1).drop("_range", "_begins", "_within", "_before")


def running_totals(df: DataFrame, order: Sequence[Column], values: Sequence[str], suffix: str = "_so_far") -> DataFrame:
    """``df`` with the sum of each of ``values`` up to and with each row by ``order``, over all rows and without a task that sees them all.

    Rows are dealt by ranges; a range's sums begin with the totals of the ranges before it, of which there are as many as shuffle partitions.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    begins = totals.select(F.col("_range").alias("_begins"), *(F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_before_{v}") for v in values))
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = ranged.join(F.broadcast(begins), F.col("_range") == F.col("_begins"))
    return met.withColumns({f"{v}{suffix}": F.sum(v).over(within) + F.col(f"_before_{v}") for v in values}).drop("_range", "_begins", *(f"_before_{v}" for v in values))


def top_k(df: DataFrame, k: int, order: Sequence[Column], partition: Sequence[str] = (), into: str | None = None) -> DataFrame:
    """The first ``k`` rows by ``order``, of all or of each group. Without groups no window is needed."""
    if not partition and into is None:
        return df.orderBy(*order).limit(k)
    name = into or "_place"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*partition).orderBy(*order))).where(F.col(name) <= k)
    return ranked if into else ranked.drop(name)


def rank_order(dev: str = "dev", score: str = "score", seq: str = "record_id") -> list[Column]:
    """Dev-scored records before all others, then by score, ties by insertion order."""
    return [F.col(dev).isNotNull().desc(), F.col(score).desc(), F.col(seq).asc()]


def front(df: DataFrame, gain: str, cost: str, strict_both: bool = False, partition: Sequence[str] = ()) -> DataFrame:
    """Rows that no other row dominates: more ``gain`` and less ``cost`` are better.

    One sort instead of a nested-loop join. A row is dominated by one at least as good in both and
    better in one; with ``strict_both`` only by one that is better in both.
    """
    levels = df.groupBy(*partition, cost).agg(F.max(gain).alias("_best"))
    before = F.max("_best").over(W.partitionBy(*partition).orderBy(F.col(cost).asc()).rowsBetween(W.unboundedPreceding, -1))
    levels = levels.withColumn("_before", before).select(*(F.col(c).alias(f"_{c}") for c in (*partition, cost)), "_best", "_before")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*partition, cost)]
    met = df.join(levels, on)
    free = F.col("_before").isNull() | ((F.col(gain) >= F.col("_before")) if strict_both else (F.col(gain) > F.col("_before")))
    keep = free if strict_both else free & (F.col(gain) == F.col("_best"))
    return met.where(keep).select(*df.columns)


def staircase(df: DataFrame, gain: str, cost: str, seq: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Rows that, by rising cost, reach a new maximum of gain."""
    order = W.partitionBy(*partition).orderBy(F.col(cost).asc(), *(F.col(s).asc() for s in seq))
    best = F.max(gain).over(order.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(gain) > F.col("_best"))).drop("_best")


def first_of(df: DataFrame, partition: Sequence[str], value: str, seq: Sequence[str], descending: bool = True) -> DataFrame:
    """The row of each group with the largest (or smallest) value; nulls last, ties by ``seq``."""
    v = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    return top_k(df, 1, [v, *(F.col(s).asc() for s in seq)], partition, "_place").drop("_place")
