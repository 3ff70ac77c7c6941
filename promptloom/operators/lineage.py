"""Lineage of records: parents, closures, first-parent chains, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, text_hash
from ..sources.storage import cut


def edges(records: DataFrame) -> DataFrame:
    """``child_id, parent_id, position`` of each parent named."""
    return records.select(F.col("record_id").alias("child_id"), F.posexplode("parent_ids").alias("position", "parent_id"))


def ancestors(records: DataFrame, starts: DataFrame, max_depth: int = 64) -> DataFrame:
    """Every ancestor of each start with the fewest steps to it, itself at 0.

    One join a level; a level holds only what was not reached before, so cycles end.
    """
    known = records.select(F.col("record_id").alias("_known"))
    e = cut(edges(records).select("child_id", "parent_id").distinct().join(known, F.col("parent_id") == F.col("_known"), "left_semi"))
    reached = frontier = starts.select(F.col("record_id").alias("start_id"), F.col("record_id").alias("ancestor_id"), F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, F.col("ancestor_id") == F.col("child_id")).select("start_id", F.col("parent_id").alias("ancestor_id")).distinct()
        step = step.join(reached.select("start_id", "ancestor_id"), ["start_id", "ancestor_id"], "left_anti")
        frontier = cut(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def ancestors_sql(records: str, starts: str, max_depth: int = 16) -> str:
    """The same closure as one recursive query over two views, for depths that a recursion limit allows."""
    return f"""
    with recursive up(start_id, ancestor_id, depth) as (
        select record_id, record_id, 0 from {starts}
        union all
        select u.start_id, e.parent_id, u.depth + 1 from up u join (select record_id as child_id, explode(parent_ids) as parent_id from {records}) e on u.ancestor_id = e.child_id where u.depth < {max_depth}
    ) select start_id, ancestor_id, min(depth) as depth from up group by start_id, ancestor_id"""


def first_parent_roots(records: DataFrame, max_hops: int = 13) -> DataFrame:
    """``start_id, hops, root_id``: where first parents lead in at most so many steps, each counted; cycles are followed.

    Jumps are doubled, so a few joins serve; rows that have come to their end leave them, and no recursion limit applies.
    """
    parent = F.try_element_at("parent_ids", F.lit(1))
    known = records.select("record_id", parent.alias("parent_id")).distinct()
    jump = cut(known.select(F.col("record_id").alias("start_id"), F.coalesce("parent_id", "record_id").alias("root_id"), F.col("parent_id").isNotNull().cast("int").alias("hops")))

    def after(first: DataFrame, length: int, then: DataFrame) -> DataFrame:
        steps = then.select(F.col("start_id").alias("_at"), F.col("root_id").alias("_to"), F.col("hops").alias("_more"))
        going = first.where(F.col("hops") == length).join(steps, F.col("root_id") == F.col("_at"), "left")
        went = going.select("start_id", F.coalesce("_to", "root_id").alias("root_id"), (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"))
        return cut(first.where(F.col("hops") < length).unionByName(went))

    made, done = None, 0
    for bit in range(max_hops.bit_length()):
        if max_hops >> bit & 1:
            made, done = (jump if made is None else after(made, done, jump)), done + (1 << bit)
        if max_hops >> bit > 1:
            jump = after(jump, 1 << bit, jump)
    return made.groupBy("start_id").agg(F.max("hops").alias("hops"), F.max_by("root_id", "hops").alias("root_id"))


def child_with_parent(records: DataFrame, *columns: str) -> DataFrame:
    """Each record beside its first parent's columns (``parent_...``); null without one."""
    first = records.withColumn("_p", F.try_element_at("parent_ids", F.lit(1)))
    parents = records.select(F.col("record_id").alias("_id"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    return first.join(parents, F.col("_p") == F.col("_id"), "left").drop("_p", "_id")


def without_duplicates(records: DataFrame, seq: str = "record_id") -> DataFrame:
    """The first of each stripped text. Hashes are reduced first; texts are not moved to find the first."""
    keys = records.withColumn("_h", text_hash(strip(F.coalesce("text", F.lit("")))))
    first = keys.groupBy("_h").agg(F.min(seq).alias("_first")).select("_first")
    return records.join(first, F.col(seq) == F.col("_first"), "left_semi")


def unseen(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates whose stripped text no record of the history has."""
    h = history.select(text_hash(strip(F.coalesce("text", F.lit("")))).alias("_h")).distinct()
    return candidates.withColumn("_c", text_hash(strip(F.coalesce("text", F.lit(""))))).join(h, F.col("_c") == F.col("_h"), "left_anti").drop("_c")
