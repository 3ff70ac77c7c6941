"""Stand-ins for experiment tables, built from the driver's star schema (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (model, method, task, seed): calls, tokens, test score, best dev score.

    Sums are decimal, so they do not depend on the order of rows; scores are one division of them.
    The joins carry the few columns that the sums need; nations and regions are tables of fixed size.
    """
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("model"))
    customers = t("customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "model", F.col("c_mktsegment").alias("method"))
    orders = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "model", "method", F.col("o_orderpriority").alias("task"))
    items = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("seed"), F.col("l_quantity").cast("decimal(18,2)").alias("q"), (1 - F.col("l_discount")).cast("decimal(18,2)").alias("d"))
    sums = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("model", "method", "task", "seed").agg(F.count("*").alias("calls"), F.sum("q").alias("q"), F.sum("d").alias("d"))
    return sums.select(
        "model", "method", "task", F.col("seed").cast("long").alias("seed"), "calls",
        F.col("q").cast("double").alias("tokens"),
        (F.col("q").cast("double") / (50 * F.col("calls"))).alias("test_score"),
        (F.col("d").cast("double") / F.col("calls")).alias("best_dev"),
    )


RUNS_SQL = """
select r_name as model, c_mktsegment as method, o_orderpriority as task, cast(l_linenumber as bigint) as seed,
    count(*) as calls,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) as tokens,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) / (50 * count(*)) as test_score,
    cast(sum(cast(1 - l_discount as decimal(18,2))) as double) / count(*) as best_dev
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by all
"""


def with_runs(sql: str) -> str:
    return f"with runs as ({RUNS_SQL}) {sql.strip()}" if not sql.strip().startswith("with ") else f"with runs as ({RUNS_SQL}), {sql.strip()[5:]}"


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (candidate, sample): whether any reading of the pair reaches 75, and when it began."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("record_id"), F.col("event_type").alias("sample_id")).agg(
        (F.count_if(F.col("value") >= 75) * 2 >= F.count("*")).cast("int").alias("correct")
    )


EVALUATIONS_SQL = """
select user_id as record_id, event_type as sample_id,
    cast(count(*) filter (value >= 75) * 2 >= count(*) as integer) as correct
from events group by all
"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an ordered stream of 0/1 outcomes of candidates: ``record_id, n, correct``."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("record_id"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("n"),
        (F.col("value") >= 60).cast("int").alias("correct"), "event_id",
    )


TRIALS_SQL = """
select user_id as record_id, row_number() over (partition by user_id order by ts, event_id) as n,
    cast(value >= 60 as integer) as correct, event_id
from events
"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as prompt records: id in order of insertion, text, operator, parents, dev score, generation."""
    d = table(spark, sf_dir, "documents")
    score = F.pmod(F.col("doc_id") * 7919, F.lit(1000)) / F.lit(1000.0)
    return d.select(
        F.col("doc_id").alias("record_id"), "text", F.col("lang").alias("operator"), F.col("source").alias("method"),
        F.when(F.col("doc_id") > 0, F.array(F.floor(F.col("doc_id") / 2), F.floor(F.col("doc_id") / 3))).otherwise(F.array().cast("array<bigint>")).alias("parent_ids"),
        F.when(F.col("doc_id") % 4 != 3, score).alias("dev"), score.alias("score"),
        F.floor(F.log2(F.col("doc_id") + 1.0)).cast("int").alias("generation"), "n_chars",
    )


PROMPTS_SQL = """
select doc_id as record_id, text, lang as operator, source as method,
    case when doc_id > 0 then [doc_id // 2, doc_id // 3] else cast([] as bigint[]) end as parent_ids,
    case when doc_id % 4 <> 3 then ((doc_id * 7919) % 1000) / 1000.0::double end as dev,
    ((doc_id * 7919) % 1000) / 1000.0::double as score,
    cast(floor(log2(doc_id + 1.0)) as integer) as generation, n_chars
from documents
"""


def named(name: str, body: str, sql: str) -> str:
    """``sql`` with a table ``name`` in front."""
    sql = sql.strip()
    return f"with {name} as ({body}), {sql[5:]}" if sql.startswith("with ") else f"with {name} as ({body}) {sql}"
