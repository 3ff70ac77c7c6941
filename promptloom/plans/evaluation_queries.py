"""Queries over outcomes and event streams, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.failures import failures_shown
from ..operators import evaluate as E
from ..operators import select as S
from ..operators.rank import first_of, numbered
from ..sources.fixtures import EVALUATIONS_SQL, TRIALS_SQL, evaluations, named, table, trials
from ..sources.storage import cut, remove_folder, shared_folder
from ..streaming.outcomes import stream, write_once
from ..streaming.racing import racing_stops

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = named("ev", EVALUATIONS_SQL, sql) if over == "ev" else named("trials", TRIALS_SQL, sql) if over == "trials" else sql
        return f

    return keep


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("accuracy_by_record", "select record_id, cast(sum(correct) as bigint) as num_correct, count(*) as num_total, round(sum(correct) / count(*), 6) as score from ev group by all", "ev")
def _(s, d):
    return rounded(E.accuracy(evaluations(s, d), ["record_id"]), "score")


@query("failed_cases", "select record_id, sample_id from ev where correct = 0", "ev")
def _(s, d):
    return evaluations(s, d).where("correct = 0").select("record_id", "sample_id")


@query("both_outcomes", "select record_id, count(*) filter (correct = 1) as right_n, count(*) filter (correct = 0) as wrong_n from ev group by all having count(*) filter (correct = 1) > 0 and count(*) filter (correct = 0) > 0", "ev")
def _(s, d):
    return evaluations(s, d).groupBy("record_id").agg(F.count_if(F.col("correct") == 1).alias("right_n"), F.count_if(F.col("correct") == 0).alias("wrong_n")).where("right_n > 0 and wrong_n > 0")


_RACE = """with r as (select *, sum(correct) over (partition by record_id order by n rows unbounded preceding) / n as score, count(*) over (partition by record_id) as total from trials)"""


@query("racing_stop_sample", _RACE + " select record_id, min(n) filter (n >= 10 and score + sqrt(ln(2.0 / 0.05) / (2 * n)) < 0.75) as stop_n, count(*) as available from r group by record_id", "trials")
def _(s, d):
    return E.racing(trials(s, d), 0.75)


@query("racing_stop_batch", _RACE + " select record_id, min(n) filter (n % 8 = 0 and n >= 8 and n < total and score + sqrt(ln(2.0 / 0.05) / (2 * n)) < 0.75) as stop_n, count(*) as available from r group by record_id", "trials")
def _(s, d):
    return E.racing(trials(s, d), 0.75, batch=8)


@query("racing_stream", _RACE + ", st as (select record_id, min(n) filter (n >= 10 and score + sqrt(ln(2.0 / 0.05) / (2 * n)) < 0.75) as stop_n from r group by record_id) select record_id, stop_n from st where stop_n is not null", "trials")
def _(s, d):
    made = trials(s, d).select("record_id", "n", "correct")
    folder = shared_folder(s, "racing")
    try:
        made.repartition(8, F.xxhash64("record_id", "n")).write.parquet(f"{folder}/in")  # so outcomes arrive in no order
        stops = racing_stops(stream(s, f"{folder}/in", made.schema, files=3), 0.75)
        write_once(stops, f"{folder}/out", f"{folder}/progress").awaitTermination()
        return cut(s.read.schema("record_id long, stop_n long").parquet(f"{folder}/out"))
    finally:
        remove_folder(s, folder)


@query("racing_outcome", _RACE + """, st as (select record_id, min(n) filter (n >= 10 and score + sqrt(ln(2.0 / 0.05) / (2 * n)) < 0.75) as stop_n from r group by record_id)
select record_id, count(*) as evaluated, cast(sum(correct) as bigint) as num_correct, bool_or(stop_n is not null) as terminated from trials join st using (record_id) where stop_n is null or n <= stop_n group by record_id""", "trials")
def _(s, d):
    t = trials(s, d)
    return E.raced(t, E.racing(t, 0.75))


@query("discrimination", "select sample_id, cast(sum(correct) as bigint) as solved, count(*) as n, round((sum(correct) / count(*)) * (1 - sum(correct) / count(*)), 6) as discrimination from ev group by all", "ev")
def _(s, d):
    return rounded(E.discrimination(evaluations(s, d)), "discrimination")


_ITEMS = "with it as (select user_id as record_id, event_id % 40 as sample_id, max(cast(value >= 97 as integer)) as correct from events group by all)"


def _items(s, d):
    """Sparse outcomes on forty samples."""
    e = table(s, d, "events")
    return e.groupBy(F.col("user_id").alias("record_id"), (F.col("event_id") % 40).alias("sample_id")).agg(F.max((F.col("value") >= 97).cast("int")).alias("correct"))


@query("signal_calibration", _ITEMS + """, d as (select sample_id, (sum(correct) / count(*)) * (1 - sum(correct) / count(*)) as disc from it group by all),
x as (select *, row_number() over (partition by disc <= 0 order by sample_id) as p, count(*) filter (disc > 0) over () as useful from d)
select sample_id, round(disc, 6) as discrimination from x where disc > 0 or p <= 12 - useful""")
def _(s, d):
    return rounded(E.calibrated_pool(_items(s, d), 12), "discrimination")


_EDGES = "e as (select r as child_id, unnest([r // 2, r // 3]) as parent_id from (select distinct user_id as r from events))"


def _edges(s, d):
    r = table(s, d, "events").select(F.col("user_id").alias("child_id")).distinct()
    return r.select("child_id", F.explode(F.array(F.floor(F.col("child_id") / 2), F.floor(F.col("child_id") / 3))).alias("parent_id")).distinct()


_RETENTION = f"""with {_EDGES}, ed as (select distinct child_id, parent_id from e), sol as (select record_id, sample_id from ev where correct = 1),
ret as (select child_id, parent_id, case when count(p.sample_id) = 0 then 1.0::double else count(c.sample_id) / count(p.sample_id) end as retention
from ed left join sol p on p.record_id = ed.parent_id left join sol c on c.record_id = ed.child_id and c.sample_id = p.sample_id group by all)"""


@query("retention", _RETENTION + " select child_id, parent_id, round(retention, 6) as retention from ret", "ev")
def _(s, d):
    return rounded(E.retention(evaluations(s, d), _edges(s, d)), "retention")


@query("guarded_accept", _RETENTION + """, sc as (select record_id, sum(correct) / count(*) as score from ev group by all),
g as (select child_id, max(retention) as retention, max(a.score) as child_score, max(b.score) as parent_best from ret left join sc a on a.record_id = child_id left join sc b on b.record_id = parent_id group by all)
select child_id, round(retention, 6) as retention, round(child_score, 6) as child_score, round(parent_best, 6) as parent_best,
    child_score is null or parent_best is null or child_score > parent_best or retention >= 0.5 as admitted from g""", "ev")
def _(s, d):
    ev = evaluations(s, d)
    return rounded(E.guarded_acceptance(E.retention(ev, _edges(s, d)), E.accuracy(ev, ["record_id"])), "retention", "child_score", "parent_best")


@query("minibatch_gate", """with g as (select record_id, avg(correct) filter (n <= 8) as mb, avg(correct) as full_score from trials group by all)
select record_id, case when mb + 0.1::double >= 0.5 then 'passed' else 'rejected' end as gate, round(case when mb + 0.1::double >= 0.5 then full_score else mb end, 6) as score from g""", "trials")
def _(s, d):
    return rounded(E.minibatch_gate(trials(s, d), 0.5, 0.1, 8), "score")


@query("phase_prefix", "select record_id, case when n <= 16 then 1 when n <= 20 then 2 when n <= 30 then 3 when n <= 40 then 4 end as phase, count(*) as n_rows, cast(sum(correct) as bigint) as solved from trials where n <= 40 group by all", "trials")
def _(s, d):
    return E.phase_rows(trials(s, d), E.phase_sizes(40)).groupBy("record_id", "phase").agg(F.count("*").alias("n_rows"), F.sum("correct").alias("solved"))


@query("phase_missing", "select record_id, count(*) as to_evaluate from trials t where n <= 30 and not exists (select 1 from trials x where x.record_id = t.record_id and x.n = t.n and x.n <= 16 + t.record_id % 8) group by all", "trials")
def _(s, d):
    t = trials(s, d)
    have = t.where("n <= 16 + record_id % 8").select("record_id", "n")
    return t.where("n <= 30").join(have, ["record_id", "n"], "left_anti").groupBy("record_id").agg(F.count("*").alias("to_evaluate"))


@query("solved_by_k", _ITEMS + ", k as (select sample_id, cast(sum(correct) as bigint) as k from it group by all) select k, count(*) as n_samples from k group by k")
def _(s, d):
    return E.solved_by(_items(s, d), "sample_id")


@query("oracle_union", _ITEMS + ", u as (select sample_id, bool_or(correct = 1) as any_solved from it group by all) select count(*) filter (any_solved) as solved, count(*) filter (not any_solved) as unsolved from u")
def _(s, d):
    u = _items(s, d).groupBy("sample_id").agg(F.bool_or(F.col("correct") == 1).alias("any_solved"))
    return u.agg(F.count_if("any_solved").alias("solved"), F.count_if(~F.col("any_solved")).alias("unsolved"))


_BY_TYPE = "with it as (select event_type as item, user_id as sample_id, max(cast(value >= 95 as integer)) as correct from events group by all)"


@query("jaccard_solved", _BY_TYPE + """, p as (select a.item as a, b.item as b, count(*) filter (a.correct = 1 and b.correct = 1) as common, count(*) filter (a.correct = 1 or b.correct = 1) as either
from it a join it b using (sample_id) where a.item < b.item group by all) select a, b, common, round(case when either > 0 then common / either end, 6) as jaccard from p""")
def _(s, d):
    it = table(s, d, "events").groupBy(F.col("event_type").alias("item"), F.col("user_id").alias("sample_id")).agg(F.max((F.col("value") >= 95).cast("int")).alias("correct"))
    return rounded(E.jaccard(it, "item", "sample_id"), "jaccard")


@query("majority_vote", "select user_id as record_id, event_type as sample_id, 2 * count(*) filter (value >= 60) >= count(*) as solved from events group by all")
def _(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("sample_id"), (F.col("value") >= 60).cast("int").alias("correct"))
    return E.majority(e, ["record_id", "sample_id"])


@query("pareto_coverage", "with b as (select *, max(correct) over (partition by sample_id) as best from ev) select record_id, count(*) as coverage from b where best > 0 and correct = best group by all", "ev")
def _(s, d):
    return E.instance_coverage(evaluations(s, d))


@query("gepa_front", _ITEMS + ", b as (select *, max(correct) over (partition by sample_id) as best from it) select record_id, count(*) as coverage from b where correct = best group by all")
def _(s, d):
    return E.instance_coverage(_items(s, d), positive=False)


@query("instance_winners", "with m as (select event_type as sample_id, user_id as record_id, round(max(value), 6) as v from events group by all), b as (select *, max(v) over (partition by sample_id) as best from m) select sample_id, record_id, v from b where v = best")
def _(s, d):
    m = table(s, d, "events").groupBy(F.col("event_type").alias("sample_id"), F.col("user_id").alias("record_id")).agg(F.round(F.max("value"), 6).alias("v"))
    return m.withColumn("best", F.max("v").over(W.partitionBy("sample_id"))).where("v = best").drop("best")


@query("best_so_far", "select event_id, user_id, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best_so_far from events")
def _(s, d):
    return E.best_so_far(table(s, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "best_so_far")


@query("elapsed", "select event_id, user_id, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6, 6) as elapsed from events qualify count(*) over (partition by user_id) >= 2")
def _(s, d):
    per = W.partitionBy("user_id")
    e = table(s, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.withColumn("n", F.count("*").over(per)).where("n >= 2").select("event_id", "user_id", F.round((F.col("us") - F.min("us").over(per)) / 1e6, 6).alias("elapsed"))


@query("anytime_auc", """with b as (select user_id, event_id, epoch_us(ts) as us, max(value) over (partition by user_id order by ts, event_id rows unbounded preceding) as best from events),
x as (select user_id, event_id, (us - min(us) over (partition by user_id)) / 1e6 as el, best from b),
g as (select *, lead(el) over (partition by user_id order by el, best) as el2, lead(best) over (partition by user_id order by el, best) as best2 from x)
select user_id, round(sum((el2 - el) * (best + best2) / 2) / max(el) / max(best), 6) as auc from g group by user_id having max(el) > 0 and count(*) >= 2""")
def _(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "ts", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    b = E.best_so_far(e, ["user_id"], ["ts", "event_id"], "value").withColumn("el", (F.col("us") - F.min("us").over(W.partitionBy("user_id"))) / 1e6)
    return rounded(E.anytime_area(b, ["user_id"], "el", "best_so_far"), "auc")


@query("interpolated_curve", """with p as (select event_type, cast(user_id as double) as x, round(avg(value), 6) as y from events group by all),
s as (select *, lead(x) over (partition by event_type order by x) as x1, lead(y) over (partition by event_type order by x) as y1, row_number() over (partition by event_type order by x) as i from p),
g as (select unnest([-1.0::double, 0.5, 10.25, 77.0, 1e9]) as g)
select event_type, g, round(case when (i = 1 and g < x) or x1 is null then y else y + (y1 - y) * (g - x) / (x1 - x) end, 6) as y from s, g where (g >= x and (x1 is null or g < x1)) or (i = 1 and g < x)""")
def _(s, d):
    p = table(s, d, "events").groupBy("event_type", F.col("user_id").cast("double").alias("x")).agg(F.round(F.avg("value"), 6).alias("y"))
    return rounded(E.interpolate(p, ["event_type"], "x", "y", F.array(*(F.lit(v) for v in (-1.0, 0.5, 10.25, 77.0, 1e9)))), "y")


@query("hop_delta", """with x as (select event_id, user_id, ts, case when value >= 20 then value end as dev from events)
select event_id, user_id, round(dev - last_value(dev ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 6) as delta from x""")
def _(s, d):
    x = table(s, d, "events").select("event_id", "user_id", "ts", F.when(F.col("value") >= 20, F.col("value")).alias("dev"))
    return rounded(E.hop_delta(x, ["user_id"], ["ts", "event_id"], "dev").select("event_id", "user_id", "delta"), "delta")


@query("last_minus_first", "select user_id, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) as gain from events group by user_id")
def _(s, d):
    at = F.struct("ts", "event_id")
    return table(s, d, "events").groupBy("user_id").agg(F.round(F.max_by("value", at) - F.min_by("value", at), 6).alias("gain"))


@query("rolling_eval_time", "select event_id, user_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 6) as rolling from events")
def _(s, d):
    return table(s, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)), 6).alias("rolling"))


@query("cumulative_candidates", """with c as (select user_id, date_trunc('day', ts) as day, count(*) as n from events group by all)
select user_id, cast(day as date) as day, n, cast(sum(n) over (partition by user_id order by day rows unbounded preceding) as bigint) as total from c""")
def _(s, d):
    c = table(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return c.withColumn("total", F.sum("n").over(W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


@query("patience_stop", """with o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events),
b as (select *, max(value) over (partition by user_id order by i rows between unbounded preceding and 1 preceding) as best from o),
l as (select *, max(case when best is null or value > best + 1e-12 then i end) over (partition by user_id order by i rows unbounded preceding) as last_up from b)
select user_id, min(i) filter (i - last_up >= 5) as stop_at from l group by user_id""")
def _(s, d):
    o = table(s, d, "events").select("user_id", "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"))
    return E.patience_stop(o, ["user_id"], "i", "value", 5)


_PULLS = "with pulls as (select event_type as arm, value / 100 - 0.5 as reward from events)"


def _pulls(s, d):
    return table(s, d, "events").select(F.col("event_type").alias("arm"), (F.col("value") / 100 - 0.5).alias("reward"))


_UCB = _PULLS + ", g as (select arm, count(*) as n, avg(reward) as mean, var_pop(reward) as v from pulls group by all), t as (select *, sum(n) over () as total from g)"


@query("ucb1_rank", _UCB + ", u as (select arm, n, round(mean + 0.5 * sqrt(ln(greatest(total, 2)) / n), 6) as ucb from t) select *, row_number() over (order by ucb desc, arm) as place from u")
def _(s, d):
    u = rounded(S.ucb1(S.pulls_summary(_pulls(s, d), None, "arm", "reward"), 0.5), "ucb")
    return S.chosen_arms(u, "arm", top=1000).select("arm", "n", "ucb", F.col("place").cast("bigint").alias("place"))


@query("ucb1_tuned", _UCB + ", u as (select arm, n, round(mean + 0.5 * 0.5 * sqrt((ln(greatest(total, 2)) / n) * least(0.25, case when n > 1 then v else 0.25 end + sqrt(2 * ln(greatest(total, 2)) / n))), 6) as ucb from t) select arm, n, ucb from u order by ucb desc, arm limit 4")
def _(s, d):
    u = rounded(S.ucb1_tuned(S.pulls_summary(_pulls(s, d), None, "arm", "reward"), 3, 0.5), "ucb")
    return S.chosen_arms(u, "arm", top=4, min_pulls=0).select("arm", "n", "ucb")


@query("ucb_forced", _PULLS + """, arms as (select distinct arm from pulls union all select 'never pulled'), g as (select a.arm, count(p.reward) as n, avg(p.reward) as mean from arms a left join pulls p using (arm) group by all),
t as (select *, sum(n) over () as total from g), u as (select arm, n, n < 4 as forced, row_number() over (order by n < 4 desc, case when n = 0 then 'Infinity'::double else mean + 0.5 * sqrt(ln(greatest(total, 2)) / n) end desc, arm) as place from t)
select arm, n, forced from u where forced or place <= 4""")
def _(s, d):
    p = _pulls(s, d)
    arms = p.select("arm").distinct().unionByName(s.createDataFrame([("never pulled",)], "arm string"))
    return S.chosen_arms(S.ucb1(S.pulls_summary(p, arms, "arm", "reward"), 0.5), "arm").select("arm", "n", "forced")


@query("warm_start", _PULLS + """, h as (select arm, avg(reward) as mean from pulls group by arm), w as (select arm, reward from pulls union all select arm, mean from h, range(2))
select arm, count(*) as n, round(avg(reward), 6) as mean from w group by arm""")
def _(s, d):
    p = _pulls(s, d)
    w = S.warm_started(p, p.groupBy("arm").agg(F.avg("reward").alias("mean")), "arm", "reward", 2)
    return w.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("mean"))


@query("operator_stats", "select event_type as operator, count(*) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std from events group by all")
def _(s, d):
    return rounded(S.operator_stats(table(s, d, "events").select(F.col("event_type").alias("operator"), "value"), "operator", "value"), "mean", "std")


@query("prune_operators", """with g as (select event_type as operator, count(*) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std from events group by all),
p as (select sum(mean * n) / sum(n) as pool, count(*) as judged from g where n >= 40), z as (select operator, n, case when n >= 40 and judged >= 2 then (mean - pool) / (case when std > 0 then std / sqrt(n) else 1e-6 end) end as z from g, p)
select operator, n, round(z, 6) as z, coalesce(z <= -1.0, false) as dropped from z""")
def _(s, d):
    st = S.operator_stats(table(s, d, "events").select(F.col("event_type").alias("operator"), "value"), "operator", "value")
    return rounded(S.pruned(st, "operator", z_limit=1.0), "z")


@query("usage_share", "with c as (select user_id % 10 as method, event_type as operator, count(*) as n from events group by all) select method, operator, n, round(100.0::double * n / sum(n) over (partition by method), 6) as share from c")
def _(s, d):
    c = table(s, d, "events").groupBy((F.col("user_id") % 10).alias("method"), F.col("event_type").alias("operator")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("method")), 6))


@query("gate_pass", "select event_type as operator, round(avg(cast(value >= 40 as integer)), 6) as pass_rate from events group by all")
def _(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("operator")).agg(F.round(F.avg((F.col("value") >= 40).cast("int")), 6).alias("pass_rate"))


@query("reward_credit", """with p as (select event_id as pull_id, event_type as operator from events), r as (select event_id as pull_id, value / 100 as score, case when value < 30 then 'rejected' else 'passed' end as gate from events where event_id % 5 <> 0)
select p.operator, count(*) as pulls, round(avg(coalesce(case when gate = 'rejected' then -0.1 else score - 0.6 end, 0)), 6) as mean_reward from p left join r using (pull_id) group by all""")
def _(s, d):
    e = table(s, d, "events")
    pulls = e.select(F.col("event_id").alias("pull_id"), F.col("event_type").alias("operator"))
    records = e.where("event_id % 5 <> 0").select(F.col("event_id").alias("pull_id"), (F.col("value") / 100).alias("score"), F.when(F.col("value") < 30, "rejected").otherwise("passed").alias("gate"))
    return S.rewards(pulls, records, F.lit(0.6), 0.1).groupBy("operator").agg(F.count("*").alias("pulls"), F.round(F.avg("reward"), 6).alias("mean_reward"))


@query("informative_failures", "with f as (select sample_id, count(*) filter (correct = 0) as failures from ev group by all) select sample_id, failures, row_number() over (order by failures desc, sample_id) as place from f", "ev")
def _(s, d):
    f = evaluations(s, d).groupBy("sample_id").agg(F.count_if(F.col("correct") == 0).alias("failures"))
    return numbered(f, [F.desc("failures"), F.col("sample_id")], "place")


@query("family_switch", """with o as (select event_type as operator, round(avg(value), 6) as score, count(*) as n from events group by all), k as (select * from o where n >= 5),
b as (select max(score) filter (operator in ('click', 'view')) as family_best, max(score) filter (operator = 'purchase') as baseline_score from k) select *, family_best <= baseline_score as disabled from b""")
def _(s, d):
    o = table(s, d, "events").groupBy(F.col("event_type").alias("operator")).agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("n"))
    return E.family_switch(o, ["click", "view"], "purchase", 5)


@query("failures_shown", """with f as (select record_id, sample_id, '- Input: ' || sample_id || chr(10) || '  Expected: yes' || chr(10) || '  Got: no ' || record_id as block from ev where correct = 0),
n as (select *, row_number() over (partition by record_id order by sample_id) as i from f) select record_id, string_agg(block, chr(10) order by sample_id) as failures from n where i <= 3 group by record_id""", "ev")
def _(s, d):
    failed = evaluations(s, d).where("correct = 0").select("record_id", "sample_id", F.col("sample_id").alias("input"), F.lit("yes").alias("target"), F.concat(F.lit("no "), "record_id").alias("reply"))
    return failures_shown(failed, ["record_id"], "sample_id", most=3)


@query("generation_snapshots", """with x as (select user_id as generation, event_id as record_id, event_type as operator, value as score from events)
select generation, max(score) as best_score, round(avg(score), 4) as mean_score, count(*) as population_size, arg_max(record_id, (score, -record_id)) as best_record_id from x group by all""")
def _(s, d):
    x = table(s, d, "events")
    return x.groupBy(F.col("user_id").alias("generation")).agg(F.max("value").alias("best_score"), F.round(F.avg("value"), 4).alias("mean_score"), F.count("*").alias("population_size"), F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_record_id"))


@query("operator_counts", """with c as (select user_id as generation, event_type, count(*) as n from events group by all)
select generation, string_agg(event_type || '=' || n, ',' order by event_type) as operator_counts from c group by generation""")
def _(s, d):
    c = table(s, d, "events").groupBy(F.col("user_id").alias("generation"), "event_type").agg(F.count("*").alias("n"))
    m = c.groupBy("generation").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))  # as many entries as operators
    pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("generation", F.array_join(pairs, ",").alias("operator_counts"))


@query("json_props_extract", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(None)).alias("k"))


@query("elite_mean", "with b as (select user_id, value, row_number() over (partition by user_id order by value desc, event_id) as rn from events) select user_id, round(avg(value), 6) as elite from b where rn <= 4 group by user_id")
def _(s, d):
    best = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(s, d, "events").withColumn("rn", F.row_number().over(best)).where("rn <= 4").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("elite"))


@query("batches", "select record_id, (n - 1) // 16 as batch, count(*) as n_rows from trials group by all", "trials")
def _(s, d):
    return trials(s, d).groupBy("record_id", F.floor((F.col("n") - 1) / 16).alias("batch")).agg(F.count("*").alias("n_rows"))


@query("worst_sample_per_record", "with m as (select user_id, event_type, round(avg(value), 9) as v from events group by all) select user_id, event_type, round(v, 6) as v from (select *, row_number() over (partition by user_id order by v, event_type) as rn from m) where rn = 1")
def _(s, d):
    m = table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 9).alias("v"))
    return rounded(first_of(m, ["user_id"], "v", ["event_type"], descending=False), "v")


@query("budget_admission", "select user_id, cast(count(*) as bigint) as calls, round(greatest(180.0::double, 0.08::double * 7200, avg(value) * 6), 6) as reserve, least(512, greatest(0, 20000 // count(*))) as tokens_each from events group by user_id")
def _(s, d):
    return table(s, d, "events").groupBy("user_id").agg(
        F.count("*").alias("calls"), F.round(F.greatest(F.lit(180.0), F.lit(0.08 * 7200), F.avg("value") * 6), 6).alias("reserve"), F.least(F.lit(512).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.floor(F.lit(20000) / F.count("*")))).alias("tokens_each")
    )


_REQUESTS = "select event_id, ts, event_id % 9 as seconds, 1 as calls, cast(floor(value) as bigint) as input_tokens, user_id % 40 as output_tokens from events"
_CAPS = {"seconds": 30000, "calls": 9000, "total_tokens": 500000, "input_tokens": 350000, "output_tokens": 110000}


def _refused(caps):
    told = {"seconds": "time"}
    return "case " + " ".join(f"when {c}_so_far - {c} >= {v} then '{told.get(c, c)}'" for c, v in caps.items()) + " end"


@query("budget_order", f"""with q as ({_REQUESTS}), t as (select *, input_tokens + output_tokens as total_tokens from q),
r as (select *, {", ".join(f"sum({c}) over (order by ts, event_id rows unbounded preceding) as {c}_so_far" for c in _CAPS)} from t)
select event_id, {_refused(_CAPS)} as refused from r""")
def _(s, d):
    from .budget import admitted

    e = table(s, d, "events")
    requests = e.select("event_id", "ts", (F.col("event_id") % 9).alias("seconds"), F.lit(1).alias("calls"), F.floor("value").alias("input_tokens"), (F.col("user_id") % 40).alias("output_tokens"))
    return admitted(requests, [F.col("ts"), F.col("event_id")], _CAPS).select("event_id", "refused")


@query("stagnation", """with g as (select record_id, n, correct from trials), v as (select record_id, n, cast(sum(correct) over (partition by record_id order by n) as double) / (n + 2) as v from g),
h as (select *, case when lag(v) over w is null or round(v - lag(v) over w, 9) >= 0.01 then 1 else 0 end as head from v window w as (partition by record_id order by n)),
k as (select *, sum(head) over (partition by record_id order by n) as stretch from h),
c as (select *, row_number() over (partition by record_id, stretch order by n) - 1 as streak from k),
e as (select record_id, min(n) filter (v >= 0.7) as p, min(n) filter (streak >= 3) as q from c group by record_id)
select record_id, least(p, q) as stop, case when p <= least(p, q) then 'perfect' when least(p, q) is not null then 'stagnation' end as reason from e""", "trials")
def _(s, d):
    so_far = F.sum("correct").over(W.partitionBy("record_id").orderBy("n")).cast("double")
    v = trials(s, d).withColumn("v", so_far / (F.col("n") + 2))
    return S.stagnation(v, ["record_id"], "n", "v", 0.01, 3, perfect=0.7)


@query("free_and_filled", _PULLS + """, g as (select arm, count(*) as n, avg(reward) as mean from pulls group by arm), t as (select *, sum(n) over () as total from g),
u as (select arm, n, round(mean + 0.5 * sqrt(ln(greatest(total, 2)) / n), 6) as ucb from t),
o as (select *, row_number() over (order by ucb desc, arm) as place, sum(cast(n % 3 <> 0 as integer)) over (order by ucb desc, arm rows unbounded preceding) as used from u)
select arm, cast(place as integer) as place, (n % 3 <> 0 and used <= 2) or arm like 'p%' as chosen from o""")
def _(s, d):
    u = rounded(S.ucb1(S.pulls_summary(_pulls(s, d), None, "arm", "reward"), 0.5), "ucb")
    return S.free_and_filled(u, "arm", 2, F.col("n") % 3 != 0, F.col("arm").startswith("p")).select("arm", "place", "chosen")
