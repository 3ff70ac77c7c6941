"""Queries over the runs table, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..operators.rank import average_rank, first_of, front, staircase
from ..sources.fixtures import runs, table, with_runs
from ..sources.storage import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over_runs: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_runs(sql) if over_runs else sql
        return f

    return keep


def runs_once(s, d):
    """The runs, made once for plans that read them in several branches."""
    return cut(runs(s, d))


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("runs_fact", "select model, method, task, seed, calls, tokens, test_score, best_dev from runs")
def _(s, d):
    return runs(s, d)


@query("method_report", """
with macro as (select model, method, seed, round(avg(test_score), 9) as macro, count(distinct task) as n from runs group by all
    having count(distinct task) = (select count(distinct task) from runs)),
scores as (select model, method, round(avg(macro), 9) as mean, round(coalesce(stddev_samp(macro), 0), 9) as std, count(*) as n_seeds from macro group by all),
cells as (select model, task, method, round(avg(test_score), 9) as value from runs group by all),
full_cells as (select * from (select *, count(*) over (partition by model, task) as c from cells) where c = (select count(distinct method) from runs)),
ranks as (select model, method, rank() over (partition by model, task order by value desc) + (count(*) over (partition by model, task, value) - 1) / 2.0 as r from full_cells),
avg_ranks as (select model, method, round(avg(r), 9) as avg_rank from ranks group by all),
cost as (select model, method, round(avg(tokens), 9) as tokens from runs group by all),
met as (select * from scores join avg_ranks using (model, method) join cost using (model, method))
select model, method, round(mean, 6) as mean, round(std, 6) as std, n_seeds, round(avg_rank, 6) as avg_rank, round(tokens, 6) as tokens,
    not exists (select 1 from met o where o.model = m.model and o.tokens < m.tokens and o.mean > m.mean) as on_front,
    cast(row_number() over (partition by model order by mean desc, method) as integer) as place
from met m""")
def _(s, d):
    return rounded(A.method_report(runs_once(s, d)), "mean", "std", "avg_rank", "tokens")


@query("macro_by_model_method", """
with m as (select model, method, seed, round(avg(test_score), 9) as macro from runs group by all having count(distinct task) = 5)
select model, method, round(avg(macro), 6) as mean, round(coalesce(stddev_samp(macro), 0), 6) as std, count(*) as n from m group by all""")
def _(s, d):
    return rounded(A.summary(A.macro_scores(runs(s, d), ["model", "method"], tasks=5), ["model", "method"], "macro"), "mean", "std")


@query("macro_over_runs", "select method, round(avg(test_score), 6) as macro from runs group by method")
def _(s, d):
    return runs(s, d).groupBy("method").agg(F.round(F.avg("test_score"), 6).alias("macro"))


@query("score_by_task", "select method, task, round(avg(test_score), 6) as mean, round(coalesce(stddev_samp(test_score), 0), 6) as std, count(*) as n from runs group by all")
def _(s, d):
    return rounded(A.summary(runs(s, d), ["method", "task"]), "mean", "std")


# some cells lack runs once short ones are left out
_SOME = "select * from runs where calls >= 40 or seed <= 2"


def _some(s, d):
    return runs_once(s, d).where("calls >= 40 or seed <= 2")


@query("coverage_complete_cells", f"with sm as ({_SOME}), c as (select model, task, count(distinct seed) as n_units from sm group by all) select * from c where n_units = (select max(n_units) from c)")
def _(s, d):
    return A.complete_cells(_some(s, d), ["model", "task"], "seed")


@query("incomplete_grid", f"""
with sm as ({_SOME}), c as (select model, method, count(seed) as n from sm where not (model = 'ASIA' and method = 'BUILDING') group by all),
g as (select * from (select distinct model from sm) cross join (select distinct method from sm))
select model, method, coalesce(n, -1) as n from g left join c using (model, method) where coalesce(n, -1) < (select max(n) from c)""")
def _(s, d):
    return A.incomplete_grid(_some(s, d).where("not (model = 'ASIA' and method = 'BUILDING')"), "model", "method", "seed")


@query("resume_missing_runs", """
with g as (select * from (select distinct model from runs), (select distinct method from runs), (select distinct task from runs), (select unnest(range(1, 8)) as seed))
select g.* from g anti join (select * from runs where calls >= 60) r using (model, method, task, seed)""")
def _(s, d):
    r = runs_once(s, d)
    done = r.where("calls >= 60").select("model", "method", "task", "seed")
    grid = r.select("model").distinct().crossJoin(r.select("method").distinct()).crossJoin(r.select("task").distinct()).crossJoin(s.range(1, 8).toDF("seed"))
    return grid.join(done, ["model", "method", "task", "seed"], "left_anti")


_RANKS = """with cells as (select model, task, method, round(avg(test_score), 9) as value from runs group by all),
ranks as (select *, cast(rank() over (partition by model, task order by value desc) + (count(*) over (partition by model, task, value) - 1) / 2.0 as double) as r from cells)"""


@query("average_ranks", _RANKS + " select model, task, method, round(r, 6) as rank from ranks")
def _(s, d):
    return A.block_ranks(runs(s, d), ["model", "task"], "method").select("model", "task", "method", "rank")


@query("avg_rank_by_method", _RANKS + " select method, round(avg(r), 6) as avg_rank, count(*) as n_blocks from ranks group by method")
def _(s, d):
    return rounded(A.mean_ranks(runs(s, d), ["model", "task"], "method"), "avg_rank")


_COST = "with m as (select model, method, round(avg(test_score), 9) as score, round(avg(tokens), 9) as cost from runs group by all)"


def _cost(s, d):
    return runs(s, d).groupBy("model", "method").agg(A.mean("test_score").alias("score"), A.mean("tokens").alias("cost"))


@query("cost_accuracy_front", _COST + " select model, method, round(score, 6) as score, round(cost, 6) as cost from m where not exists (select 1 from m o where o.cost < m.cost and o.score > m.score)")
def _(s, d):
    return rounded(front(_cost(s, d), "score", "cost", strict_both=True), "score", "cost")


@query("cost_front_weak", _COST + " select model, method, round(score, 6) as score, round(cost, 6) as cost from m where not exists (select 1 from m o where o.cost <= m.cost and o.score >= m.score and (o.cost < m.cost or o.score > m.score))")
def _(s, d):
    return rounded(front(_cost(s, d), "score", "cost"), "score", "cost")


@query("pareto_staircase", _COST + """, x as (select *, max(score) over (order by cost, model, method rows between unbounded preceding and 1 preceding) as b from m)
select model, method, round(score, 6) as score, round(cost, 6) as cost from x where b is null or score > b""")
def _(s, d):
    return rounded(staircase(_cost(s, d), "score", "cost", ["model", "method"]), "score", "cost")


@query("cost_rollup", """
with m as (select method, round(avg(test_score), 9) as score, round(avg(calls), 9) as calls, round(avg(tokens), 9) as tokens from runs group by all)
select method, round(score, 6) as score, round(calls, 6) as calls, round(tokens, 6) as tokens, round(score / (tokens / 100000), 6) as score_per_100k, round(tokens / min(tokens) over (), 6) as cost_index,
    round(calls * 2.5 / 3600 * 0.30, 6) as gpu_cost from m""")
def _(s, d):
    m = runs(s, d).groupBy("method").agg(A.mean("test_score").alias("score"), A.mean("calls").alias("calls"), A.mean("tokens").alias("tokens"))
    least = m.agg(F.min("tokens").alias("_t"))
    m = m.crossJoin(F.broadcast(least)).withColumn("score_per_100k", F.col("score") / (F.col("tokens") / 100000)).withColumn("cost_index", F.col("tokens") / F.col("_t"))
    return rounded(m.withColumn("gpu_cost", F.col("calls") * 2.5 / 3600 * 0.30).drop("_t"), "score", "calls", "tokens", "score_per_100k", "cost_index", "gpu_cost")


@query("stability", """
with t as (select method, task, round(coalesce(stddev_samp(test_score), 0), 9) as s from runs group by all)
select method, round(avg(s), 6) as avg_std, round(max(s), 6) as worst_std from t group by all""")
def _(s, d):
    t = A.summary(runs(s, d), ["method", "task"])
    return t.groupBy("method").agg(F.round(F.avg("std"), 6).alias("avg_std"), F.round(F.max("std"), 6).alias("worst_std"))


@query("gap_by_method", """
with g as (select method, task, round(avg(best_dev) - avg(test_score), 9) as gap from runs group by all)
select method, task, round(gap, 6) as gap from g union all select method, '** mean gap **', round(avg(gap), 6) from g group by method""")
def _(s, d):
    g = runs(s, d).groupBy("method", "task").agg(F.round(F.avg("best_dev") - F.avg("test_score"), 9).alias("gap"))
    total = g.groupBy("method").agg(F.avg("gap").alias("gap")).select("method", F.lit("** mean gap **").alias("task"), "gap")
    return rounded(g.unionByName(total), "gap")


@query("task_spread", """
with m as (select task, method, round(avg(test_score), 9) as v from runs group by all)
select task, round(max(v) - min(v), 6) as spread, arg_max(method, v) as best, arg_min(method, v) as worst from m group by task""")
def _(s, d):
    m = runs(s, d).groupBy("task", "method").agg(A.mean("test_score").alias("v"))
    return m.groupBy("task").agg(F.round(F.max("v") - F.min("v"), 6).alias("spread"), F.max_by("method", "v").alias("best"), F.min_by("method", "v").alias("worst"))


_H2H = """with p as (select model, task, seed, method, test_score from runs),
h as (select a.method as a, b.method as b, count(*) filter (a.test_score > b.test_score) as wins, count(*) filter (a.test_score = b.test_score) as ties, count(*) filter (a.test_score < b.test_score) as losses
from p a join p b using (model, task, seed) where a.method <> b.method group by all)"""


@query("head_to_head", _H2H + " select * from h")
def _(s, d):
    return A.pair_counts(runs(s, d), ["model", "task", "seed"], "method", "test_score")


@query("sign_test", _H2H + """, few as (select a, b, least(wins, 16) as w, least(losses, 16) as l from h),
terms as (select a, b, w, l, unnest(range(0, least(w, l) + 1)) as i from few)
select a, b, w as wins, l as losses, round(least(1.0, 2 * sum(cast(factorial(cast(w + l as integer)) as double) / (cast(factorial(cast(i as integer)) as double) * cast(factorial(cast(w + l - i as integer)) as double)) / pow(2.0, w + l))), 6) as p
from terms where w + l <= 33 group by all""")
def _(s, d):
    h = A.pair_counts(runs(s, d), ["model", "task", "seed"], "method", "test_score")
    few = h.select("a", "b", F.least("wins", F.lit(16).cast("bigint")).alias("wins"), F.least("losses", F.lit(16).cast("bigint")).alias("losses")).where("wins + losses <= 33")
    return few.withColumn("p", F.round(A.sign_test(F.col("wins"), F.col("losses")), 6))


@query("win_tie_loss", """with c as (select model, task, method, round(avg(test_score), 9) as v from runs group by all)
select a.method as a, b.method as b, count(*) filter (a.v > b.v) as wins, count(*) filter (a.v = b.v) as ties, count(*) filter (a.v < b.v) as losses
from c a join c b using (model, task) where a.method <> b.method group by all""")
def _(s, d):
    return A.pair_counts(A.block_means(runs(s, d), ["model", "task"], "method"), ["model", "task"], "method", "value")


@query("bradley_terry_wins", """with c as (select model, task, method, round(avg(test_score), 9) as v from runs group by all)
select a.method as a, b.method as b, cast(sum(case when a.v > b.v then 1 when a.v = b.v then 0.5 else 0 end) as double) as won
from c a join c b using (model, task) where a.method <> b.method group by all""")
def _(s, d):
    pairs = A.pair_counts(A.block_means(runs(s, d), ["model", "task"], "method"), ["model", "task"], "method", "value")
    return pairs.select("a", "b", (F.col("wins") + F.col("ties") * F.lit(0.5).cast("double")).cast("double").alias("won"))


@query("bradley_terry_strength")
def _(s, d):
    rows = QUERIES["bradley_terry_wins"](s, d).collect()  # a matrix of the methods
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    won = {(r["a"], r["b"]): r["won"] for r in rows}
    strengths = A.bradley_terry([[won.get((a, b), 0.0) for b in names] for a in names])
    return s.createDataFrame([(n, round(x, 6)) for n, x in zip(names, strengths)], "method string, strength double")


@query("bradley_terry_interval")
def _(s, d):
    cells = A.block_means(runs(s, d), ["model", "task"], "method")
    return rounded(A.bradley_terry_bootstrap(cells, ["model", "task"], "method", "value"), "low", "high")


def _differences(s, d):
    cells = A.block_means(runs(s, d), ["model", "task"], "method")
    a, b = cells.select("model", "task", F.col("method").alias("a"), F.col("value").alias("x")), cells.select("model", "task", F.col("method").alias("b"), F.col("value").alias("y"))
    return a.join(b, ["model", "task"]).where("a < b").select("a", "b", F.round(F.col("x") - F.col("y"), 9).alias("d"))


_SIGNED = """with c as (select model, task, method, round(avg(test_score), 9) as v from runs group by all),
d as (select a.method as a, b.method as b, round(a.v - b.v, 9) as d from c a join c b using (model, task) where a.method < b.method),
r as (select *, count(*) over (partition by a, b, abs(d)) as t, rank() over (partition by a, b order by abs(d)) as place from d where d <> 0),
s as (select a, b, count(*) as n, round(sum(case when d > 0 then place + (t - 1) / 2.0 else 0 end)::double, 6) as up, round(sum(case when d < 0 then place + (t - 1) / 2.0 else 0 end)::double, 6) as down, cast(sum(t * t - 1) as bigint) as tied from r group by all)"""


@query("signed_ranks", _SIGNED + " select * from s")
def _(s, d):
    return rounded(A.signed_ranks(_differences(s, d), ["a", "b"], "d").where("n > 0"), "up", "down")


@query("wilcoxon_holm")
def _(s, d):
    ranks = A.signed_ranks(_differences(s, d), ["a", "b"], "d")
    tested = ranks.select("a", "b", A.wilcoxon_p(F.col("n"), F.col("up"), F.col("down"), F.col("tied")).alias("p"))
    return rounded(A.holm(tested, "p", ["a", "b"]), "p", "p_holm")


@query("lcb_winner", """
with g as (select task, method, round(avg(test_score), 9) as mean, round(coalesce(stddev_samp(test_score), 0), 9) as std, count(*) as n from runs group by all),
l as (select *, round(mean - std / sqrt(n), 9) as lcb, max(mean) over (partition by task) as top from g),
w as (select task, method as winner, mean as w_mean, std as w_std, n as w_n from (select *, row_number() over (partition by task order by lcb desc, method) as rn from l) where rn = 1)
select task, winner, round(max(w_mean), 6) as mean,
    count(*) filter (method <> winner and abs(mean - w_mean) < 1e-9 and abs(std - w_std) < 1e-9) as co_winners,
    count(*) filter (method <> winner and not (abs(mean - w_mean) < 1e-9 and abs(std - w_std) < 1e-9) and top - mean <= sqrt(w_std * w_std / w_n + std * std / n)) as ties
from l join w using (task) group by task, winner""")
def _(s, d):
    return rounded(A.lcb_winner(runs(s, d), ["task"], "method"), "mean")


@query("composite_rank", """
with st as (select method, round(avg(x), 9) as stability from (select method, task, coalesce(stddev_samp(test_score), 0) as x from runs group by all) group by all),
dims as (select method, round(avg(test_score), 9) as accuracy, round(avg(best_dev) - avg(test_score), 9) as generalization, round(avg(tokens), 9) as token_cost, round(avg(calls), 9) as speed from runs group by all),
x as (select * from dims join st using (method)),
r as (select method,
    cast(rank() over (order by accuracy desc) + (count(*) over (partition by accuracy) - 1) / 2.0 as double) as rank_accuracy,
    cast(rank() over (order by stability) + (count(*) over (partition by stability) - 1) / 2.0 as double) as rank_stability,
    cast(rank() over (order by generalization) + (count(*) over (partition by generalization) - 1) / 2.0 as double) as rank_generalization,
    cast(rank() over (order by token_cost) + (count(*) over (partition by token_cost) - 1) / 2.0 as double) as rank_token_cost,
    cast(rank() over (order by speed) + (count(*) over (partition by speed) - 1) / 2.0 as double) as rank_speed from x)
select *, round(rank_accuracy * 0.40::double + rank_stability * 0.20::double + rank_generalization * 0.15::double + rank_token_cost * 0.15::double + rank_speed * 0.10::double, 6) as composite from r""")
def _(s, d):
    return rounded(A.composite_rank(runs_once(s, d)), "composite")


@query("anova_shares", """
with macro as (select model, method, seed, avg(test_score) as macro from runs group by all),
cells as (select model, method, avg(macro) as m, count(*) as n, var_pop(macro) as v from macro group by all),
r as (select model, avg(m) as rm from cells group by all), c as (select method, avg(m) as cm from cells group by all), g as (select avg(m) as g from cells),
x as (select sum((rm - g) * (rm - g)) as a, sum((cm - g) * (cm - g)) as b, sum(n * (m - rm - cm + g) * (m - rm - cm + g)) as i, sum(n * v) as w from cells join r using (model) join c using (method), g)
select round(100 * a / (a + b + i + w), 4) as row_share, round(100 * b / (a + b + i + w), 4) as column_share, round(100 * i / (a + b + i + w), 4) as interaction_share, round(100 * w / (a + b + i + w), 4) as within_share from x""")
def _(s, d):
    macro = runs_once(s, d).groupBy("model", "method", "seed").agg(F.avg("test_score").alias("macro"))
    return rounded(A.anova_shares(macro), "row_share", "column_share", "interaction_share", "within_share", places=4)


_MODEL_RANKS = """with cells as (select model, method, round(avg(test_score), 9) as value from runs group by all),
ranks as (select *, cast(rank() over (partition by model order by value desc) + (count(*) over (partition by model, value) - 1) / 2.0 as double) as rank from cells)"""


@query("kendall_w", _MODEL_RANKS + """, s as (select method, sum(rank) as r, count(*) as m from ranks group by all)
select max(m) as m, count(*) as n, round(12 * (sum(r * r) - sum(r) * sum(r) / count(*)) / (max(m) * max(m) * (count(*) * count(*) * count(*) - count(*))), 6) as w from s""")
def _(s, d):
    return rounded(A.kendall_w(A.block_ranks(runs(s, d), ["model"], "method"), ["model"], "method"), "w")


@query("spearman_rank", _MODEL_RANKS + " select a.model as a, b.model as b, round(corr(a.rank, b.rank), 6) as rho from ranks a join ranks b using (method) where a.model < b.model group by all")
def _(s, d):
    return A.rank_correlation(A.block_ranks(runs(s, d), ["model"], "method"), "model", "method")


@query("friedman_stat", _RANKS + """, s as (select method, sum(r) as rs, count(*) as n from ranks group by all), z as (select sum(rs * rs) as ss, max(n)::double as n, count(*)::double as k from s),
t as (select sum(t * t * t - t)::double as ties from (select count(*) as t from ranks group by model, task, r))
select k, n, round((12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))), 6) as statistic from z, t""")
def _(s, d):
    f = A.friedman(runs_once(s, d), ["model", "task"], "method")
    return rounded(f.select(F.col("k").cast("double"), F.col("n").cast("double"), "statistic"), "statistic")


@query("nemenyi_cd", "select count(distinct method) as k, count(distinct (model, task)) as n, round(2.728 * sqrt(5 * 6 / (6.0 * count(distinct (model, task)))), 6) as cd from runs")
def _(s, d):
    return rounded(A.nemenyi(runs_once(s, d), ["model", "task"], "method"), "cd")


@query("cd_groups", _RANKS + """, a as (select method, round(avg(r), 9) as ar from ranks group by all), i as (select *, row_number() over (order by ar, method) as i from a),
cd as (select 2.728 * sqrt(5 * 6 / (6.0 * count(distinct (model, task)))) as cd from runs),
reach as (select x.i, max(y.i) as last_i, any_value(x.method) as first_item, arg_max(y.method, y.i) as last_item from i x join i y on y.i >= x.i, cd where y.ar - x.ar <= cd group by x.i),
k as (select *, max(last_i) over (order by i rows between unbounded preceding and 1 preceding) as b from reach)
select first_item, last_item, last_i - i + 1 as size from k where last_i > i and (b is null or last_i > b)""")
def _(s, d):
    return A.cd_groups(runs_once(s, d), ["model", "task"], "method")


@query("holm_adjust", """with p as (select model, method, round(least(1.0, 0.001 * (1 + (sum(calls) % 97))), 9) as p from runs group by all),
x as (select *, least(1.0::double, (count(*) over (partition by model) - (row_number() over (partition by model order by p, method) - 1)) * p::double) as raw from p)
select model, method, p::double as p, round(max(raw) over (partition by model order by p, method rows between unbounded preceding and current row), 6) as p_holm from x""")
def _(s, d):
    p = runs(s, d).groupBy("model", "method").agg((F.lit(0.001).cast("double") * (1 + F.sum("calls") % 97)).alias("p")).withColumn("p", F.round(F.least(F.lit(1.0), "p"), 9))
    return rounded(A.holm(p, "p", ["method"], ["model"]), "p_holm")


@query("cliffs_delta", """with d as (select a.method as a, b.method as b, (count(*) filter (a.test_score > b.test_score) - count(*) filter (a.test_score < b.test_score)) / count(*)::double as delta
from runs a, runs b where a.method <> b.method group by all)
select a, b, round(delta, 9) as delta, case when abs(round(delta, 12)) < 0.147 then 'negligible' when abs(delta) < 0.33 then 'small' when abs(delta) < 0.474 then 'medium' else 'large' end as magnitude from d""")
def _(s, d):
    return A.cliffs_delta(runs_once(s, d), "method", "test_score")


@query("expected_max", """with v as (select method, test_score as x, row_number() over (partition by method order by test_score) as i, count(*) over (partition by method) as n from runs), k as (select unnest([1, 2, 5, 10]) as n_draws)
select method, n_draws, round(sum(x * (pow(i / n, n_draws) - pow((i - 1) / n, n_draws))), 6) as expected_max from v, k group by all""")
def _(s, d):
    return A.expected_max(runs(s, d), ["method"], "test_score", [1, 2, 5, 10])


@query("seed_aggregate", "select model, method, task, round(avg(best_dev), 6) as dev, round(avg(test_score), 6) as test, round(coalesce(stddev_samp(test_score), 0), 6) as std from runs where calls > 2 group by all")
def _(s, d):
    return runs(s, d).where("calls > 2").groupBy("model", "method", "task").agg(F.round(F.avg("best_dev"), 6).alias("dev"), F.round(F.avg("test_score"), 6).alias("test"), F.round(F.coalesce(F.stddev_samp("test_score"), F.lit(0.0)), 6).alias("std"))


@query("usage_merge", "select model, cast(sum(calls) as bigint) as calls, sum(tokens) as tokens, case when sum(calls) > 0 then round(sum(tokens) / sum(calls), 6) else 0 end as avg_tokens from runs group by model")
def _(s, d):
    r = runs(s, d).groupBy("model").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    return r.withColumn("avg_tokens", F.round(F.coalesce(F.try_divide("tokens", "calls"), F.lit(0.0)), 6))


@query("mde_by_group", "select model, method, count(*) as n, round(case when count(*) <= 0 then 1.0 else 2.8015852181 * sqrt(greatest(round(avg(test_score), 9) * (1 - round(avg(test_score), 9)), 1.0::double / count(*)) / count(*)) end, 6) as mde from runs group by all")
def _(s, d):
    g = runs(s, d).groupBy("model", "method").agg(F.count("*").alias("n"), A.mean("test_score").alias("_p"))
    return g.select("model", "method", "n", F.round(A.minimum_detectable(F.col("_p"), F.col("n")), 6).alias("mde"))


@query("trap_test", """with g as (select task, method, round(avg(test_score), 9) as p, count(*) as n from runs group by all), b(task_key, base) as (values ('URGENT', 0.52::double), ('HIGH', 0.50::double), ('LOW', 0.51::double)),
x as (select task, method, n, (p - base) / sqrt(greatest(base * (1 - base), 1e-9) / n) as z from g join b on contains(task, task_key))
select task, method, n, round(z, 6) as z, n >= 16 and z <= -0.05 as trapped from x""")
def _(s, d):
    g = runs(s, d).groupBy("task", "method").agg(A.mean("test_score").alias("p"), F.count("*").alias("n"))
    bases = F.broadcast(s.createDataFrame([("URGENT", 0.52), ("HIGH", 0.50), ("LOW", 0.51)], "task_key string, base double"))
    met = g.join(bases, F.contains(F.col("task"), F.col("task_key")))
    z, _ = A.trap_test(F.col("p"), F.col("base"), F.col("n"))
    return met.select("task", "method", "n", F.round(z, 6).alias("z"), ((F.col("n") >= 16) & (z <= -0.05)).alias("trapped"))


@query("barrier_score", """select model, method, task, seed, round(greatest(0.0::double, test_score - 0.5::double * pow(greatest(0.0::double, (calls - 20) / 180.0::double), 3)), 6) as barrier,
    round(test_score - calls * 0.0002::double, 6) as tie_breaker from runs""")
def _(s, d):
    return runs(s, d).select("model", "method", "task", "seed", F.round(A.barrier_score(F.col("test_score"), F.col("calls"), 20, 200, 0.5), 6).alias("barrier"), F.round(F.col("test_score") - F.col("calls") * 0.0002, 6).alias("tie_breaker"))


@query("length_penalty", """with x as (select model, seed, task, method, calls, test_score, max(calls) over (partition by model order by seed, task, method rows unbounded preceding) as longest from runs)
select model, seed, task, method, round(greatest(0.0::double, test_score - 0.05::double * calls / longest), 6) as penalised from x""")
def _(s, d):
    longest = F.max("calls").over(W.partitionBy("model").orderBy("seed", "task", "method").rowsBetween(W.unboundedPreceding, 0))
    return runs(s, d).withColumn("_l", longest).select("model", "seed", "task", "method", F.round(F.greatest(F.lit(0.0), F.col("test_score") - F.lit(0.05) * F.col("calls") / F.col("_l")), 6).alias("penalised"))


@query("normalised_profiles", """with m as (select method, round(avg(test_score), 9) as a, round(avg(tokens), 9) as t from runs group by all)
select method, round((a - min(a) over ()) / (max(a) over () - min(a) over () + 1e-12), 6) as accuracy, round(1 - (t - min(t) over ()) / (max(t) over () - min(t) over () + 1e-12), 6) as cost from m""")
def _(s, d):
    m = runs(s, d).groupBy("method").agg(A.mean("test_score").alias("a"), A.mean("tokens").alias("t"))
    ends = m.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    m = m.crossJoin(F.broadcast(ends))
    return m.select("method", F.round((F.col("a") - F.col("a0")) / (F.col("a1") - F.col("a0") + 1e-12), 6).alias("accuracy"), F.round(1 - (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0") + 1e-12), 6).alias("cost"))


@query("argmax_per_group", """with m as (select model, method, round(avg(test_score), 9) as mean from runs group by all)
select model, method, round(mean, 6) as mean from (select *, row_number() over (partition by model order by mean desc, method) as rn from m) where rn = 1""")
def _(s, d):
    m = runs(s, d).groupBy("model", "method").agg(A.mean("test_score").alias("mean"))
    return rounded(first_of(m, ["model"], "mean", ["method"]), "mean")


@query("relabel_reorder", """with l(method, label, sort_order) as (values ('MACHINERY', 'Machines', 1), ('BUILDING', 'Buildings', 2), ('UNKNOWN', 'None such', 3))
select label, sort_order, count(r.method) as n_runs from l left join runs r on r.method = l.method group by all""")
def _(s, d):
    labels = s.createDataFrame([("MACHINERY", "Machines", 1), ("BUILDING", "Buildings", 2), ("UNKNOWN", "None such", 3)], "method string, label string, sort_order int")
    counts = runs(s, d).groupBy("method").agg(F.count("*").alias("_n"))
    return labels.join(counts, "method", "left").select("label", "sort_order", F.coalesce("_n", F.lit(0)).alias("n_runs"))


@query("subset_filters", "select model, method, task, seed from runs where model in ('ASIA', 'EUROPE') and starts_with(task, '1') and best_dev is not null and test_score is not null")
def _(s, d):
    return runs(s, d).where(F.col("model").isin("ASIA", "EUROPE") & F.startswith("task", F.lit("1"))).dropna(subset=["best_dev", "test_score"]).select("model", "method", "task", "seed")


@query("macro_by_family", """with m as (select model, method, round(avg(test_score), 9) as macro from runs group by all), f as (select distinct model, substr(model, 1, 1) as family from runs)
select family, method, round(avg(macro), 6) as macro, count(*) as n from m join f using (model) group by all""")
def _(s, d):
    r = runs_once(s, d)
    m = r.groupBy("model", "method").agg(A.mean("test_score").alias("macro"))
    families = r.select("model", F.substring("model", 1, 1).alias("family")).dropDuplicates()
    return m.join(families, "model").groupBy("family", "method").agg(F.round(F.avg("macro"), 6).alias("macro"), F.count("*").alias("n"))


@query("cached_aggregates", """select model, method, round(avg(test_score), 6) as mean_score, round(coalesce(stddev_samp(test_score), 0), 6) as std_score, round(min(test_score), 6) as min_score, round(max(test_score), 6) as max_score,
    count(distinct seed) as n_seeds, count(distinct task) as n_tasks, round(avg(tokens), 6) as mean_tokens from runs group by all""")
def _(s, d):
    return runs(s, d).groupBy("model", "method").agg(
        F.round(F.avg("test_score"), 6).alias("mean_score"), F.round(F.coalesce(F.stddev_samp("test_score"), F.lit(0.0)), 6).alias("std_score"), F.round(F.min("test_score"), 6).alias("min_score"), F.round(F.max("test_score"), 6).alias("max_score"),
        F.count_distinct("seed").alias("n_seeds"), F.count_distinct("task").alias("n_tasks"), F.round(F.avg("tokens"), 6).alias("mean_tokens"),
    )


def _weight(start: str, draw: str) -> str:
    mixed = f"(({start} + 1) * 48271 + {draw} * 69621) % 2147483647"
    for _ in range(2):
        mixed = f"(({mixed}) * ({mixed}) + 12345) % 2147483647"
    return " + ".join(f"cast(({mixed}) / 2147483647.0::double >= {p!r}::double as bigint)" for p in A.POISSON)


@query("bootstrap_interval", f"""with k as (select method, test_score as v, ('0x' || substr(md5(model || '|' || task || '|' || seed), 1, 7))::bigint as h from runs),
w as (select method, v, b, {_weight("h", "b")} as w from k, range(1, 501) t(b)),
m as (select method, b, sum(w * v) / sum(w) as m from w where w > 0 group by all)
select method, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m group by method""")
def _(s, d):
    return rounded(A.bootstrap_interval(runs(s, d), ["method"], "test_score", F.concat_ws("|", "model", "task", F.col("seed").cast("string")), 500), "low", "high")


@query("broken_results", "select model, method, task, seed from runs where calls > 20 and test_score < 0.5 and best_dev >= 0.95")
def _(s, d):
    return runs(s, d).where("calls > 20 and test_score < 0.5 and best_dev >= 0.95").select("model", "method", "task", "seed")


@query("model_slug", "select distinct lower(replace(list_extract(string_split('org/' || n_name || ':4b', '/'), -1), ':', '-')) as slug from nation", over_runs=False)
def _(s, d):
    from ..functions.text import model_slug

    return table(s, d, "nation").select(model_slug(F.concat(F.lit("org/"), "n_name", F.lit(":4b"))).alias("slug")).distinct()


@query("cost_rank_by_model", "with m as (select model, method, round(avg(tokens), 9) as t from runs group by all) select model, method, round(cast(rank() over (partition by model order by t) + (count(*) over (partition by model, t) - 1) / 2.0 as double), 6) as rank from m")
def _(s, d):
    m = runs(s, d).groupBy("model", "method").agg(A.mean("tokens").alias("t"))
    return m.select("model", "method", average_rank(F.col("t"), ["model"], descending=False).alias("rank"))
