"""Queries over prompt records, texts and conversations, each beside its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluate as E
from ..operators import lineage as L
from ..operators import select as S
from ..operators.rank import rank_order, top_k
from ..sources.fixtures import PROMPTS_SQL, named, prompts, table
from ..sources.storage import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, over: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = named("prompts", PROMPTS_SQL, sql) if over else sql
        return f

    return keep


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_ORDER = "dev is not null desc, score desc, record_id"


@query("lineage_edges", "select record_id as child_id, unnest(parent_ids) as parent_id, cast(unnest(range(len(parent_ids))) as integer) as position from prompts")
def _(s, d):
    return L.edges(prompts(s, d)).select("child_id", "parent_id", "position")


@query("lineage_closure", """with recursive e as (select distinct record_id as child_id, unnest(parent_ids) as parent_id from prompts),
up(start_id, ancestor_id, depth) as (select record_id, record_id, 0 from prompts union select start_id, parent_id, depth + 1 from up join e on ancestor_id = child_id where parent_id <> child_id)
select start_id, ancestor_id, cast(min(depth) as integer) as depth from up group by all""")
def _(s, d):
    p = prompts(s, d).select("record_id", "parent_ids")
    return L.ancestors(p, p)


ORACLES["lineage_closure"] = ORACLES["lineage_closure"].replace("with prompts as", "with recursive prompts as").replace("), recursive e as", "), e as").replace(" recursive e as", " e as")


@query("first_parent_chain", """with recursive chain(start_id, record_id, hop) as (select record_id, record_id, 0 from prompts union all
select start_id, p.parent_ids[1], hop + 1 from chain c join prompts p on p.record_id = c.record_id where len(p.parent_ids) > 0 and hop < 13)
select start_id, max(hop) as hops, arg_max(record_id, hop) as root_id from chain group by start_id""")
def _(s, d):
    return L.first_parent_roots(prompts(s, d).select("record_id", "parent_ids"), 13)


ORACLES["first_parent_chain"] = ORACLES["first_parent_chain"].replace("with prompts as", "with recursive prompts as").replace(" recursive chain(", " chain(")


@query("child_vs_parent", "select c.record_id, c.operator, round(c.dev, 6) as dev, round(p.dev, 6) as parent_dev, round(c.dev - p.dev, 6) as delta from prompts c left join prompts p on p.record_id = c.parent_ids[1]")
def _(s, d):
    c = L.child_with_parent(prompts(s, d).select("record_id", "operator", "dev", "parent_ids"), "dev")
    return rounded(c.select("record_id", "operator", "dev", "parent_dev", (F.col("dev") - F.col("parent_dev")).alias("delta")), "dev", "parent_dev", "delta")


@query("improvement_by_operator", "select c.operator, count(*) as n, round(avg(c.dev - p.dev), 6) as mean_delta, round(avg(cast(c.dev > p.dev as integer)), 6) as p_improve from prompts c join prompts p on p.record_id = c.parent_ids[1] where c.dev is not null and p.dev is not null group by all having count(*) >= 10")
def _(s, d):
    c = L.child_with_parent(prompts(s, d).select("record_id", "operator", "dev", "parent_ids"), "dev").dropna(subset=["dev", "parent_dev"])
    return c.groupBy("operator").agg(F.count("*").alias("n"), F.round(F.avg(F.col("dev") - F.col("parent_dev")), 6).alias("mean_delta"), F.round(F.avg((F.col("dev") > F.col("parent_dev")).cast("int")), 6).alias("p_improve")).where("n >= 10")


@query("child_all_parents", "select c.record_id, count(*) as n_parents, round(max(p.score), 6) as parent_best from (select record_id, unnest(parent_ids) as pid from prompts) c join prompts p on p.record_id = c.pid group by all")
def _(s, d):
    p = prompts(s, d)
    e = L.edges(p.select("record_id", "parent_ids"))
    return e.join(p.select("record_id", "score"), F.col("parent_id") == F.col("record_id")).groupBy(F.col("child_id").alias("record_id")).agg(F.count("*").alias("n_parents"), F.round(F.max("score"), 6).alias("parent_best"))


@query("dev_scored_only", "select record_id, round(dev, 6) as dev from prompts where dev is not null and text <> ''")
def _(s, d):
    return rounded(prompts(s, d).where("dev is not null and text <> ''").select("record_id", "dev"), "dev")


@query("topk_rank_key", f"select record_id, round(score, 6) as score from prompts order by {_ORDER} limit 25")
def _(s, d):
    return rounded(top_k(prompts(s, d).select("record_id", "dev", "score"), 25, rank_order()).select("record_id", "score"), "score")


@query("best_record", f"select record_id, text_hash, round(score, 6) as score from (select record_id, sha256(text) as text_hash, dev, score from prompts) order by {_ORDER} limit 1")
def _(s, d):
    return rounded(top_k(prompts(s, d).select("record_id", "dev", "score", "text"), 1, rank_order()).select("record_id", X.text_hash(F.col("text")).alias("text_hash"), "score"), "score")


@query("best_of_generation", f"select generation, record_id, round(score, 6) as score from (select *, row_number() over (partition by generation order by {_ORDER}) as rn from prompts) where rn = 1")
def _(s, d):
    p = prompts(s, d).select("generation", "record_id", "dev", "score")
    return rounded(top_k(p, 1, rank_order(), ["generation"]).select("generation", "record_id", "score"), "score")


@query("dedup_exact_hash", f"select record_id from (select record_id, row_number() over (partition by {_STRIP.format('text')} order by record_id) as rn from prompts) where rn = 1")
def _(s, d):
    return L.without_duplicates(prompts(s, d).select("record_id", "text")).select("record_id")


@query("dup_vs_history", f"select c.record_id from prompts c where c.generation >= 8 and not exists (select 1 from prompts h where h.generation < 8 and {_STRIP.format('h.text')} = {_STRIP.format('c.text')})")
def _(s, d):
    p = prompts(s, d).select("record_id", "text", "generation")
    return L.unseen(p.where("generation >= 8"), p.where("generation < 8")).select("record_id")


@query("modes_to_mint", "select p.hash as text_hash, m.mode from (select distinct sha256(text) as hash from prompts) p, (select unnest(['ao', 'cot', 'thinking']) as mode) m anti join (select distinct sha256(text) as hash, case when generation % 2 = 0 then 'ao' else 'cot' end as mode from prompts) x on x.hash = p.hash and x.mode = m.mode")
def _(s, d):
    p = prompts(s, d).select(X.text_hash(F.col("text")).alias("text_hash"), F.when(F.col("generation") % 2 == 0, "ao").otherwise("cot").alias("mode"))
    modes = s.createDataFrame([("ao",), ("cot",), ("thinking",)], "mode string")
    return p.select("text_hash").distinct().crossJoin(F.broadcast(modes)).join(p.distinct(), ["text_hash", "mode"], "left_anti")


@query("export_keep_text", """with r as (select record_id, score, operator, row_number() over (order by score desc, record_id) as rn, row_number() over (partition by operator order by score desc, record_id) as ro from prompts)
select record_id, rn <= 20 or ro = 1 as keep_text, rn = 1 as keep_details from r""")
def _(s, d):
    return S.export_flags(prompts(s, d).select("record_id", "score", "operator"), 20).select("record_id", "keep_text", "keep_details")


@query("final_top10", "select record_id, left(text, 200) as prompt, round(score, 6) as score from prompts order by score desc, record_id limit 10")
def _(s, d):
    return rounded(prompts(s, d).orderBy(F.desc("score"), "record_id").limit(10).select("record_id", F.substring("text", 1, 200).alias("prompt"), "score"), "score")


def _hash_order(seed: str) -> str:
    return f"sha256(record_id || '|{seed}')"


@query("split_fixed_seed", f"""with g as (select method, count(*) as n from prompts group by all), z as (select method, n, case when n >= 173 then 8 else 3 end as n_train, least(115, greatest(1, n - case when n >= 173 then 58 else 36 end)) as n_test from g),
t as (select p.record_id, method, n_train, n_test, row_number() over (partition by method order by {_hash_order('42')}, record_id) as t from prompts p join z using (method)),
r as (select *, row_number() over (partition by method, t <= n_test order by {_hash_order('0')}, record_id) as r from t)
select record_id, method, case when t <= n_test then 'test' when r <= n_train then 'train' else 'dev' end as split from r""")
def _(s, d):
    p = prompts(s, d).select("record_id", "method")
    n = F.col("n")
    sizes = p.groupBy("method").agg(F.count("*").alias("n")).select("method", F.when(n >= 173, 8).otherwise(3).alias("n_train"), F.least(F.lit(115), F.greatest(F.lit(1), n - F.when(n >= 173, 58).otherwise(36))).alias("n_test"))
    return S.fixed_split(p, "record_id", sizes, ["method"])


@query("ratio_split", f"""with g as (select method, count(*) as n, case when count(*) >= 28 then 8 else 3 end as n_train from prompts group by all), z as (select method, n_train, n - n_train - greatest(1, cast(round_even((n - n_train) * 0.5, 0) as bigint)) as n_test from g),
t as (select p.record_id, method, n_train, n_test, row_number() over (partition by method order by {_hash_order('42')}, record_id) as t from prompts p join z using (method)),
r as (select *, row_number() over (partition by method, t <= n_test order by {_hash_order('0')}, record_id) as r from t)
select record_id, method, case when t <= n_test then 'test' when r <= n_train then 'train' else 'dev' end as split from r""")
def _(s, d):
    p = prompts(s, d).select("record_id", "method")
    counts = p.groupBy("method").agg(F.count("*").alias("n")).withColumn("n_train", F.when(F.col("n") >= 28, 8).otherwise(3))
    sizes = counts.select("method", "n_train", (F.col("n") - F.col("n_train") - F.greatest(F.lit(1), F.bround((F.col("n") - F.col("n_train")) * 0.5).cast("bigint"))).alias("n_test"))
    return S.fixed_split(p, "record_id", sizes, ["method"])


@query("holdout_carve", f"""with g as (select method, count(*) as n from prompts group by all)
select record_id, method, row_number() over (partition by method order by {_hash_order('42')}, record_id) > greatest(1, n - greatest(12, cast(round_even(0.3::double * n, 0) as bigint))) as holdout from prompts join g using (method)""")
def _(s, d):
    p = prompts(s, d).select("record_id", "method")
    n = F.count("*").over(W.partitionBy("method"))
    place = F.row_number().over(W.partitionBy("method").orderBy(S.shuffled(p, "record_id", 42), "record_id"))
    kept = F.greatest(F.lit(1), n - F.greatest(F.lit(12), F.bround(0.3 * n).cast("bigint")))
    return p.withColumn("_k", kept).withColumn("_p", place).select("record_id", "method", (F.col("_p") > F.col("_k")).alias("holdout"))


@query("few_shot_pick", f"select method, record_id from (select method, record_id, row_number() over (partition by method order by {_hash_order('7')}, record_id) as rn from prompts) where rn <= 3")
def _(s, d):
    p = prompts(s, d).select("method", "record_id")
    return top_k(p, 3, [S.shuffled(p, "record_id", 7), F.col("record_id")], ["method"])


@query("unseen_exemplars", f"select method, record_id from (select method, record_id, row_number() over (partition by method order by {_hash_order('7')}, record_id) as rn from prompts) where rn > 3 and record_id % 2 = 0")
def _(s, d):
    p = prompts(s, d).select("method", "record_id")
    seen = top_k(p, 3, [S.shuffled(p, "record_id", 7), F.col("record_id")], ["method"])
    return p.where("record_id % 2 = 0").join(seen, ["method", "record_id"], "left_anti")


@query("dev_order_by_length", "select method, record_id, row_number() over (partition by method order by length(text) desc, record_id) as place from prompts")
def _(s, d):
    p = prompts(s, d).select("method", "record_id", F.length("text").alias("size"))
    return p.select("method", "record_id", F.row_number().over(W.partitionBy("method").orderBy(F.desc("size"), "record_id")).cast("bigint").alias("place"))


@query("offspring_allocation", "with w(name, weight, seq) as (values ('mutate', 0.5::double, 1), ('cross', 0.25::double, 2), ('fresh', 0.25::double, 3)), x as (select name, weight, seq, cast(floor(17 * weight) as bigint) as n from w) select name, n + case when row_number() over (order by weight desc, seq) = 1 then cast(17 - sum(n) over () as bigint) else 0 end as n from x", over=False)
def _(s, d):
    return S.allocation(s.createDataFrame([("mutate", 0.5, 1), ("cross", 0.25, 2), ("fresh", 0.25, 3)], "name string, weight double, seq int"), 17)


@query("words_chars", r"select record_id, cast(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as bigint) as words, length(text) as chars, sha256(text) as text_hash from prompts")
def _(s, d):
    t = F.col("text")
    return spread(prompts(s, d)).select("record_id", X.word_count(t).alias("words"), F.length(t).cast("bigint").alias("chars"), X.text_hash(t).alias("text_hash"))


@query("sentence_count", r"select record_id, cast(len(list_filter(string_split(regexp_replace(" + _STRIP.format("text") + r", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + _STRIP.format("x") + r" <> '')) as integer) as sentences from prompts")
def _(s, d):
    return spread(prompts(s, d)).select("record_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


@query("span_count", r"select record_id, cast(len(list_filter(string_split_regex(regexp_replace(text, '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: " + _STRIP.format("x") + r" <> '')) as integer) as spans from prompts")
def _(s, d):
    return spread(prompts(s, d)).select("record_id", F.size(X.spans(F.col("text"))).alias("spans"))


@query("validity_classes", r"""with b as (select record_id, operator, """ + _STRIP.format("case record_id % 7 when 0 then 'Sure, here it is: ' || text when 1 then 'I cannot do that. ' || text when 2 then 'New instruction: ' || text when 3 then '' when 4 then text || ' and then' else text || '.' end") + r""" as t from prompts)
select record_id, operator, case when t = '' then 'empty' when regexp_matches(t, '(?i)^\s*(i (cannot|can''t|am unable|do not|don''t)|as an ai|the (instruction|prompt) (is|seems) (already|correct|fine))') then 'refusal'
when regexp_matches(t, '(?i)(step\s*1\s*:|step\s*2\s*:|diagnosis\s*:|root cause\s*:|improved instruction\s*:|new instruction\s*:|analysis\s*:|here is the improved|revised instruction\s*:)') then 'meta_leak'
when regexp_matches(t, '(?i)^\s*(sure|certainly|of course|here(''s| is)|i''d be happy|absolutely|okay|ok,|got it|great|understood|below is|the improved|improved version)\b') then 'preamble'
when not regexp_matches(t, '[.!?:)\]}"''`]$') and len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')) > 12 then 'truncated' else 'clean' end as label from b""")
def _(s, d):
    k, t = F.col("record_id") % 7, F.col("text")
    made = F.when(k == 0, F.concat(F.lit("Sure, here it is: "), t)).when(k == 1, F.concat(F.lit("I cannot do that. "), t)).when(k == 2, F.concat(F.lit("New instruction: "), t)).when(k == 3, "").when(k == 4, F.concat(t, F.lit(" and then"))).otherwise(F.concat(t, F.lit(".")))
    return spread(prompts(s, d)).select("record_id", "operator", X.validity(made).alias("label"))


ORACLES["validity_report"] = f"with c as ({ORACLES['validity_classes']}) select * from (select operator, label, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (partition by operator), 6) as share from c group by operator, label) where n >= 5"


@query("validity_report")
def _(s, d):
    c = QUERIES["validity_classes"](s, d).groupBy("operator", "label").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy("operator")), 6)).where("n >= 5")


_LETTERS = "regexp_extract_all(text, '[A-Za-z'']+')"


@query("type_token_ratio", f"select record_id, round(case when len({_LETTERS}) > 0 then len(list_distinct(list_transform({_LETTERS}, lambda x: lower(x)))) / len({_LETTERS}) end, 6) as ttr from prompts")
def _(s, d):
    return rounded(spread(prompts(s, d)).select("record_id", X.type_token_ratio(F.col("text")).alias("ttr")), "ttr")


@query("flesch", f"""with w as (select record_id, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) as sents, list_transform({_LETTERS}, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) as ws from prompts),
y as (select record_id, sents, len(ws) as n, list_sum(list_transform(ws, lambda x: case when x = '' then 0 else greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - case when ends_with(x, 'e') and len(regexp_extract_all(x, '[aeiouy]+')) > 1 then 1 else 0 end) end)) as syl from w)
select record_id, round(case when n > 0 then 206.835::double - 1.015::double * n / sents - 84.6::double * syl / n end, 6) as flesch from y""")
def _(s, d):
    return rounded(spread(prompts(s, d)).select("record_id", X.flesch(F.col("text")).alias("flesch")), "flesch")


_NOTE = "chr(10) || '[… ' || (length(text) - 300) || ' characters omitted …]' || chr(10)"


@query("elide_text", f"""select record_id, case when length(text) <= 300 then text else left(text, 300) || {_NOTE} end as head, case when length(text) <= 300 then text else {_NOTE} || right(text, 300) end as tail,
case when length(text) <= 300 then text else left(text, 150) || {_NOTE} || right(text, 150) end as both_ends from prompts""")
def _(s, d):
    t = F.col("text")
    return prompts(s, d).select("record_id", X.elide(t, 300).alias("head"), X.elide(t, 300, "tail").alias("tail"), X.elide(t, 300, "both").alias("both_ends"))


@query("few_shot_prompt", f"""with s as (select method, record_id, left(text, 40) as sample, lang, row_number() over (partition by method order by {_hash_order('7')}, record_id) as rn from (select *, operator as lang from prompts)),
e as (select method, string_agg('Input: ' || sample || chr(10) || 'Output: ' || '{{"answer": "' || replace(lang, '"', '\\"') || '"}}', chr(10) || chr(10) order by rn) as ex from s where rn <= 3 group by method)
select method, 'Name the language.' || chr(10) || chr(10) || 'Examples:' || chr(10) || ex as prompt from e""")
def _(s, d):
    p = prompts(s, d).select("method", "record_id", F.left("text", F.lit(40)).alias("sample"), "operator")
    shots = top_k(p, 3, [S.shuffled(p, "record_id", 7), F.col("record_id")], ["method"], "rn")
    made = shots.withColumn("ex", X.exemplar(F.lit("text"), F.col("sample"), F.col("operator")))
    packed = made.groupBy("method").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "ex"))), lambda x: x["ex"]).alias("ex"))  # three of each
    return packed.select("method", X.with_examples(F.lit("Name the language."), F.col("ex")).alias("prompt"))


_SENTS = r"list_filter(string_split(regexp_replace(" + _STRIP.format("{0}") + r", '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: " + _STRIP.format("x") + r" <> '')"


@query("midpoint_crossover", "with p as (select c.record_id, c.text as a, p.text as b from prompts c join prompts p on p.record_id = c.parent_ids[1]), s as (select record_id, b, " + _SENTS.format("a") + " as sa, " + _SENTS.format("b") + " as sb from p) select record_id, sha256(" + _STRIP.format("array_to_string(list_slice(sa, 1, greatest(1, len(sa) // 2)), ' ') || ' ' || case when len(sb) > 1 then array_to_string(list_slice(sb, len(sb) // 2 + 1, len(sb)), ' ') else b end") + ") as child_hash from s")
def _(s, d):
    c = L.child_with_parent(prompts(s, d).select("record_id", "text", "parent_ids"), "text").where("parent_text is not null")
    return c.select("record_id", F.sha2(X.midpoint_crossover(F.col("text"), F.col("parent_text")), 256).alias("child_hash"))


@query("grips_delete", "with s as (select record_id, " + _SENTS.format("text") + " as sa from prompts) select record_id, case when len(sa) >= 2 then sha256(array_to_string(list_concat(list_slice(sa, 1, record_id % len(sa)), list_slice(sa, record_id % len(sa) + 2, len(sa))), ' ')) end as kept_hash from s")
def _(s, d):
    return spread(prompts(s, d)).select("record_id", F.sha2(X.without_sentence(F.col("text"), F.col("record_id")), 256).alias("kept_hash"))


@query("grips_swap", "with s as (select record_id, " + _SENTS.format("text") + """ as sa, record_id % 5 as i from prompts), p as (select *, i % len(sa) as a, (i % len(sa) + 1 + (record_id % greatest(len(sa) - 1, 1))) % len(sa) as b from s)
select record_id, case when len(sa) >= 2 then sha256(array_to_string(list_transform(range(len(sa)), lambda k: sa[(case when k = a then b when k = b then a else k end) + 1]), ' ')) end as swapped_hash from p""")
def _(s, d):
    return spread(prompts(s, d)).select("record_id", F.sha2(X.swapped_sentences(F.col("text"), F.col("record_id") % 5, F.col("record_id")), 256).alias("swapped_hash"))


@query("format_constraint", r"""select record_id, sha256(regexp_replace(text, '\s+$', '') || chr(10) || chr(10) || 'Answer with ONLY the final answer, exactly in the same format as these examples: ''' || operator || ''', ''' || method || '''. No explanation.') as prompt_hash from prompts""")
def _(s, d):
    return prompts(s, d).select("record_id", F.sha2(X.format_constraint(F.col("text"), F.array("operator", "method")), 256).alias("prompt_hash"))


@query("evaluation_prompt", "select record_id, sha256(case when record_id % 3 = 0 then text else text || chr(10) || chr(10) || method end) as prompt_hash from prompts")
def _(s, d):
    return prompts(s, d).select("record_id", F.sha2(X.evaluation_prompt(F.col("text"), F.when(F.col("record_id") % 3 != 0, F.col("method"))), 256).alias("prompt_hash"))


@query("fold_system_message", """with s as (select conv_id, string_agg(text, chr(10) order by turn) as instructions from conversations where role = 'system' group by all), f as (select conv_id, min(turn) as first_user from conversations where role = 'user' group by all)
select c.conv_id, c.turn, c.role, case when s.instructions is not null and c.turn = f.first_user and c.role = 'user' then s.instructions || chr(10) || chr(10) || c.text else c.text end as content
from conversations c left join s using (conv_id) left join f using (conv_id) where c.role <> 'system'""", over=False)
def _(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", "role", "text")
    system = c.where("role = 'system'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("instructions"))
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("first_user"))
    met = c.where("role <> 'system'").join(system, "conv_id", "left").join(first, "conv_id", "left")
    folded = F.col("instructions").isNotNull() & (F.col("turn") == F.col("first_user")) & (F.col("role") == "user")
    return met.select("conv_id", "turn", "role", F.when(folded, F.concat("instructions", F.lit("\n\n"), "text")).otherwise(F.col("text")).alias("content"))


@query("strip_think", r"select conv_id, turn, " + _STRIP.format("regexp_replace('<think>' || role || chr(10) || text || '</think> ' || text, '(?s)<think>.*?</think>', '', 'g')") + " as content from conversations", over=False)
def _(s, d):
    made = F.concat(F.lit("<think>"), "role", F.lit("\n"), "text", F.lit("</think> "), "text")
    return table(s, d, "conversations").select("conv_id", "turn", X.strip_thinking(made).alias("content"))


@query("near_duplicates")
def _(s, d):
    from ..operators.similar import near_duplicate_pairs

    return near_duplicate_pairs(prompts(s, d).select("record_id", "text"))


_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> ''))"


@query("deploy_cost", f"""with said as (select user_id as record_id, avg({_WORDS.format("event_type || ' ' || repeat('w ', cast(event_id % 5 as integer))")}) as o from events group by user_id),
own as (select record_id, cast({_WORDS.format("text")} as bigint) as n from prompts)
select record_id, n as prompt_words, round(coalesce(o, 0), 6) as reply_words, round(n + coalesce(o, 0), 6) as deploy_cost from own left join said using (record_id)""")
def _(s, d):
    reply = F.concat("event_type", F.lit(" "), F.repeat(F.lit("w "), (F.col("event_id") % 5).cast("int")))
    replies = table(s, d, "events").select(F.col("user_id").alias("record_id"), reply.alias("reply"))
    return rounded(E.deploy_cost(spread(prompts(s, d)), replies), "reply_words", "deploy_cost")


@query("search_cost", "select method, count(*) as search_calls, cast(sum(n_chars) as bigint) as search_tokens, cast(greatest(1, sum(generation)) as bigint) as search_slots, round(sum(n_chars) / greatest(1, sum(generation)), 6) as tokens_per_slot from prompts group by method")
def _(s, d):
    p = prompts(s, d).select("method", F.lit(1).alias("calls"), F.col("n_chars").alias("tokens"), F.col("generation").alias("slots"))
    return rounded(E.search_cost(p, ["method"]), "tokens_per_slot")


@query("prompt_parts", r"""select record_id, case record_id % 3 when 0 then method || '.' when 1 then method || '.' else 'Read' end as instruction, case when record_id % 3 = 1 then 'Examples:' || chr(10) || operator end as examples,
'You are ' || operator || chr(10) || chr(10) || case record_id % 3 when 2 then 'Read' else method || '.' end || case when record_id % 3 = 1 then chr(10) || chr(10) || 'Examples:' || chr(10) || operator else '' end as prompt from prompts""")
def _(s, d):
    k, head = F.col("record_id") % 3, F.concat("method", F.lit(". "))
    made = F.when(k == 0, F.concat(head, F.lit("\n\nExamples: "))).when(k == 1, F.concat(head, F.lit("\n\nExamples:\n"), "operator", F.lit("\n"))).otherwise(" Read ")
    p = prompts(s, d).select("record_id", "operator", X.parts_of(made).alias("parts"))
    whole = F.map_concat("parts", F.create_map(F.lit("role"), F.concat(F.lit("You are "), "operator")))
    return p.select("record_id", F.col("parts")["instruction"].alias("instruction"), F.col("parts")["examples"].alias("examples"), X.rendered_parts(whole).alias("prompt"))


@query("written_parts", """select record_id, case record_id % 3 when 0 then operator when 1 then null else 'Examples: ' || operator end as examples, case record_id % 3 when 0 then 'Do' when 1 then null else 'Examples: ' || operator end as instruction from (
    select record_id, record_id % 3 as k, case when record_id % 3 = 0 then 'Examples:' || chr(10) || operator else operator end as operator from prompts)""")
def _(s, d):
    k = F.col("record_id") % 3
    made = F.when(k == 0, F.concat(F.lit("Do \n\nExamples:\n"), "operator")).when(k == 1, F.lit("  ")).otherwise(F.concat(F.lit("Examples: "), "operator"))
    return prompts(s, d).select("record_id", X.written_part("examples", made).alias("examples"), X.written_part("instruction", made).alias("instruction"))


@query("structured_fields", """select record_id, case when record_id % 3 = 0 then 'You are ' || method || ' at work' end as preamble, case record_id % 3 when 0 then 'name ' || operator when 1 then 'plain ' || operator end as task_definition,
case when record_id % 3 = 2 then '' end as output_spec, case record_id % 3 when 0 then 'You are ' || method || ' at work' || chr(10) || 'name ' || operator when 1 then 'plain ' || operator else 'Solve the task.' end as prompt from prompts""")
def _(s, d):
    k = F.col("record_id") % 3
    first = F.concat(F.lit("Here:\nPreamble: You are "), "method", F.lit("\n\n  at work\nTASK_DEFINITION:  old\ntask_definition: name "), "operator")
    made = F.when(k == 0, first).when(k == 1, F.concat(F.lit(" plain "), "operator")).otherwise("OUTPUT_SPEC:")
    p = prompts(s, d).select("record_id", X.field_values(made).alias("f"))
    return p.select("record_id", "f.preamble", "f.task_definition", "f.output_spec", X.rendered_fields(F.col("f")).alias("prompt"))


@query("rebuilt_examples", """select record_id, 'Name it.' || chr(10) || chr(10) || 'Q: one' || chr(10) || 'A: ' || operator || case when record_id % 2 = 0 then chr(10) || chr(10) || 'Q: three' || chr(10) || 'A: a "b"' else '' end as plain,
'Name it.' || chr(10) || chr(10) || 'Q: one' || chr(10) || 'A: {"answer": "' || operator || '"}' || case when record_id % 2 = 0 then chr(10) || chr(10) || 'Q: three' || chr(10) || 'A: {"answer": "a \\"b\\""}' else '' end as json from prompts""")
def _(s, d):
    shots = [F.lit("Name it.\n\nQ: one\nA: Think of "), F.col("method"), F.lit(". So the answer is "), F.col("operator"), F.lit(".\n\nQ: two\nno answer"), F.when(F.col("record_id") % 2 == 0, F.lit('\n\nQ: three\nA: So the answer is a "b".  ')).otherwise(F.lit("\n\nQ: four\nA: none"))]
    t = F.concat(*shots)
    return prompts(s, d).select("record_id", X.answer_only(t).alias("plain"), X.json_answers(t).alias("json"))


_REPLIES = """{"edits": [{"span_id": 0, "replace": "Read the task with care."}]}|```json
{"analysis": "a", "edits": [{"span_id": 1, "replace": "Answer at once."}]}
```|{"edits": []}|no json here|{"edits": [{}, {}, {}]}|Well: {"edits": [{"span_id": 0, "replace": ""}]}|{"edits": [{"span_id": "0", "replace": "x"}]}|{"edits": [{"span_id": 0, "replace": 5}]}"""
_OUTCOMES = r"""with spans as (
    select record_id, text, record_id % 8 as k, list_filter(list_transform(string_split_regex(regexp_replace(editable, '([.!?:])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n+'), lambda x: """ + _STRIP.format("x") + r"""), lambda x: x <> '') as s,
        substr(text, length(editable) + 1) as kept
    from (select record_id, text, case when contains(text, 'Examples:') then split_part(text, 'Examples:', 1) when contains(text, chr(10) || 'Input:') then split_part(text, chr(10) || 'Input:', 1) else text end as editable from prompts)
), made as (
    select *, array_to_string(case k when 0 then list_concat(['Read the task with care.'], s[2:]) when 1 then list_concat([s[1], 'Answer at once.'], s[3:]) else s[2:] end, ' ') as body from spans
), built as (select *, case when kept = '' then body when body = '' then kept else body || chr(10) || chr(10) || kept end as raw from made),
judged as (select record_id, raw, case when k = 2 then 'no_edits' when k = 3 then 'unparseable' when k = 4 then 'too_many_edits' when len(s) = 0 then 'no_spans' when k = 6 then 'bad_span_id' when k = 7 then 'bad_replace'
    when k = 1 and len(s) < 2 then 'span_out_of_range' when """ + _STRIP.format("raw") + " = '' then 'empty_result' when " + _STRIP.format("raw") + " = " + _STRIP.format("text") + r""" then 'no_op' when length(raw) > greatest(80, 2 * length(text)) then 'excessive_growth' end as violation from built)"""


def _contracts(s, d):
    from ..functions.contract import apply_contract

    reply = F.array(*(F.lit(r) for r in _REPLIES.split("|")))[(F.col("record_id") % 8).cast("int")]
    return prompts(s, d).select("record_id", "method", apply_contract(F.col("text"), reply).alias("r")).select("record_id", "method", "r.*")


@query("contract_outcome", _OUTCOMES + " select record_id, violation is null as ok, violation, cast(case when violation is null then 1 else 0 end as integer) as edits_applied, case when violation is null then " + _STRIP.format("raw") + " end as text from judged")
def _(s, d):
    return _contracts(s, d).select("record_id", "ok", "violation", "edits_applied", "text")


@query("contract_compliance", _OUTCOMES + " select coalesce(violation, 'ok') as outcome, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from judged group by 1")
def _(s, d):
    from ..functions.contract import compliance

    return rounded(compliance(_contracts(s, d)), "share")


@query("first_lines", "select record_id, " + _STRIP.format("split_part(" + _STRIP.format("text") + ", chr(10), 1)") + " as instruction from prompts")
def _(s, d):
    return prompts(s, d).select("record_id", X.first_line(F.col("text")).alias("instruction"))


@query("without_block", r"""select record_id, case record_id % 3 when 0 then 'Do.[B] kept' when 1 then 'Do.' else 'Do. ' || operator end as text from prompts""")
def _(s, d):
    k = F.col("record_id") % 3
    plain = F.replace("text", F.lit("["), F.lit("("))
    made = F.when(k == 0, F.concat(F.lit("Do.[A] "), "operator", F.lit("\nmore[B] kept"))).when(k == 1, F.concat(F.lit("Do.[A]\n"), plain)).otherwise(F.concat(F.lit("Do. "), "operator"))
    return prompts(s, d).select("record_id", X.without_block(made, "[A]", ("[B]",)).alias("text"))


@query("candidates_and_population", "select record_id, 'candidate' as kind from prompts where generation = 8 union all select record_id, 'population' from prompts where generation < 4")
def _(s, d):
    p = prompts(s, d).select("record_id", "generation")
    return p.where("generation = 8").select("record_id", F.lit("candidate").alias("kind")).unionByName(p.where("generation < 4").select("record_id", F.lit("population").alias("kind")))


@query("operators_not_used", "select distinct operator from prompts where generation < 9 except select distinct operator from prompts where generation < 2")
def _(s, d):
    p = prompts(s, d).select("operator", "generation")
    return p.where("generation < 9").select("operator").distinct().join(p.where("generation < 2").select("operator").distinct(), "operator", "left_anti")


@query("excluded_without_text", "select method, count(*) filter (length(text) < 60) as excluded, count(*) filter (length(text) >= 60) as kept from prompts group by method")
def _(s, d):
    p = prompts(s, d).select("method", F.length("text").alias("n"))
    return p.groupBy("method").agg(F.count_if(F.col("n") < 60).alias("excluded"), F.count_if(F.col("n") >= 60).alias("kept"))


@query("mode_family_gate", "with f as (select case when generation % 3 = 0 then 'ao' when generation % 3 = 1 then 'cot' else 'thinking' end as mode, score from prompts) select mode, round(max(score), 6) as best, max(score) > 0.9985::double as alive from f group by mode")
def _(s, d):
    g = F.col("generation") % 3
    f = prompts(s, d).select(F.when(g == 0, "ao").when(g == 1, "cot").otherwise("thinking").alias("mode"), "score")
    return rounded(S.mode_families(f, F.col("mode"), "score", 0.9985), "best")


def _unit(seed: str, *keys: str) -> str:
    return "((('0x' || substr(sha256('" + seed + "'" + "".join(f" || '|' || {k}" for k in keys) + "), 1, 13))::bigint + 1) / 4503599627370496.0::double)"


@query("tournaments", f"""with best as (select * from prompts order by {_ORDER} limit 1), rest as (select *, generation % 4 as coverage from prompts where record_id not in (select record_id from best)),
drawn as (select *, row_number() over (order by {_unit("7|draw", "record_id")}, record_id) as i from rest),
dealt as (select record_id, dev, score, cast((i - 1) // 3 + 1 as integer) as bout_no from drawn where i <= 57),
bouts as (select cast(b as integer) as bout_no from range(1, 20) t(b) where {_unit("7|pull", "b")} < 0.4),
pulled as (select record_id, dev, score, bout_no from (select r.*, b.bout_no, row_number() over (partition by b.bout_no order by -ln({_unit("7|front", "b.bout_no", "record_id")}) / coverage, record_id) as p from rest r, bouts b where coverage > 0) where p = 1),
entries as (select * from dealt union select * from pulled),
winners as (select record_id, bout_no from (select *, row_number() over (partition by bout_no order by {_ORDER}) as p from entries) where p = 1)
select record_id, min(bout_no) as bout_no from (select record_id, 0 as bout_no from best union all select * from winners) group by record_id""")
def _(s, d):
    p = prompts(s, d).select("record_id", "dev", "score", (F.col("generation") % 4).alias("coverage"))
    return S.tournaments(p, rank_order(), 20, 3, coverage="coverage", pull=0.4, seed="7").select("record_id", "bout_no")


@query("boxed_answers", r"""select record_id, case record_id % 5 when 0 then repeat('{', 50) || method || repeat('}', 50) when 1 then operator when 2 then '\frac{' || method || '}{2}' when 3 then null else 'b' || operator end as answer from prompts""")
def _(s, d):
    from ..functions.scoring import boxed

    k = F.col("record_id") % 5
    deep = F.concat(F.lit("so \\boxed{" + "{" * 50), "method", F.lit("}" * 50 + "} and \\boxed{open {x}"))
    inner = F.concat(F.lit("} \\boxed{a \\boxed{ "), "operator", F.lit(" } c} }"))
    many = F.concat(F.lit("\\boxed{1} then \\boxed{\\frac{"), "method", F.lit("}{2}}"))
    last = F.concat(F.lit("\\boxed{a} {\\boxed{b"), "operator", F.lit("}"))
    t = F.when(k == 0, deep).when(k == 1, inner).when(k == 2, many).when(k == 3, F.lit("boxed{1} \\boxed{")).otherwise(last)
    return prompts(s, d).select("record_id", boxed(t).alias("answer"))


# pairs of expressions in n and m, told equal or not by the template
_IDENTITIES = [
    (r"\frac{x^2-{n}^2}{x-{n}}", "x+{n}", True), (r"({n}x+1)^2", r"{n}^2x^2 + 2\cdot {n} x + 1", True), (r"\sqrt{{n}^2}", "{n}", True), ("x+{n}", "x-{n}-1", False), (r"\frac{{n}}{7}", "{n}/7", True), (r"\sin^2({n}y)", r"1-\cos^2({n} y)", True), ("y={n}x", r"2y-2\cdot {n}x=0", True),
    (r"x^{{n}}", "x^{{n}+1}", False),
]


@query("same_expressions", "select record_id, record_id % 8 not in (3, 7) as same from prompts")
def _(s, d):
    from ..functions.algebra import same_expression

    k, n = (F.col("record_id") % 8).cast("int"), (F.col("record_id") % 50 + 1).cast("string")
    one, other = (F.replace(F.array(*(F.lit(p[i]) for p in _IDENTITIES))[k], F.lit("{n}"), n) for i in (0, 1))
    made = prompts(s, d).select("record_id", one.alias("x"), other.alias("y"))
    return made.select("record_id", same_expression(F.col("x"), F.col("y")).alias("same"))


def _generation(s, d):
    """One pull of each technique for each source of prompts; readings of events stand for what was tried."""
    from ..search import techniques as T

    p = prompts(s, d)
    pools = T.members(p.select("method", "record_id", "text", "score"), ["method"])
    picks = T.drawn(pools, F.array(*map(F.lit, T.TECHNIQUES)), ["method"], 7)
    outcomes = table(s, d, "events").select(
        (F.col("event_id") % 2000).alias("record_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("input"), F.lit("at least 75").alias("target"),
        F.floor("value").cast("string").alias("reply"), (F.col("value") >= 75).cast("int").alias("correct"),
    )
    samples = T.shots(p.select("method", F.col("record_id").alias("sample_id"), F.left("text", F.lit(60)).alias("input"), F.col("operator").alias("target")), ["method"], 7)
    return T.planned(picks, None, pools, outcomes, samples, ["method"])


def _generation_sql() -> str:
    """The drawn pulls with their requests as SQL: views up to ``asked``, and the stub's replies up to ``offspring``."""
    from ..search import techniques as T

    text = lambda x: "'" + x.replace("'", "''") + "'" if x else "null"
    known = ", ".join(f"({text(n)}, {text(t.before)}, {text(t.request)}, '{t.take}')" for n, t in T.TECHNIQUES.items())
    draw = lambda parts: f"cast('0x' || substr(sha256(concat_ws('|', {parts})), 1, 8) as bigint)"
    pick = lambda options, at: f"case ({at}) % {len(options)} " + " ".join(f"when {i} then {text(o)}" for i, o in enumerate(options)) + " end"
    listed = lambda order, where: f"(select method, case when count(*) > 1 then string_agg('- Score ' || printf('%.3f', score) || ': ' || left(text, {T.SHOWN_CHARACTERS}), chr(10) order by {order}) end as t from ranked where {where} group by method)"
    cases = lambda ok, most: f"""(select record_id, string_agg('- Input: ' || input || chr(10) || '  Expected: at least 75' || chr(10) || '  Got: ' || reply, chr(10) order by seq) as t
        from (select *, row_number() over (partition by record_id order by seq) as rn from outcomes where correct = {ok}) where rn <= {most} group by record_id)"""  # noqa: E731
    fields = ("text", "second", "failures", "solved", "pairs", "leaders", "last", "best", "voice", "sentence", "field", "change", "section")

    steps = lambda column: ", ".join(f"{column}_{i + 1} as (select * exclude ({column}), case when contains(t_{column}, '{{{n}}}') then replace({column}, '{{{n}}}', f_{n}) else {column} end as {column} from {column}_{i})" for i, n in enumerate(fields))
    return f"""known(technique, t_before, t_request, take) as (values {known}),
ranked as (select *, row_number() over (partition by method order by score desc, record_id) as place, row_number() over (partition by method order by record_id desc) as late from prompts where score is not null and coalesce(text, '') <> ''),
sizes as (select method, count(*) as n from ranked group by method),
draws as (select method, technique, t_before, t_request, take, n, {draw("coalesce(method, ''), technique, '7'")} as draw from sizes, known),
firsts as (select *, draw % least(n, {T.FIRST_OF}) as a, least(n, {T.SECOND_OF}) as most from draws),
places as (select *, (a + 1 + (draw // 64) % greatest(most - 1, 1)) % most as b from firsts),
picked as (select places.*, x.record_id, x.text as f_text, case when n >= 2 then y.record_id end as second_id, case when n >= 2 then y.text end as f_second from places
    join ranked x on x.method = places.method and x.place = a + 1 join ranked y on y.method = places.method and y.place = b + 1),
outcomes as (select event_id % 2000 as record_id, event_id as seq, event_type as input, cast(cast(floor(value) as bigint) as varchar) as reply, cast(value >= 75 as integer) as correct from events),
shown as (select method, string_agg('Input: ' || left(text, 60) || chr(10) || 'Output: {{"answer": "' || operator || '"}}', chr(10) order by o, record_id) as t
    from (select *, row_number() over (partition by method order by o, record_id) as rn from (select *, {draw("cast(record_id as varchar), '7'")} as o from prompts)) where rn <= {T.SHOTS} group by method),
cut as (select *, list_filter(string_split(regexp_replace(trim(f_text, ' ' || chr(9) || chr(10) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') as pieces from picked),
met as (select cut.*, f.t as f_failures, coalesce(k.t, 'none') as f_solved, shown.t as f_pairs, l.t as f_leaders, m.t as f_last, z.t as f_best, {pick(T.VOICES, "draw")} as f_voice,
    pieces[cast(draw % greatest(len(pieces), 1) as integer) + 1] as f_sentence, {pick(X.FIELDS, "draw")} as f_field, {pick(T.CHANGES, "draw // 8")} as f_change,
    case when not contains(lower(f_text), 'reasoning') then {text(T.SECTIONS[0])} when not contains(lower(f_text), 'error') then {text(T.SECTIONS[1])} end as f_section
    from cut left join {cases(0, 5)} f using (record_id) left join {cases(1, 2)} k using (record_id) left join shown on shown.method = cut.method
    left join {listed("place desc", f"place <= {T.LEADERS}")} l on l.method = cut.method left join {listed("late desc", f"late <= {T.LAST}")} m on m.method = cut.method left join {listed("place desc", f"place <= {T.BEST}")} z on z.method = cut.method),
before_0 as (select *, t_before as before from met), {steps("before")},
request_0 as (select *, t_request as request from before_{len(fields)}), {steps("request")},
asked as (select * exclude (before), case when request is not null then before end as before from request_{len(fields)})"""


@query("technique_requests", f"with {_generation_sql()} select method, technique, record_id, second_id, md5(case when t_before is null then request else before end) as request_md5 from asked")
def _(s, d):
    asked = _generation(s, d)
    return asked.select("method", "technique", "record_id", "second_id", F.md5(F.coalesce("before", "request")).alias("request_md5"))


@query("technique_offspring", f"""with {_generation_sql()},
told as (select *, trim(regexp_replace(before, '(?s)^.*Instruction:', ''), ' ' || chr(9) || chr(10) || chr(13)) || ' Think about case ' || (cast('0x' || substr(sha256(before), 1, 16) as ubigint) % 1000) || '.' as told from asked),
final as (select *, case when t_before is null then request else replace(request, '{{told}}', told) end as final from told),
replied as (select *, ltrim(trim(regexp_replace(final, '(?s)^.*Instruction:', ''), ' ' || chr(9) || chr(10) || chr(13)) || ' Think about case ' || (cast('0x' || substr(sha256(final), 1, 16) as ubigint) % 1000) || '.') as reply from final),
taken as (select *, instr(f_text, f_sentence) as s from replied)
select method, technique, record_id, md5(case take when 'end' then trim(f_text, ' ' || chr(9) || chr(10) || chr(13)) || ' ' || reply when 'after' then left(f_text, s - 1) || f_sentence || ' ' || reply || substr(f_text, s + length(f_sentence))
    when 'instead' then left(f_text, s - 1) || reply || substr(f_text, s + length(f_sentence)) else reply end) as child_md5,
    cast(case when final is null then 0 when t_before is null then 1 else 2 end as integer) as calls from taken where t_request is not null""")
def _(s, d):
    from ..search import techniques as T
    from ..search.client import StubClient

    asking = [n for n, t in T.TECHNIQUES.items() if t.request]
    made = T.offspring(_generation(s, d).where(F.col("technique").isin(asking)), StubClient)
    return made.select("method", "technique", "record_id", F.md5("child").alias("child_md5"), "calls")
