"""Queries that score templated replies, each beside a DuckDB statement of what the template must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as C
from ..sources.fixtures import table
from ..sources.storage import spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = f"with b as ({_BASE}){'' if sql.startswith(',') else ' '}{sql.strip()}"
        return f

    return keep


# n and m are small numbers that often agree; k chooses the template
_BASE = """select l_orderkey as id, l_linenumber as line, cast(l_orderkey % 60 as varchar) as n, cast((l_orderkey + case when l_partkey % 2 = 0 then 0 else l_suppkey end) % 60 as varchar) as m,
    chr(cast(65 + l_orderkey % 5 as integer)) as c, chr(cast(65 + (l_orderkey + l_partkey % 2) % 5 as integer)) as e, l_orderkey % 2 = 0 as y, (l_orderkey + l_partkey) % 2 = 0 as z, l_linenumber % 6 as k from lineitem"""


def _base(s, d):
    i = spread(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    key = F.col("l_orderkey")
    return i.select(
        key.alias("id"), F.col("l_linenumber").alias("line"), (key % 60).cast("string").alias("n"), ((key + F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(F.col("l_suppkey"))) % 60).cast("string").alias("m"),
        F.chr(65 + key % 5).alias("c"), F.chr(65 + (key + F.col("l_partkey") % 2) % 5).alias("e"), (key % 2 == 0).alias("y"), ((key + F.col("l_partkey")) % 2 == 0).alias("z"), (F.col("l_linenumber") % 6).alias("k"),
    )


def _replies(s, d, reply, target):
    """Replies and targets as columns, so that they are made once however often a scorer reads them."""
    return _base(s, d).select("id", "line", reply.alias("p"), target.alias("t"))


def _choose(*options):
    k = F.col("k")
    out = F.when(k == 0, options[0])
    for i, o in enumerate(options[1:], 1):
        out = out.when(k == i, o)
    return out


def _text(*parts):
    return F.concat(*(F.lit(p) if p not in ("n", "m", "c", "e", "w") else F.col(p) for p in parts))


_DIGITS = "cast(right(n, length(m)) = m or cast(n as integer) = cast(m as integer) as integer)"


@query("score_math", f"""select id, line, case k when 0 then {_DIGITS} when 1 then {_DIGITS} when 2 then 0 when 3 then 0 when 4 then cast(n = m as integer) else cast(n = m as integer) end as score from b""")
def _(s, d):
    p = _choose(_text("#### ", "n"), _text("The answer is ", "n"), _text("\\boxed{", "n", "}"), _text("The answer is ", "n", "."), _text("result: ", "n", ".5"), _text("so \\boxed{\\frac{", "n", "}{7}}"))
    t = _choose(F.col("m"), F.col("m"), F.col("m"), F.col("m"), _text("m", ".5"), _text("\\frac{", "m", "}{7}"))
    return _replies(s, d, p, t).select("id", "line", C.score_math(F.col("p"), F.col("t")).alias("score"))


@query("score_mcq", "select id, line, cast(c = e as integer) as score from b")
def _(s, d):
    p = _choose(F.col("c"), _text("The answer is ", "c"), _text("(", "c", ")"), _text("choice: ", "c", "."), _text('{"answer": "', "c", '"}'), _text("c", ". because of that"))
    return _base(s, d).select("id", "line", C.score_choice(p, _choose(F.col("e"), _text("(", "e", ")"), F.col("e"), F.col("e"), F.col("e"), F.col("e"))).alias("score"))


@query("score_boolean", "select id, line, case k when 5 then 0 else cast(y = z as integer) end as score from b")
def _(s, d):
    y, z = F.col("y"), F.col("z")
    either = lambda a, b: F.when(y, a).otherwise(b)
    p = _choose(either("yes", "No"), either("True", "false"), either("the answer is yes", "the answer is no"), either("Hence the argument is valid", "Hence the argument is invalid"), either('{"answer": "Yes"}', '{"answer": "no"}'), F.lit("maybe"))
    return _base(s, d).select("id", "line", C.score_boolean(p, F.when(z, "yes").otherwise("no")).alias("score"))


@query("score_text", "select id, line, case k when 5 then 0 else cast(n = m as integer) end as score from b")
def _(s, d):
    p = _choose(_text("Item ", "n"), _text("  item   ", "n", " "), _text("ITEM\t", "n"), _text("item\n", "n"), _text("item ", "n"), _text("item ", "n", "!"))
    return _base(s, d).select("id", "line", C.score_text(p, _text("item ", "m")).alias("score"))


@query("score_auto", f"""select id, line, case k when 0 then {_DIGITS} when 1 then {_DIGITS} when 2 then cast(c = e as integer) when 3 then cast(y = z as integer) when 4 then {_DIGITS} else cast(c = e as integer) end as score from b""")
def _(s, d):
    y, z = F.col("y"), F.col("z")
    p = _choose(_text("I think so.\nThe answer is ", "n", "."), _text("thus \\boxed{", "n", "}"), _text("<solution> (", "c", ") </solution>"), F.when(y, "So the answer is Yes.").otherwise("So the answer is No."), _text("work\n#### ", "n"), _text('{"answer": "kind ', "c", '"}'))
    t = _choose(F.col("m"), F.col("m"), F.col("e"), F.when(z, "Yes").otherwise("No"), F.col("m"), _text("kind ", "e"))
    return _replies(s, d, p, t).select("id", "line", C.score_auto(F.col("p"), F.col("t")).alias("score"))


@query("extract_number", "select id, line, case k when 0 then cast(n as double) when 1 then -cast(n as double) when 2 then cast(n as double) + 0.5 when 3 then cast(n as double) when 4 then cast(n as double) else null end as number from b")
def _(s, d):
    p = _choose(F.col("n"), _text("the result is -", "n"), _text("x = ", "n", ".5"), _text("#### ", "n"), _text("\\boxed{", "n", "} or so"), F.lit("no number here"))
    return _base(s, d).select("id", "line", C.number(p).alias("number"))


@query("extract_choice", "select id, line, case k when 5 then null else c end as choice from b")
def _(s, d):
    p = _choose(F.lower("c"), _text("Answer: ", "c", ")"), _text("c", ") it is"), _text("I pick (", "c", ") here"), _text("It must be ", "c"), F.lit("random text"))
    return _base(s, d).select("id", "line", C.choice(p).alias("choice"))


@query("extract_final_answer", "select id, line, case k when 0 then n when 1 then '\\frac{' || n || '}{2}' when 2 then m when 3 then n when 4 then 'it is ' || n else '] )' end as answer from b")
def _(s, d):
    p = _choose(_text("<SOLUTION>\n", "n", "\n</SOLUTION>"), _text("\\boxed{1} then \\boxed{\\frac{", "n", "}{2}}"), _text("The answer is ", "n", ". No, the answer is ", "m", "."), _text("a\nAnswer: ", "n", "\nb"), _text("Hence, it is ", "n"), F.lit("brackets\n] )\nend"))
    return _base(s, d).select("id", "line", C.reasoned_answer(p).alias("answer"))


@query("final_answer_marks", "select id, line, k <> 5 as has_answer, k = 5 and length(n) > 1 as truncated from b")
def _(s, d):
    p = _choose(_text("\\boxed{", "n", "}"), _text("<solution>", "n"), _text("The answer is ", "n", " maybe"), _text("x\nAnswer: ", "n", " or"), _text("ends with ", "n"), F.lit("this goes on and on"))
    b = _base(s, d).withColumn("p", p)
    return b.select("id", "line", C.has_final_answer(F.col("p")).alias("has_answer"), C.is_truncated(F.col("p"), F.when(F.length("n") > 1, 4).otherwise(400)).alias("truncated"))


@query("normalise_math", "select id, line, case k when 0 then n when 1 then '(' || n || ')' when 2 then 'x^2' when 3 then n || '%' when 4 then '\\frac{' || n || '}{2}' else n || 'x' end as normal from b")
def _(s, d):
    p = _choose(_text("$ ", "n", " $"), _text("\\left( ", "n", " \\right)"), F.lit("X^2 + C"), _text(" ", "n", " %"), _text("\\frac{", "n", "}\\, {2}"), _text("n", "\\; X"))
    return _base(s, d).select("id", "line", C.normalised_math(C.without_constant(p)).alias("normal"))


@query("detect_task_type", """, g as (select line, list(case line when 1 then n when 2 then '(' || c || ')' when 3 then case when y then 'Yes' else 'no' end else case when cast(n as integer) % 2 = 0 then n else 'word' || n end end) as ts from (select distinct line, n, c, y from b where cast(n as integer) < 20) group by line)
select line, case line when 1 then 'math' when 2 then 'mcq' when 3 then 'boolean' else 'auto' end as task_type from g""")
def _(s, d):
    b = _base(s, d).where(F.col("n").cast("int") < 20).select("line", "n", "c", "y").distinct()
    line = F.col("line")
    t = F.when(line == 1, F.col("n")).when(line == 2, F.concat(F.lit("("), "c", F.lit(")"))).when(line == 3, F.when(F.col("y"), "Yes").otherwise("no")).otherwise(F.when(F.col("n").cast("int") % 2 == 0, F.col("n")).otherwise(F.concat(F.lit("word"), "n")))
    first = b.withColumn("t", t).groupBy("line").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # at most sixty targets
    return first.select("line", C.task_type(F.col("ts")).alias("task_type"))


@query("last_answer", """select id, line, case k when 0 then n when 1 then m || ',5' when 2 then '?' when 3 then n || '.5' else m end as answer from b""")
def _(s, d):
    p = _choose(_text("3 and 4 make: the answer is ", "n", "."), _text("The Answer is $9; no, the answer is ", "m", ",5"), F.lit("no number"), _text("from 8 to ", "n", ".5"), _text("answer is ", "m"), _text("7, ", "m"))
    return _base(s, d).select("id", "line", C.last_answer(p).alias("answer"))


@query("expected_target", r"""select id, line, case k when 0 then 'answer ' || n
    when 1 then 'the function must satisfy:' || chr(10) || 'input ''' || n || '\n'' -> ''' || m || '''' || chr(10) || 'input 5 -> "it''s"'
    when 2 then 'a function named `f' || n || '` that satisfies:' || chr(10) || 'assert f(1) == ' || m || chr(10) || 'assert f(2)'
    when 3 then 'the function must satisfy:' || chr(10) || '(test cases unavailable)'
    when 4 then 'a function that satisfies:' || chr(10) || '(assertions unavailable)' else '[' || n || ']' end as expected from b""")
def _(s, d):
    from ..functions.failures import expected

    cases = _text(r'{"test_cases": [{"input": "', "n", r'\n", "output": "', "m", r'"}, {"input": 5, "output": "it' + "'" + r's"}, 3]}')
    harness = _text(r'{"entry_point": "f', "n", r'", "test": "def check(f):\n    assert f(1) == ', "m", r'\n    x = 1\n    assert f(2)\n"}')
    t = _choose(_text("answer ", "n"), cases, harness, F.lit('{"test_cases": []}'), F.lit('{"test": null}'), _text("[", "n", "]"))
    return _base(s, d).select("id", "line", expected(t).alias("expected"))
