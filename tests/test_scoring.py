import time

import pytest
from pyspark.sql import functions as F

from promptloom.functions import algebra, contract
from promptloom.functions import scoring as C
from promptloom.functions import text as X
from promptloom.plans import scoring_queries, source_queries

FOLDER = "/root/testdata/sf0.001"

PAIRS = [
    ("math", "42", "42", 1), ("math", "3.14", "3.14", 1), ("math", "-5", "-5", 1), ("math", "The answer is 42", "42", 1), ("math", "result: 3.14", "3.14", 1), ("math", "#### 7", "7", 1), ("math", "43", "42", 0),
    ("math", "The answer is 5", "10", 0), ("math", "The answer is 42.", "42", 0), ("math", "\\boxed{42}", "42", 0), ("math", "142", "42", 1), ("math", "so 25", "025", 1), ("math", "\\boxed{\\frac{1}{2}}", "\\frac{1}{2}", 1),
    ("math", "so x^2 + C", "x^2", 0), ("math", "The answer is x^2 + C", "x^2", 1), ("math", "(B) is it", "B", 1), ("mcq", "A", "A", 1), ("mcq", "A", "B", 0), ("mcq", "The answer is B", "B", 1), ("mcq", "(C)", "C", 1), ("mcq", "choice: D", "D", 1),
    ("boolean", "yes", "yes", 1), ("boolean", "True", "true", 1), ("boolean", "yes", "no", 0), ("boolean", "the argument is invalid", "invalid", 1), ("text", "Hello World", "hello world", 1), ("text", "  spaces  ", "spaces", 1), ("text", "Hello World!", "hello world", 0),
    ("auto", "yes", "yes", 1), ("auto", "no", "yes", 0), ("auto", "A", "A", 1), ("auto", "42", "42", 1), ("auto", "so \\boxed{42}", "42", 1), ("auto", "] )", "] )", 1), ("auto", None, "42", 0), ("auto", "", "x", 0),
]


def test_scores(spark):
    df = spark.createDataFrame([(i, p, t) for i, (_, p, t, _) in enumerate(PAIRS)], "i int, p string, t string")
    got = {}
    for kind in {p[0] for p in PAIRS}:
        rows = df.where(F.col("i").isin([i for i, p in enumerate(PAIRS) if p[0] == kind]))
        got |= {r["i"]: r["s"] for r in rows.select("i", C.score(kind, F.col("p"), F.col("t")).alias("s")).collect()}
    assert {i: (p, got[i]) for i, p in enumerate(PAIRS) if (got[i] or 0) != p[3]} == {}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,number,letter,truth", [
    ("42", 42.0, None, None), ("-5", -5.0, None, None), ("The answer is 7", 7.0, None, None), ("#### 100", 100.0, None, None), ("no number here", None, None, False), ("A", None, "A", None), ("(B)", None, "B", None),
    ("The answer is C", None, "C", None), ("random text", None, None, None), ("yes", None, None, True), ("false", None, None, False), ("maybe", None, None, None), ("1_000", 1000.0, None, None), ("1d", None, None, None), ("inf", float("inf"), None, None), ('{"answer": "No"}', None, None, False),
])
def test_extractors(spark, text, number, letter, truth):
    t = F.lit(text)
    row = spark.range(1).select(C.number(t).alias("n"), C.choice(t).alias("c"), C.boolean(t).alias("b")).first()
    assert (row["n"], row["c"], row["b"]) == (number, letter, truth)


def test_boxes_nest_and_the_last_closed_counts(spark):
    assert one(spark, C.boxed(F.lit(r"\boxed{1} and \boxed{\frac{\sqrt{2}}{2}} \boxed{open"))) == r"\frac{\sqrt{2}}{2}"
    assert one(spark, C.boxed(F.lit("nothing"))) is None


def test_values_of_latex(spark):
    assert one(spark, C.boxed(F.lit("a \\boxed{" + "{" * 50 + "7" + "}" * 50 + "} b \\boxed{open {x}"))) == "{" * 50 + "7" + "}" * 50
    assert one(spark, C.boxed(F.lit(r"} \boxed{a \boxed{ b } c} }"))) == "b" and one(spark, C.boxed(F.lit(None).cast("string"))) is None
    df = spark.createDataFrame([(r"The answer is \frac{1}{2}", "0.5"), ("The answer is 0.4", r"\frac{1}{2}"), (r"\boxed{\frac{x^2-1}{x-1}} + C", "x+1")], "p string, t string")
    assert [r["s"] for r in df.select(C.score_math(F.col("p"), F.col("t"), symbolic=True).alias("s")).collect()] == [1, 0, 1]


@pytest.mark.parametrize("reply,violation", [
    ("", "unparseable"), ("no json", "unparseable"), ('{"edits": []}', "no_edits"), ('{"edits": [1,2,3]}', "too_many_edits"), ('{"edits": [1]}', "bad_edit_type"), ('{"edits": [{"span_id": true, "replace": "x"}]}', "bad_span_id"),
    ('{"edits": [{"span_id": 9, "replace": "x"}]}', "span_out_of_range"), ('{"edits": [{"span_id": 0, "replace": 3}]}', "bad_replace"), ('{"edits": [{"span_id": 0, "replace": "a"}, {"span_id": 0, "replace": "b"}]}', "duplicate_span"),
    ('{"edits": [{"span_id": 0, "replace": "a"}, {"span_id": 1, "replace": "b"}]}', "rewrite_disguised_as_edit"), ('{"edits": [{"span_id": 0, "replace": "Read it."}]}', "no_op"), ('{"edits": [{"span_id": 0, "replace": "%s"}]}' % ("long " * 80), "excessive_growth"),
    ('```json\n{"analysis": "a", "edits": [{"span_id": 1, "replace": "Be brief."}]}\n```', None),
])
def test_contract(spark, reply, violation):
    prompt = "Read it. Answer now.\n\nExamples:\nInput: a. b"
    got = one(spark, contract.apply_contract(F.lit(prompt), F.lit(reply)))
    assert got["violation"] == violation and got["ok"] == (violation is None)
    if violation is None:
        assert got["text"] == "Read it. Be brief.\n\nExamples:\nInput: a. b" and got["edits_applied"] == 1


def test_text_functions(spark):
    assert one(spark, X.elide(F.lit("abcdef"), 4)) == "abcd\n[… 2 characters omitted …]\n"
    assert one(spark, X.normalised(F.lit("  A  B\n"))) == "a b"
    assert one(spark, X.model_slug(F.lit("org/Model:4B"))) == "model-4b"
    assert one(spark, X.midpoint_crossover(F.lit("A. B. C. D."), F.lit("E. F."))) == "A. B. F."
    assert one(spark, X.with_examples(F.lit("Do.\n\nExamples:\nold"), F.array(F.lit("new")))) == "Do.\n\nExamples:\nnew"
    assert one(spark, X.validity(F.lit("Sure, here"))) == "preamble" and one(spark, X.validity(F.lit(None).cast("string"))) == "empty"
    assert contract.fields("ROLE: a\nmore\nTASK: b") == {"ROLE": "a\nmore", "TASK": "b"}


@pytest.mark.parametrize("a,b,same", [
    (r"\frac{x^2-1}{x-1}", "x+1", True), (r"\sin^2 x + \cos^2 x", "1", True), ("2x(x+1)", "2x^2+2x", True), (r"\sqrt[3]{8}", "2", True), (r"\frac12", "0.5", True), ("(a+b)^2", "a^2+2ab+b^2", True), ("x+1", "x-1", False),
    ("e^{i\\pi}", "-1", True), (r"\ln(x^2)", r"2\ln x", True), ("y = 2x", "2y - 4x = 0", True), ("y=2x", "y=3x", False), ("x_1 x_2", "x_2x_1", True), (r"\left(1+\frac{1}{2}\right)\cdot 2", "3", True), ("5!", "120", True), ("x^{-1}", r"\frac{1}{x}", True),
    ("-2^2", "-4", True), ("2^3^2", "512", True), ("ab^2", "a b b", True), (r"|{-3}|", "3", True), ("1/0", "1/0", False), ("x +", "x", False), ("", "0", False), (None, "1", False), (r"\log_2 8", "3", True), (r"\frac{\sqrt{2}}{2}", r"\frac{1}{\sqrt{2}}", True),
    ("9**999999", "1", False), ("{" * 3000, "1", False), (r"12\%", "12", False), (r"\sin 2x", r"2\sin x\cos x", True), ("x", "y", False), (r"\alpha\beta", r"\beta \alpha", True), ("10^{200}", "10^{201}", False),
])
def test_identity_of_expressions(a, b, same):
    assert algebra.equivalent(a, b) is same and algebra.equivalent(b, a) is same


def test_digits_at_the_end_take_linear_time(spark):
    long = "1" * 100_000
    rows = [(long + "x", "7"), (long + " 7", "7"), ("a 0012 　", "12"), ("x12", "012"), ("7", None), (None, "7"), ("\\boxed{7}", "7"), ("9" * 50, "9999"), ("٧", "7")]
    df = spark.createDataFrame(rows, "p string, t string").coalesce(1).cache()
    df.count()
    begun = time.time()
    assert [r["s"] for r in df.select(C.score_math(F.col("p"), F.col("t")).alias("s")).collect()] == [0, 1, 1, 1, 0, 0, 0, 1, 0]
    assert time.time() - begun < 5
    assert [r["s"] for r in df.select(C.score_math(F.col("p"), F.col("t"), strict=False).alias("s")).collect()][6] == 1


def test_boxes_found_at_once_equal_those_of_the_fold(spark):
    texts = ["\\boxed{}", "\\boxed{ a } b", "x} \\boxed{a{b}c}{", "\\boxed{a \\boxed{ b } c}", "\\boxed{a \\boxed{ b c}", "\\boxed{{{d}}}", "\\boxed{" + "{a}b" * 60 + "}", "\\boxed{1} \\boxed{2", "\\boxed{\n\\}", "boxed{1}", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", C.boxed(F.col("t")).alias("x"), X.let(F.col("t"), C._boxed).alias("y")).sort("i").collect()
    assert [r["x"] for r in rows] == [r["y"] for r in rows] == ["", "a", "a{b}c", "b", "b c", "{{d}}", "{a}b" * 60, "1", "\\", None, None]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scores_by_type_are_compiled_and_not_exploded(spark):
    plan = _plan(source_queries.QUERIES["score_by_type"](spark, FOLDER))
    assert "Generate" not in plan and " IN (" not in plan and "transform(array(" not in plan


@pytest.mark.parametrize("name", ["score_math", "score_auto"])
def test_replies_are_made_once_and_values_kept_by_folds(spark, name):
    plan = _plan(scoring_queries.QUERIES[name](spark, FOLDER))
    assert plan.count("AS p#") == 1 and " IN (" not in plan and "transform(array(" not in plan


def test_few_digits_need_no_lambda(spark):
    df = spark.createDataFrame([("so 025", "25"), ("so 25", "025"), ("25 ", "0025"), ("x", "00"), ("x0", "00"), ("125", "025"), (None, "25")], "p string, t string")
    at_end = df.select(C._score_digits(F.col("p"), F.col("t"), True).alias("s"))
    assert "lambda" not in _plan(at_end) and [r["s"] for r in at_end.collect()] == [1, 1, 1, 0, 1, 0, 0]


def test_texts_with_plain_ends_are_left_and_values_made_once(spark):
    texts = ["", " ", "a", " a", "a ", "\ta\n", "a\x00", "\x7fa", "a　", " a", "é", "aé", "~", "!~", "\x1fa", "a\x85", "\U0001f600 ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r["i"] for r in df.where(~X.bare(F.col("t")).eqNullSafe(X.strip(F.col("t")))).collect()] == []
    pairs = [("\\boxed{ } The answer is x+1", "X + 1", 1), ("\\boxed{$ a \\, b$ + K}", "ab", 1), ("\\boxed{a+c}", "a + C", 1), ("\\boxed{\\left(a\\right)}", "(a)", 1), ("\\boxed{a+b}", "a", 0), ("= 2.50", "2.5", 1), ("see #### 2.5 or so", "2.5", 1), ('{"answer": " q "}', "Q", 1), ("x", None, 0), (None, "x", 0)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(pairs)], "i int, p string, t string")
    assert [r["s"] for r in df.select("i", C.score_math(F.col("p"), F.col("t")).alias("s")).sort("i").collect()] == [s for _, _, s in pairs]
    box = _plan(df.select(X.let(F.col("p"), C._reasoned_answer).alias("x")))
    assert box.count("substring_index") == 1
