"""Failing cases as text that shows what was asked, what was expected and what came, each cut with a note of what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import top_k
from .contract import json_kind
from .text import elide, let, strip

# Characters shown of each part, and how many assertions or cases stand for a code target.
INPUT_CHARACTERS, EXPECTED_CHARACTERS, REPLY_CHARACTERS = 900, 400, 900
MOST_ASSERTIONS = 4
MOST_FAILURES = 5


def _quoted(value: Column) -> Column:
    """A variant as Python shows it: strings in quotes, with escapes."""
    text = F.coalesce(value.cast("string"), F.lit("None"))
    escaped = text
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    in_single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    quoted = F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(in_single)
    return F.when(value.isNull(), F.lit("''")).when(json_kind(value) == "STRING", quoted).otherwise(text)


def expected(target: Column, characters: int = EXPECTED_CHARACTERS) -> Column:
    """A stored target as a specification: cases or assertions of a code target, any other as it is."""
    at = lambda m, path, kind: F.try_variant_get(m, path, kind)
    has = lambda m, key: json_kind(at(m, f"$.{key}", "variant")) != ""
    case = lambda c: F.concat(F.lit("input "), _quoted(at(c, "$.input", "variant")), F.lit(" -> "), _quoted(at(c, "$.output", "variant")))

    def cases(m: Column) -> Column:
        first = F.filter(F.slice(F.coalesce(at(m, "$.test_cases", "array<variant>"), F.array().cast("array<variant>")), 1, MOST_ASSERTIONS), lambda c: json_kind(c) == "OBJECT")
        body = F.when(F.size(first) > 0, F.array_join(F.transform(first, case), "\n")).otherwise(F.lit("(test cases unavailable)"))
        return F.concat(F.lit("the function must satisfy:\n"), body)

    def assertions(m: Column) -> Column:
        name = F.coalesce(at(m, "$.entry_point", "string"), F.lit(""))
        head = F.when(name != "", F.concat(F.lit("a function named `"), name, F.lit("` that satisfies:\n"))).otherwise(F.lit("a function that satisfies:\n"))
        lines = F.filter(F.transform(F.split(F.coalesce(at(m, "$.test", "string"), F.lit("")), "\r\n|\n|\r"), strip), lambda x: F.startswith(x, F.lit("assert")))
        return F.concat(head, F.when(F.size(lines) > 0, F.array_join(F.slice(lines, 1, MOST_ASSERTIONS), "\n")).otherwise(F.lit("(assertions unavailable)")))

    told = lambda m: F.when(has(m, "test_cases"), cases(m)).when(has(m, "test") | has(m, "entry_point"), assertions(m))
    return elide(F.coalesce(let(F.try_parse_json(target), told), target), characters)


def failure(sample: Column, target: Column, reply: Column, label: str = "Got") -> Column:
    """One failing case. Replies are cut at their head: code repeats what it was given before it differs."""
    parts = (F.lit("- Input: "), elide(sample, INPUT_CHARACTERS), F.lit("\n  Expected: "), expected(target), F.lit(f"\n  {label}: "), elide(reply, REPLY_CHARACTERS, "tail"))
    return F.concat(*parts)


def failures_shown(failed: DataFrame, by: Sequence[str], seq: str, sample: str = "input", target: str = "target", reply: str = "reply", most: int = MOST_FAILURES) -> DataFrame:
    """``by, failures``: the first ``most`` failing cases of each group as one text."""
    few = top_k(failed, most, [F.col(seq)], by)
    block = F.struct(F.col(seq).alias("seq"), failure(F.col(sample), F.col(target), F.col(reply)).alias("block"))
    return few.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"]), "\n").alias("failures"))
