"""Techniques that make new prompts of a population, as rows of a table and one plan for a generation.

A technique is a row: up to two requests as templates, and how the last reply becomes a prompt. A generation
joins what was drawn (technique, first and second record) to what the templates name, renders the requests in columns,
asks in one stage a request, and makes the texts. Any number of searches go through one plan: a search is a key
(``by``), and no step holds more of one than some leaders, the last records and a few samples.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.failures import failures_shown
from ..operators.rank import top_k
from .client import Client, generate

#: Leaders and last records of a search that requests may show, and of how many leaders the first and the second are drawn.
LEADERS, LAST, BEST, FIRST_OF, SECOND_OF = 8, 5, 5, 3, 4
#: Samples of a search that requests may show.
SHOTS = 5
SHOWN_CHARACTERS = 300


@dataclasses.dataclass(frozen=True)
class Technique:
    """``request`` may name ``{told}``, the reply to ``before``. ``take``: the reply is the ``whole`` prompt, is put at the
    ``end``, ``after`` a drawn sentence or ``instead`` of it. Without a request the text is made in columns."""

    request: str = ""
    before: str = ""
    take: str = "whole"


_OLD = "\nInstruction: {text}"


def _rewrite(what: str, shown: str = "") -> Technique:
    return Technique(f"Rewrite this instruction {what} Reply with the new instruction alone.{shown}{_OLD}")


# The voices that an expert may speak in, kinds of change to one field, and a prompt's optional sections.
VOICES = ("a technical writer who wastes no word", "a teacher with patience for beginners", "a logician who leaves nothing open", "a solver of problems with unusual ideas")
CHANGES = ("add to it", "change it", "leave it out")
SECTIONS = ("reasoning_guide, which says how to work through the task in steps", "error_prevention, which names the mistakes to avoid")

_FAILED, _DONE = "\nCases it fails:\n{failures}", "\nCases it solves:\n{solved}"
_FIELDS = "Name what this instruction says for each of preamble, task_definition, output_spec, reasoning_guide and error_prevention, a line each, and leave a line empty where it says nothing." + _OLD

TECHNIQUES: dict[str, Technique] = {
    "semantic_var": _rewrite("in other words that mean the same."),
    "local_edit": _rewrite("with one or two sentences made clearer or more exact, and nothing else changed."),
    "expert_refine": _rewrite("as {voice} would put it: the same intent, clearer and more exact."),
    "failure_guided": _rewrite("so that the cases below would be answered rightly.", _FAILED),
    "structured_failure_guided": _rewrite("in two steps: find the one cause behind the cases below, then mend that cause.", _FAILED),
    "reflective_mutation": Technique(
        f"Rewrite this instruction to mend what the reflection finds. Keep what works.\nReflection: {{told}}{_OLD}",
        f"Reflect in two to four sentences: which rules, special cases or details of the answer's form does this instruction not tell?{_FAILED}{_DONE}{_OLD}",
    ),
    "lamarckian": Technique("Write the instruction under which these inputs give these outputs. Reply with the instruction alone.\n{pairs}\nInstruction:"),
    "crossover": _rewrite("so that it joins the best of it and of the second one.", "\nSecond: {second}"),
    "trajectory": _rewrite("so that the new one would score above all of these, which stand in rising order.", "\n{leaders}"),
    "trajectory_momentum": _rewrite("one step further: say for yourself what changed from each of these to the next and which changes paid, then go on that way.", "\n{last}"),
    "eda": _rewrite("as a new member of the family that these belong to, equal to none.", "\n{best}"),
    "role_assignment": _rewrite("to begin with a role that suits the task."),
    "expert_persona": _rewrite("as an expert of its subject would write it, and let the expert be heard."),
    "concise_optimization": _rewrite("as briefly as can be without losing what matters."),
    "task_decomposition": _rewrite("as a short list of steps to follow."),
    "structural_variation": _rewrite("in another order or form, prose as steps or steps as prose, with the same meaning."),
    "constraint_addition": _rewrite("with one more rule that helps."),
    "instruction_expansion": _rewrite("with more detail where detail helps."),
    "creative_backstory": _rewrite("with a short scene in front that gives a reason for the task."),
    "etgpo_taxonomy": Technique(
        f"Rewrite this instruction against the most frequent kind of error, told first, and do not hurt the rest.\nKinds: {{told}}{_OLD}",
        f"Sort these cases into kinds of error, the most frequent first, each with its count and a short name.{_FAILED}{_OLD}",
    ),
    "strago_dual": Technique(
        f"Rewrite this instruction by the strategy told, and lose nothing that works.\nStrategy: {{told}}{_OLD}",
        f"Say what of this instruction makes the solved cases succeed, what makes the others fail, and in which steps to mend it.{_FAILED}{_DONE}{_OLD}",
    ),
    "multi_aspect_critique": Technique(
        f"Rewrite this instruction to answer each point of the critique.\nCritique: {{told}}{_OLD}",
        f"Criticise this instruction for clarity, completeness, reasoning and form of the answer, each by itself and in one sentence.{_FAILED}{_OLD}",
    ),
    "autohint": Technique(f"Tell in one sentence, as a hint to add, what would have helped in all of these cases. Reply with the hint alone.{_FAILED}{_OLD}", take="end"),
    "ampo_branch": Technique(
        f"Write one sentence of the form 'If ..., then ...' that handles this kind of case and can be added. Reply with it alone.\nKind: {{told}}{_OLD}",
        f"Name in a few words the kind of case that most of these belong to.{_FAILED}{_OLD}", take="end",
    ),
    "grips_add": Technique(f"Write one sentence that makes this instruction clearer after '{{sentence}}'. Reply with it alone.{_OLD}", take="after"),
    "grips_paraphrase": Technique("Say this sentence in other words. Reply with it alone.\nInstruction: {sentence}", take="instead"),
    "facet_edit": Technique(f"Rewrite this instruction with one field alone changed: take {{field}} and {{change}}.\nFields: {{told}}{_OLD}", _FIELDS),
    "decompose_recompose": Technique(f"Rewrite this instruction from its fields: leave out what is empty or said twice, and supply task_definition and output_spec where they lack.\nFields: {{told}}{_OLD}", _FIELDS),
    "facet_enrich": _rewrite("with its own words kept and at most two sentences added: the section {section}."),
    **{free: Technique() for free in ("few_shot", "few_shot_fixed", "instruction_only", "format_constraint", "midpoint_crossover", "grips_delete", "grips_swap")},
}

_PAIRED = ("midpoint_crossover",)
_NAME = re.compile(r"\{([a-z]+)\}")


def dimension(spark: SparkSession) -> DataFrame:
    """``technique, before, request, take, paired``: templates split at their names, which stand at odd places."""
    rows = [(n, _NAME.split(t.before) if t.before else None, _NAME.split(t.request) if t.request else None, t.take, n in _PAIRED) for n, t in TECHNIQUES.items()]
    return spark.createDataFrame(rows, "technique string, before array<string>, request array<string>, take string, paired boolean")


def _draw(*parts: Column) -> Column:
    """A number below 2^32 of a hash of the parts, equal on every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def _pick(options: Sequence[str], draw: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(draw, F.lit(len(options))).cast("int"))


def members(population: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, leaders, last``: the leaders by score and the last records by id of each search, as arrays of
    ``record_id, text, score``. Rows without score or text take no part."""
    rows = population.where(F.col("score").isNotNull() & (F.coalesce("text", F.lit("")) != "")).select(*by, "record_id", "text", "score")
    first = top_k(rows, LEADERS, [F.col("score").desc(), F.col("record_id")], by, into="place")
    late = top_k(rows, LAST, [F.col("record_id").desc()], by, into="place")
    both = first.withColumn("led", F.lit(True)).unionByName(late.withColumn("led", F.lit(False)))
    kept = lambda led: F.array_sort(F.collect_list(F.when(F.col("led") == led, F.struct("place", "record_id", "text", "score"))))
    return both.groupBy(*by).agg(kept(True).alias("leaders"), kept(False).alias("last"))


def drawn(pools: DataFrame, techniques: Column, by: Sequence[str], seed: int) -> DataFrame:
    """``by, technique, record_id, second_id, draw, text, second``: each technique once for each search, with a first record of the leading
    few and a second one that is another, where there is one."""
    rows = pools.withColumn("technique", F.explode(techniques))
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    rows = rows.withColumn("draw", _draw(*key, F.col("technique"), F.lit(str(seed))))
    n = F.size("leaders")
    a = F.pmod("draw", F.least(n, F.lit(FIRST_OF)))
    most = F.least(n, F.lit(SECOND_OF))
    b = F.pmod(a + 1 + F.pmod(F.floor(F.col("draw") / 64), F.greatest(most - 1, F.lit(1))), most)
    at = lambda i: F.get("leaders", i.cast("int"))
    other = F.when(n >= 2, at(b))
    return rows.select(*by, "technique", at(a)["record_id"].alias("record_id"), other["record_id"].alias("second_id"), "draw", at(a)["text"].alias("text"), other["text"].alias("second"))


def shots(samples: DataFrame, by: Sequence[str], seed: int, task_type: Column | None = None, most: int = SHOTS) -> DataFrame:
    """``by, shots, answers``: a few samples of each search (``sample_id, input, target``) as demonstrations and their targets, in an order by hash.
    Samples without an input or a target are none."""
    order = _draw(F.col("sample_id").cast("string"), F.lit(str(seed)))
    few = top_k(samples.where("input is not null and target is not null").withColumn("_order", order), most, [F.col("_order"), F.col("sample_id")], by)
    shown = X.exemplar(task_type if task_type is not None else F.lit("auto"), F.col("input"), F.col("target"))
    rows = F.array_sort(F.collect_list(F.struct("_order", "sample_id", shown.alias("shot"), F.col("target").alias("answer"))))
    return few.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.col("_rows.shot").alias("shots"), F.col("_rows.answer").alias("answers"))


def _listed(rows: Column) -> Column:
    """Prompts with their scores, a line each; null where there are fewer than two."""
    line = lambda r: F.concat(F.lit("- Score "), F.format_string("%.3f", r["score"]), F.lit(": "), F.left(r["text"], F.lit(SHOWN_CHARACTERS)))
    return F.when(F.size(rows) > 1, F.array_join(F.transform(F.reverse(rows), line), "\n"))


def series() -> dict[str, Column]:
    """The series that requests show, of the columns of ``members``: the leaders and the best in rising order, the last in order."""
    return {"leaders": _listed(F.col("leaders")), "last": _listed(F.col("last")), "best": _listed(F.slice("leaders", 1, BEST))}


def _filled(template: Column, fields: Column) -> Column:
    """A template's parts with values for its names but ``told``, whose place is null; null where another one has no value."""
    parts = F.transform(template, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.try_element_at(fields, p)))
    lacks = F.exists(template, lambda p: F.map_contains_key(fields, p) & F.try_element_at(fields, p).isNull())
    return F.when(~lacks, parts)


def planned(picks: DataFrame, records: DataFrame | None, pools: DataFrame, outcomes: DataFrame, samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``picks`` (``by, technique, record_id, second_id, draw``) with their first request: ``before`` and ``request`` as texts
    (``request`` is null while ``before`` is unanswered), ``made`` where no call is needed, ``skipped`` where something that the technique shows is lacking.

    ``records``: ``record_id, text``; none where picks bring ``text`` and ``second`` along, as ``drawn`` does, so that no population moves. ``pools``: of ``members``. ``outcomes``: ``record_id, seq, input, target, reply, correct``. ``samples``: of ``shots``. A pick of
    an unknown technique or record is skipped.
    """
    of = picks.select("record_id").where("record_id is not null").distinct()
    judged = outcomes.join(of, "record_id", "left_semi")
    failed = failures_shown(judged.where("correct = 0"), ["record_id"], "seq")
    solved = failures_shown(judged.where("correct = 1"), ["record_id"], "seq", most=2).withColumnRenamed("failures", "solved")
    met = picks.join(F.broadcast(dimension(picks.sparkSession)), "technique", "left")
    if records is not None:
        met = met.join(records.select("record_id", "text"), "record_id", "left").join(records.select(F.col("record_id").alias("second_id"), F.col("text").alias("second")), "second_id", "left")
    met = met.join(failed, "record_id", "left").join(solved, "record_id", "left")
    met = met.join(pools, list(by), "left").join(samples, list(by), "left") if by else met.join(F.broadcast(pools)).join(F.broadcast(samples), how="left")
    text, draw = F.col("text"), F.col("draw")
    split = X.sentences(text)
    low = F.lower(text)
    fields = {
        "text": text, "second": F.col("second"), "failures": F.col("failures"), "solved": F.coalesce("solved", F.lit("none")), "pairs": F.when(F.size("shots") > 0, F.array_join("shots", "\n")),
        **series(), "voice": _pick(VOICES, draw),
        "sentence": X.let(split, lambda s: F.when(F.size(s) > 0, F.get(s, F.pmod(draw, F.greatest(F.size(s), F.lit(1))).cast("int")))),
        "field": _pick(X.FIELDS, draw), "change": _pick(CHANGES, F.floor(draw / 8)),
        "section": F.when(~F.contains(low, F.lit("reasoning")), SECTIONS[0]).when(~F.contains(low, F.lit("error")), SECTIONS[1]),
    }
    named = F.create_map(*(x for n, v in fields.items() for x in (F.lit(n), v)))
    filled = X.let(named, lambda m: F.struct(F.array_join(_filled(F.col("before"), m), "").alias("before"), _filled(F.col("request"), m).alias("parts"), m["sentence"].alias("sentence")))
    met = met.withColumns({"made": _made(), "two": F.col("before").isNotNull(), "filled": filled})
    met = met.withColumns({"before": F.col("filled.before"), "parts": F.col("filled.parts"), "sentence": F.col("filled.sentence")})
    met = met.withColumn("request", F.when(~F.col("two"), F.array_join("parts", "")))
    met = met.withColumn("skipped", F.when(F.col("two"), F.col("before").isNull() | F.col("parts").isNull()).otherwise(F.coalesce("request", "made").isNull()))
    met = met.withColumn("before", F.when(~F.col("skipped"), F.col("before")))
    return met.select(*(c for c in picks.columns if c not in ("text", "second")), "skipped", "text", "sentence", "take", "two", "before", "parts", "request", "made")


def _made() -> Column:
    """The texts of techniques that need no call; null where nothing comes of them."""
    t, draw, cases, answers = F.col("text"), F.col("draw"), F.col("shots"), F.col("answers")
    from_place = F.pmod(draw, F.greatest(F.size(cases), F.lit(1))).cast("int") + 1
    some = F.slice(F.concat(cases, cases), from_place, F.least(F.pmod(F.floor(draw / 16), F.lit(3)).cast("int") + 1, F.greatest(F.size(cases), F.lit(0))))
    bare = F.substring_index(t, X.EXAMPLES_HEAD, 1)
    made = {
        "few_shot": F.when(F.size(cases) > 0, X.with_examples(t, some)), "few_shot_fixed": F.when(F.size(cases) > 0, X.with_examples(t, F.slice(cases, 1, 3))),
        "instruction_only": F.when((bare != t) & (bare != ""), bare), "format_constraint": F.when(F.size(answers) > 0, X.format_constraint(t, answers)),
        "midpoint_crossover": F.when(F.col("second").isNotNull(), X.midpoint_crossover(t, F.col("second"))),
        "grips_delete": X.without_sentence(t, draw), "grips_swap": X.swapped_sentences(t, draw, F.floor(draw / 64)),
    }
    out = F.lit(None).cast("string")
    for name, text in made.items():
        out = F.when(F.col("technique") == name, text).otherwise(out)
    return out


def _taken(reply: Column) -> Column:
    """What a reply makes of the prompt, by ``take``."""
    text, sentence = F.col("text"), F.col("sentence")
    start = F.instr(text, sentence)
    end = start + F.length(sentence)
    head, tail = F.left(text, start - 1), F.substr(text, end)
    cases = F.when(F.col("take") == "end", F.concat(X.strip(text), F.lit(" "), reply)).when(F.col("take") == "after", F.concat(head, sentence, F.lit(" "), reply, tail))
    return F.when(reply != "", cases.when(F.col("take") == "instead", F.concat(head, reply, tail)).otherwise(reply))


def offspring(plan: DataFrame, make: Callable[[], Client]) -> DataFrame:
    """The rows of ``planned`` with ``child`` (null where nothing came) and what the calls used, as one plan: a stage for the requests that
    come before, a stage for those that make the text. Rows without a request pass both unasked."""
    used = ("calls", "input_words", "output_words")
    first = generate(plan, make, "before", "told").withColumnsRenamed({c: f"first_{c}" for c in used})
    told = X.strip(F.coalesce("told", F.lit("")))
    asked = F.array_join(F.transform("parts", lambda p: F.coalesce(p, told)), "")
    first = first.withColumn("request", F.when(F.col("two") & (told != ""), asked).otherwise(F.col("request")))
    last = generate(first.drop("told"), make, "request", "reply")
    child = F.coalesce(F.col("made"), _taken(X.strip(F.coalesce("reply", F.lit("")))))
    inner = ("text", "sentence", "take", "two", "before", "parts", "request", "made")
    sums = ((F.col(c) + F.col(f"first_{c}")).alias(c) for c in used)
    return last.select(*(c for c in plan.columns if c not in inner), F.when(child != "", child).alias("child"), *sums)
