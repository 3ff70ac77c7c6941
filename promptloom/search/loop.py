"""The search loop: generations on the driver, evaluation and scoring in the plan.

A population is some tens of records and is collected; outcomes stay distributed, as one fact table
that each generation adds to and that is cut once a generation, so that plans do not grow.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import random
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.scoring import score
from ..operators import evaluate as E
from ..operators import select as S
from ..plans.budget import Budget
from ..sources.storage import cut
from . import techniques as T
from .client import Client, generate
from .methods import Method

# Who is looked at for the last choice, and how often the leaders are asked what they were not asked yet.
FINALISTS = 6
FINAL_ROUNDS = 3
FRONT_SHARE = 0.5

RECORDS = "record_id long, text string, operator string, parent_ids array<long>, generation int"


@dataclasses.dataclass
class Result:
    best_prompt: str
    best_score: float
    test_score: float | None
    records: DataFrame
    outcomes: DataFrame
    snapshots: list[dict]
    stopped: str | None


class Search:
    def __init__(self, spark: SparkSession, samples: DataFrame, make: Callable[[], Client], method: Method, task_type: str = "auto", seed: int = 42, population: int = 5, budget: Budget | None = None, slack: float = 0.1, minibatch: int = 8, patience: int = 5, alpha: float = 0.05):
        self.spark, self.make, self.method, self.task_type = spark, make, method, task_type
        self.random, self.size, self.budget = random.Random(seed), population, budget or Budget()
        self.slack, self.minibatch, self.patience, self.alpha = slack, minibatch, patience, alpha
        dev = samples.where("split = 'dev'")
        place = F.sha2(F.concat(F.col("sample_id").cast("string"), F.lit("|holdout")), 256)
        if method.holdout:  # some three rows of ten are kept for the last choice
            dev = dev.withColumn("split", F.when(F.conv(F.substring(place, 1, 4), 16, 10).cast("int") % 10 < 3, "holdout").otherwise("dev"))
        self.samples = cut(dev.unionByName(samples.where("split <> 'dev'")).select("sample_id", "split", "input", "target"))
        self.records: list[dict] = []
        self.scores: dict[int, float] = {}
        self.pulls: list[tuple[str, float]] = []
        self.outcomes: DataFrame | None = None
        #: Rounds of a raced evaluation: parts of dev of about a minibatch each, by a hash of the sample.
        self.rounds = max(1, min(8, self.samples.where("split = 'dev'").count() // minibatch)) if method.racing else 1
        self.evaluated, self.raced_out, self.not_admitted = 0, set(), set()
        self.pool: list[dict] = []
        self.covering: dict[int, int] = {}

    def evaluate(self, records: Sequence[dict], split: str, only: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
        """``record_id, sample_id, reply, correct``: each record on each sample of a split, but for pairs that are known.
        The prompts are the small side."""
        prompts = self.spark.createDataFrame([(r["record_id"], r["text"]) for r in records], "record_id long, text string")
        rows = self.samples.where(F.col("split") == split)
        rows = rows.join(only, "sample_id", "left_semi") if only is not None else rows
        asked = rows.crossJoin(F.broadcast(prompts)).select("record_id", "sample_id", "input", "target", X.evaluation_prompt(F.col("text"), F.col("input")).alias("prompt"))
        asked = asked.join(known, ["record_id", "sample_id"], "left_anti") if known is not None else asked
        replied = generate(asked, self.make)
        return cut(replied.select("record_id", "sample_id", "reply", "calls", "input_words", "output_words", score(self.task_type, F.col("reply"), F.col("target")).alias("correct")))

    def _spend(self, outcomes: DataFrame) -> None:
        u = outcomes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "input_words", "output_words"))).first()
        self.budget.spend(u["calls"], u["input_words"], u["output_words"])

    def _add(self, text: str, operator: str, parents: Sequence[int], generation: int) -> dict | None:
        text = (text or "").strip()
        if not text or any(r["text"].strip() == text for r in self.records):
            return None
        self.records.append({"record_id": len(self.records), "text": text, "operator": operator, "parent_ids": list(parents), "generation": generation})
        return self.records[-1]

    def _measure(self, fresh: Sequence[dict], baseline: float) -> None:
        """Evaluate new records: a gate on a minibatch first, then all of dev for those that pass."""
        if not fresh:
            return
        passed = list(fresh)
        if self.method.gate and self.outcomes is not None:
            few = self.samples.where("split = 'dev'").orderBy(F.sha2(F.concat(F.col("sample_id").cast("string"), F.lit(f"|{fresh[0]['generation']}")), 256)).limit(self.minibatch).select("sample_id")
            small = self.evaluate(fresh, "dev", few)
            self._spend(small)
            gate = {r["record_id"]: r["score"] for r in E.accuracy(small, ["record_id"]).collect()}
            passed = [r for r in fresh if gate.get(r["record_id"], 0.0) + self.slack >= baseline]
        if not passed:
            return
        full = self._raced(passed, baseline) if self.method.racing else self.evaluate(passed, "dev")
        if not self.method.racing:
            self._spend(full)
        self.outcomes = full if self.outcomes is None else cut(self.outcomes.unionByName(full))
        found = {r["record_id"]: r for r in E.accuracy(full, ["record_id"]).collect()}
        self.evaluated += sum(r["num_total"] for r in found.values())
        self.scores |= {i: r["score"] for i, r in found.items()}
        if self.method.retention:
            self._admit([r for r in passed if r["parent_ids"] and r["record_id"] in found])

    def _raced(self, records: Sequence[dict], baseline: float) -> DataFrame:
        """Outcomes of the records on dev, part by part; who is beaten for sure after a part is asked no more."""
        part = F.pmod(F.xxhash64(F.col("sample_id"), F.lit("race")), F.lit(self.rounds))
        dev = self.samples.where("split = 'dev'").select("sample_id", part.alias("part"))
        alive, seen, made = list(records), {}, []
        for i in range(self.rounds):
            made.append(self.evaluate(alive, "dev", dev.where(F.col("part") == i).select("sample_id")))
            self._spend(made[-1])
            for r in E.accuracy(made[-1], ["record_id"]).collect():
                c, n = seen.get(r["record_id"], (0, 0))
                seen[r["record_id"]] = c + r["num_correct"], n + r["num_total"]
            if i == self.rounds - 1:
                break
            beaten = {k for k, (c, n) in seen.items() if n and c / n + math.sqrt(math.log(2 / self.alpha) / (2 * n)) < baseline}
            self.raced_out |= beaten
            alive = [r for r in alive if r["record_id"] not in beaten]
            if not alive:
                break
        return cut(functools.reduce(DataFrame.unionByName, made))

    def _admit(self, children: Sequence[dict]) -> None:
        """Leave out children that gain nothing and lose what their parents solved; the best of them stays if none else does."""
        if not children or self.outcomes is None:
            return
        edges = self.spark.createDataFrame([(r["record_id"], p) for r in children for p in r["parent_ids"]], "child_id long, parent_id long")
        known = self.spark.createDataFrame(sorted(self.scores.items()), "record_id long, score double")
        judged = {r["child_id"]: r["admitted"] for r in E.guarded_acceptance(E.retention(self.outcomes, edges), known).collect()}
        rejected = [r["record_id"] for r in children if not judged.get(r["record_id"], True)]
        if len(rejected) == len(children):
            rejected.remove(max(rejected, key=lambda i: (self.scores[i], -i)))
        self.not_admitted |= set(rejected)
        for i in rejected:
            del self.scores[i]

    def _elite(self) -> list[dict]:
        return [self.records[i] for i in sorted(self.scores, key=lambda i: (-self.scores[i], i))]

    def _covering(self, records: Sequence[dict]) -> dict[int, int]:
        """How many samples each record on the front over samples is best at."""
        if self.outcomes is None or len(records) < 2:
            return {}
        rows = self.outcomes.where(F.col("record_id").isin([r["record_id"] for r in records]))
        return {r["record_id"]: r["coverage"] for r in E.instance_coverage(rows).collect()}

    def _pool(self) -> list[dict]:
        """The parents of a generation. By tournament: the best, then winners of bouts of three without replacement; every
        other bout has a record of the front in it."""
        ranked = self._elite()
        if self.method.choose != "tournament" or len(ranked) < 2:
            return ranked[: self.size]
        covering, kept, rest = self._covering(ranked), ranked[:1], ranked[1:]
        while rest and len(kept) < self.size:
            bout = self.random.sample(rest, min(3, len(rest)))
            front = [r for r in rest if r["record_id"] in covering]
            if front and self.random.random() < FRONT_SHARE:
                bout += self.random.choices(front, [covering[r["record_id"]] for r in front])
            kept.append(max(bout, key=lambda r: (self.scores[r["record_id"]], -r["record_id"])))
            rest.remove(kept[-1])
        return kept

    def _parent(self) -> dict:
        if self.covering:
            ids = sorted(self.covering)
            return self.records[self.random.choices(ids, [self.covering[i] for i in ids])[0]]
        most = len(self.pool) if self.method.choose == "tournament" else min(4, len(self.pool))
        return self.pool[self.random.randrange(most)]

    def _operators(self, generation: int) -> list[str]:
        if self.method.choose not in ("bandit", "tuned") or not self.pulls:
            return list(self.method.operators)
        pulls = self.spark.createDataFrame(self.pulls, "arm string, reward double")
        arms = self.spark.createDataFrame([(o,) for o in self.method.operators], "arm string")
        known = S.pulls_summary(pulls, arms, "arm", "reward")
        bounds = S.ucb1_tuned(known, generation) if self.method.choose == "tuned" else S.ucb1(known)
        return [r["arm"] for r in S.chosen_arms(bounds, "arm").orderBy("place").collect()]

    def _offspring(self, generation: int) -> list[tuple[str, list[dict]]]:
        """One pull of each operator: what it makes, new records only. One plan makes all texts of a generation."""
        self.pool = self._pool()
        self.covering = self._covering(self.pool) if self.method.choose == "pareto" else {}
        picks = []
        for i, o in enumerate(self._operators(generation)):
            a, b = self._parent(), self._parent()
            picks.append((i, o, a["record_id"], b["record_id"], self.random.randrange(1 << 32)))
        if not picks:
            return []
        df = self.spark.createDataFrame(picks, "i int, technique string, record_id long, second_id long, draw long")
        records = self.spark.createDataFrame([(r["record_id"], r["text"], self.scores.get(r["record_id"])) for r in self.records], "record_id long, text string, score double")
        outcomes = self.outcomes.join(self.samples.select("sample_id", "input", "target"), "sample_id").withColumnRenamed("sample_id", "seq")
        shots = T.shots(self.samples.where("split = 'train'"), [], generation, F.lit(self.task_type))
        made = cut(T.offspring(T.planned(df, records, T.members(records, []), outcomes, shots), self.make))
        self._spend(made)
        children = {r["i"]: r["child"] for r in made.select("i", "child").collect()}
        return [(o, [r] if (r := self._add(children.get(i), o, dict.fromkeys((a, b)), generation)) else []) for i, o, a, b, _ in picks]

    def _finalise(self) -> None:
        """Ask the leaders what is left of dev where they were asked parts only; others may lead then, so more than once."""
        whole = self.samples.where("split = 'dev'").count()
        for _ in range(FINAL_ROUNDS if self.outcomes is not None else 0):
            seen = {r["record_id"]: r["count"] for r in self.outcomes.groupBy("record_id").count().collect()}
            under = [r for r in self._elite()[:FINALISTS] if seen.get(r["record_id"], 0) < whole]
            if not under:
                return
            more = self.evaluate(under, "dev", known=self.outcomes.select("record_id", "sample_id"))
            self._spend(more)
            self.outcomes = cut(self.outcomes.unionByName(more))
            of = self.outcomes.where(F.col("record_id").isin([r["record_id"] for r in under]))
            self.scores |= {r["record_id"]: r["score"] for r in E.accuracy(of, ["record_id"]).collect()}

    def run(self, seeds: Sequence[str]) -> Result:
        for s in seeds:
            self._add(s, "seed", [], 0)
        snapshots, stopped, best, stale = [], None, 0.0, 0
        if self.method.generations or self.method.operators:
            self._measure(list(self.records), 0.0)
            best = max(self.scores.values(), default=0.0)
        for generation in range(1, self.method.generations + 1):
            snapshots.append({"generation": generation - 1, "best_score": best, "population_size": len(self.scores)})
            if stopped := (self.budget.exhausted(search=True) or ("perfect" if best >= 1.0 else "patience" if stale >= self.patience else None)):
                break
            made = self._offspring(generation)
            pool = self._elite()[:4]
            base = sum(self.scores[r["record_id"]] for r in pool) / max(1, len(pool))
            self._measure([r for _, rs in made for r in rs], best)
            for o, rs in made:
                # what was raced out or not admitted is a loss, like what the gate rejects
                gains = [self.scores[r["record_id"]] - base if r["record_id"] in self.scores else -self.slack for r in rs]
                self.pulls.append((o, sum(gains) / len(gains) if gains else 0.0))
            now = max(self.scores.values(), default=0.0)
            stale = 0 if now > best + max(1e-12, self.method.least_gain) else stale + 1
            best = max(best, now)
        if self.method.racing and self.method.holdout:
            self._finalise()
            best = max(self.scores.values(), default=best)
        ranked = self._elite() or self.records
        winner = ranked[0]
        if self.method.holdout and len(ranked) > 1:
            held = self.evaluate(ranked[:FINALISTS], "holdout")
            found = {r["record_id"]: r["score"] for r in E.accuracy(held, ["record_id"]).collect()}
            winner = max(ranked[:FINALISTS], key=lambda r: (found.get(r["record_id"], 0.0), -ranked.index(r)))
        tested = E.accuracy(self.evaluate([winner], "test"), ["record_id"]).first()
        records = self.spark.createDataFrame([(r["record_id"], r["text"], r["operator"], r["parent_ids"], r["generation"]) for r in self.records], RECORDS)
        outcomes = self.outcomes if self.outcomes is not None else self.evaluate([winner], "test").limit(0)
        return Result(winner["text"], best, tested["score"] if tested else None, records, outcomes, snapshots, stopped)
