"""Mixing sources to target weights with soft domain membership, in DataFrame functions only.

A multinomial model of characters, fitted on a bounded labelled table, gives each document a posterior
over the domains. Projected gradient descent then fits a rate of at least ``floor`` for every document
so that the expected domain token totals, the sum of rate x tokens x posterior, meet the targets in
the least-squares sense. A step needs one distributed sum of as many numbers as there are domains; the
rate of a document is a function of its posterior and the list of gradients, so no rates are moved.

Defined results: a null or empty text has no tokens and the prior as its posterior. Repeated rows have
equal rates and equal draws. A domain that no labelled row has cannot be told and gets posterior 0; its
target then stays unmet. An empty table gives no rows. Labelled rows whose domain has no target or is
null are left out. Rows whose key is null are mixed like any other.
"""

from __future__ import annotations

import dataclasses
import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Most labelled documents that a fit reads.
MAX_LABELLED = 4096
#: Characters that the model counts; all others are one more.
ALPHABET = 32
#: A text longer than this weighs as much as one of this length: neighbouring characters do not vote
#: independently, and unbounded they would leave no soft membership.
EFFECTIVE_BYTES = 150
_WORD = r"[^\x20\x09-\x0D]+"


@dataclasses.dataclass(frozen=True)
class DomainModel:
    domains: tuple[str, ...]
    characters: tuple[str, ...]
    #: one row a character, and a last one for all others; log-probabilities by domain
    weights: tuple[tuple[float, ...], ...]
    priors: tuple[float, ...]

    def counts(self, text: Column) -> Column:
        """How many bytes of each character a text has in lower case, and of all together."""
        whole = F.lower(F.coalesce(text, F.lit("")))
        size = F.octet_length(whole)
        return F.array(*((size - F.octet_length(F.replace(whole, F.lit(c), F.lit("")))).cast("double") for c in self.characters), size.cast("double"))

    def posterior(self, counts: Column) -> Column:
        """An array of the domains' posteriors, from a column that holds ``counts``."""
        known = [k for k, p in enumerate(self.priors) if p > 0]
        if not known:
            return F.array(*(F.lit(0.0) for _ in self.domains))
        size = F.element_at(counts, len(self.characters) + 1)

        def score(k: int) -> Column:  # "other" is what the counted characters leave of all
            other = self.weights[-1][k]
            terms = [F.element_at(counts, i + 1) * (self.weights[i][k] - other) for i in range(len(self.characters))]
            total = reduce(lambda a, b: a + b, terms, size * other)
            return F.lit(math.log(self.priors[k])) + total * F.least(F.lit(1.0), EFFECTIVE_BYTES / F.greatest(size, F.lit(1.0)))

        # an array of one array, so that what is used again and again is made once
        scores = F.array(F.array(*(score(k) for k in known)))
        shares = F.transform(scores, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        sums = F.transform(shares, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("sum")))
        normal = F.transform(sums, lambda s: F.transform(s["e"], lambda x: x / s["sum"]))
        place = {k: i for i, k in enumerate(known)}
        if len(known) < len(self.domains):
            normal = F.transform(normal, lambda e: F.array(*(F.element_at(e, place[k] + 1) if k in place else F.lit(0.0) for k in range(len(self.domains)))))
        return normal[0]


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DomainModel:
    """``labelled`` holds ``doc_id, domain``; the documents of at most ``max_labelled`` rows are read."""
    chosen = (
        labelled.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        .select(F.col("doc_id").alias("k"), "domain")
    )
    texts = docs.select(docs[key].alias("d"), docs[text].alias("t"))
    joined = texts.join(F.broadcast(chosen), F.col("d") == F.col("k"))
    letters = joined.select("domain", F.explode(F.split(F.lower(F.coalesce("t", F.lit(""))), "")).alias("c")).where("c <> ''").groupBy("domain", "c").agg(F.sum(F.octet_length("c")).alias("count"))
    rows = letters.collect()  # the characters of at most ``max_labelled`` texts: an alphabet for each domain
    held = {r["domain"]: r["n"] for r in joined.groupBy("domain").agg(F.count_distinct("d").alias("n")).collect()}
    totals = {d: 1.0 for d in domains}
    counts: dict[str, dict[str, int]] = {}
    for r in rows:
        totals[r["domain"]] += r["count"]
        counts.setdefault(r["c"], {})[r["domain"]] = r["count"]
    known = [d for d in domains if held.get(d)]

    def rate(c: str, d: str) -> float:
        return (counts[c].get(d, 0) + 0.5) / totals[d]

    def told(c: str) -> float:  # how much a character's rate differs between domains
        mean = sum(rate(c, d) for d in known) / max(1, len(known))
        return sum(rate(c, d) * math.log(rate(c, d) / mean) for d in known)

    characters = sorted(counts, key=lambda c: (-told(c), c))[:ALPHABET]
    weights = [tuple(math.log(rate(c, d)) for d in domains) for c in characters]
    rest = [max(1e-6, 1 - sum(rate(c, d) for c in characters)) for d in domains]
    n = sum(held.values())
    return DomainModel(tuple(domains), tuple(characters), (*weights, tuple(map(math.log, rest))), tuple(held.get(d, 0) / max(1, n) for d in domains))


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def _stepped(rate: Column, posterior: Column, gradients: list[list[float]], floor: float) -> Column:
    """The rate after further projected steps."""
    for g in gradients:
        move = reduce(lambda a, b: a + b, (F.element_at(posterior, k + 1) * x for k, x in enumerate(g)))
        rate = F.greatest(F.lit(float(floor)), rate - move)
    return rate


@dataclasses.dataclass(frozen=True)
class Mix:
    """A fitted mixture: what a document needs to know for its rate."""

    model: DomainModel
    gradients: tuple[tuple[float, ...], ...]
    floor: float
    available: tuple[float, ...]
    targets: tuple[float, ...]
    reached: tuple[float, ...]

    def missed(self, tolerance: float = 1e-3) -> list[str]:
        """Domains whose expected total is off its target by more than a share of it: without tokens, or held by the floor."""
        return [d for d, r, t in zip(self.model.domains, self.reached, self.targets) if abs(r - t) > tolerance * (t or sum(self.targets))]

    def rate(self, posterior: Column) -> Column:
        history = F.array(*(F.array(*map(F.lit, map(float, g))) for g in self.gradients))
        if not self.gradients:
            return F.greatest(F.lit(1.0), F.lit(float(self.floor)))
        dot = lambda g: reduce(lambda a, b: a + b, (F.element_at(posterior, k + 1) * F.element_at(g, k + 1) for k in range(len(self.model.domains))))
        return F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(float(self.floor)), r - dot(g)))


def profile(docs: DataFrame, model: DomainModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, p`` of every whole text: tokens and posteriors. The texts are read here, and only here."""
    rows = docs.select(docs[key].alias("doc_id"), tokens(docs[text]).alias("n"), model.counts(docs[text]).alias("c"))
    return rows.select("doc_id", "n", model.posterior(F.col("c")).alias("p"))


def fit_mix(profiles: DataFrame, model: DomainModel, targets: dict[str, float], budget: float | None = None, floor: float = 0.0, rounds: int = 60, tolerance: float = 1e-4) -> Mix:
    """Fit the rates to ``profile()`` rows, best a cut table. ``targets`` are weights of the domains, ``budget`` the tokens they share out.

    Without a budget it is the tokens there are; with ``floor`` 1 (no document is left out) it is the
    least total that has room for all of them. The descent ends when every domain that has tokens is
    within ``tolerance`` of its own target, or when no rate moves any more because the floor holds all.
    """
    rows = profiles.where("n > 0")
    sums = lambda df, r, *more: [x or 0.0 for x in df.agg(*(F.sum(r * F.col("n") * F.element_at("p", k + 1)) for k in range(len(model.domains))), *more).first()]
    available = sums(rows, F.lit(1.0))
    total = sum(targets.values())
    shares = [targets[d] / total for d in model.domains]
    if budget is None:
        budget = sum(available)
        if floor >= 1:
            budget = max([budget, *(floor * a / s for a, s in zip(available, shares) if s > 0)])
    wanted = [s * budget for s in shares]
    gradients: list[tuple[float, ...]] = []
    pending: list[list[float]] = []
    state, reached = rows.withColumn("r", F.lit(1.0)), available
    for _ in range(rounds):
        error = [(s - t) / a if a > 0 else 0.0 for s, t, a in zip(reached, wanted, available)]
        if not budget or all(abs(e) * a <= tolerance * (t or budget) for e, a, t in zip(error, available, wanted)):
            break
        gradients.append(tuple(error))
        pending.append(error)
        if len(pending) == 6:  # a long expression is cut
            state, pending = cut(state.withColumn("r", _stepped(F.col("r"), F.col("p"), pending[:-1], floor))), pending[-1:]
        before, after = (_stepped(F.col("r"), F.col("p"), g, floor) for g in (pending[:-1], pending))
        *reached, moved = sums(state, after, F.sum(F.col("n") * F.abs(after - before)))
        if moved <= 1e-12 * budget:
            break
    mix = Mix(model, tuple(gradients), floor, tuple(available), tuple(wanted), tuple(reached))
    if missed := mix.missed():
        warnings.warn(f"targets not met: {', '.join(missed)}", stacklevel=2)
    return mix


def draw(rate: Column, *key: Column) -> Column:
    """Copies of a document: the rate rounded up or down by a fixed draw of its key."""
    u = F.shiftrightunsigned(F.xxhash64(*key, F.lit("mixing")), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def rates(profiles: DataFrame, mix: Mix) -> DataFrame:
    """One row a document: tokens, posterior of each domain, rate, and the copies that it stands for."""
    made = profiles.withColumn("rate", mix.rate(F.col("p")))
    return made.select("doc_id", F.col("n").alias("n_tokens"), *(F.element_at("p", k + 1).alias(f"p_{d}") for k, d in enumerate(mix.model.domains)), "rate", draw(F.col("rate"), F.col("doc_id")).alias("copies"))


def mixed(docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as mixed: every row as often as its rate says, columns as they were.

    Posteriors are made again from the text, which is cheaper than moving the texts to join them.
    """
    c, n = free_name(docs.columns, "counts"), free_name(docs.columns, "copies")
    made = docs.withColumn(c, mix.model.counts(docs[text]))
    made = made.withColumn(c, mix.model.posterior(F.col(f"`{c}`")))
    made = made.withColumn(n, draw(mix.rate(F.col(f"`{c}`")), F.col(f"`{key}`")))
    return made.withColumn(n, F.explode(F.array_repeat(F.lit(1), F.col(f"`{n}`")))).select(*(F.col(f"`{x}`") for x in docs.columns))
