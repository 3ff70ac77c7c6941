"""Quality rules: a decision list learned by sequential covering, applied as Spark conditionals.

Every whole text gives a row of statistics. From a bounded sample of labelled rows the learner grows
threshold conjunctions by information gain, prunes them on rows it did not grow on, and puts them in
order. The list is emitted as one ``CASE WHEN`` over the statistics, so that the decision itself runs
in the JVM and can be read.

Defined results: a null text has no words, as has an empty one; both fail the base rules. Repeated
rows get equal verdicts, each its own row. An empty table gives no rows. Without labels of both kinds
no rule is learned and the base rules decide alone. Conflicting labels of one document are averaged;
a mean of one half counts as good. Null labels are left out.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows

#: Most labelled rows that a fit gathers; with a dozen statistics each that is under 2 MB.
MAX_LABELLED = 8192
WINDOW = 5
WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclaims",
]
COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more; exact."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    mixed = ids[:n].copy()
    for j in range(1, WINDOW):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += ids[j : n + j]
    order = np.argsort(mixed, kind="stable")
    near = mixed[order]
    first, second = order[:-1], order[1:]
    equal = near[1:] == near[:-1]
    if not equal.any():
        return 0
    first, second = first[equal], second[equal]
    hit = np.zeros(n, bool)
    if all((ids[first + j] == ids[second + j]).all() for j in range(WINDOW)):
        hit[first] = hit[second] = True
    else:  # two windows share a mixed value: compare the windows themselves
        keys = list(zip(*(ids[j : n + j].tolist() for j in range(WINDOW))))
        count: dict[tuple, int] = {}
        for k in keys:
            count[k] = count.get(k, 0) + 1
        hit[[i for i, k in enumerate(keys) if count[k] > 1]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of ``COUNTS``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at runs of x20 and x09-x0D only
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _DIGIT)),
        text.count("!"),
    )


def with_counts(docs: DataFrame, text: str = "text", into: str = "counts", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct column of the counts of each whole text."""

    def make():
        def run(texts):
            return {into: [dict(zip(COUNTS, count_text(t))) for t in texts]}

        return run

    return map_rows(docs, make, text, T.StructType([T.StructField(into, COUNT_TYPE)]), keep)


def base_failed(at: str) -> Column:
    c = lambda n: F.col(f"`{at}`.{n}")
    return (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))


#: Statistics that a rule may test: name -> (numerator, denominator); zero over zero is zero.
STATISTICS = {
    "words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_a_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "upper_case": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "exclamations": ("n_exclaims", "n_words"),
}


#: Growth of the vocabulary, ln(1 + distinct) / ln(1 + words): unlike their ratio steady over text lengths.
RICHNESS = "richness"
NAMES = [*STATISTICS, RICHNESS]


def statistic(name: str, at: str) -> Column:
    if name == RICHNESS:
        log = lambda n: F.ln(F.col(f"`{at}`.{n}") + 1)
        return F.when(F.col(f"`{at}`.n_words") > 0, log("n_distinct_words") / log("n_words")).otherwise(0.0)
    top, bottom = STATISTICS[name]
    value = F.col(f"`{at}`.{top}").cast("double")
    return value if bottom is None else value / F.greatest(F.col(f"`{at}`.{bottom}"), F.lit(1)).cast("double")


@dataclasses.dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def column(self, at: str) -> Column:
        value = statistic(self.name, at)
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclasses.dataclass(frozen=True)
class Rule:
    """Reject where all tests hold."""

    tests: tuple[Test, ...]

    def __str__(self) -> str:
        return "reject if " + " and ".join(map(str, self.tests))


def _holds(tests, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in tests:
        out &= x[t.name] > t.limit if t.above else x[t.name] <= t.limit
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Test | None]:
    """The threshold with the largest information gain for the bad rows; of equals the widest gap."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    base = np.log2(p0 / (p0 + n0))
    best: tuple[float, float] = (1e-9, 0.0)
    found = None
    for name, values in x.items():
        v, b = values[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], b[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        low_p = np.cumsum(b)[cuts].astype(float)
        low_n = (cuts + 1) - low_p
        gaps = (v[cuts + 1] - v[cuts]) / (v[-1] - v[0])
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
            top = gain.max()
            among = np.flatnonzero(gain >= top - 1e-9)
            k = among[np.argmax(gaps[among])]
            if (top, gaps[k]) > (best[0] + 1e-9, -1.0) or (abs(top - best[0]) <= 1e-9 and gaps[k] > best[1]):
                best, found = (top, gaps[k]), Test(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best[0], found


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 24, max_tests: int = 4, min_precision: float = 0.75) -> list[Rule]:
    """Sequential covering: grow on two rows of three, prune on the third, drop what is covered."""
    n = len(bad)
    rules: list[Rule] = []
    left = np.ones(n, bool)
    third = np.arange(n) % 3 == 2
    while len(rules) < max_rules and (left & bad & ~third).any() and (left & ~bad).any():
        tests: list[Test] = []
        inside = left & ~third
        while len(tests) < max_tests and (inside & ~bad).any():
            gain, test = _best_test(x, bad, inside)
            if test is None or gain <= 0:
                break
            tests.append(test)
            inside &= _holds([test], x, n)
        worth = lambda ts: ((c := left & third & _holds(ts, x, n))[bad].sum() - c[~bad].sum()) / max(1, c.sum())
        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        covered = left & _holds(tests, x, n)
        p, q = int(covered[bad].sum()), int(covered[~bad].sum())
        if not tests or p < 2 or (p + 1) / (p + q + 2) < min_precision:
            break
        rules.append(Rule(tuple(tests)))
        left &= ~covered
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, key: str = "doc_id", text: str = "text") -> list[Rule]:
    """Learn rules from at most ``max_labelled`` labelled rows, chosen by the hash of their key."""
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id").agg(F.avg("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
        .select(F.col("doc_id").alias("k"), F.col("quality"))
    )
    texts = docs.select(docs[key].alias("d"), docs[text].alias("t"))
    joined = texts.join(F.broadcast(chosen), F.col("d") == F.col("k")).select("d", "t", "quality")
    stats = with_counts(joined, "t", "counts", keep=["d", "quality"])
    # a document that occurs again and again still counts once: the driver gets max_labelled rows at most
    columns = [F.max(statistic(s, "counts")).alias(s) for s in NAMES]
    rows = stats.groupBy("d").agg(F.max("quality").alias("quality"), *columns).orderBy("d").collect()
    if not rows:
        return []
    bad = np.array([r["quality"] < 0.5 for r in rows])
    return learn({s: np.array([r[s] for r in rows], float) for s in NAMES}, bad)


def verdict(rules: list[Rule], at: str) -> Column:
    """The number of the first rule that rejects, from 1; 0 where none does."""
    if not rules:
        return F.lit(0)
    tests = [reduce(lambda a, b: a & b, (t.column(at) for t in r.tests)) for r in rules]
    out = F.when(tests[0], 1)
    for i, test in enumerate(tests[1:], 2):
        out = out.when(test, i)
    return out.otherwise(0)


def apply_rules(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: the counts, the base verdict, the rule that fired, whether it is kept."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    counted = with_counts(rows, "text", "counts", keep=["doc_id"])
    return (
        counted.select("doc_id", *(F.col(f"counts.{c}").alias(c) for c in COUNTS[:5]), base_failed("counts").alias("base_failed"), verdict(rules, "counts").alias("rule"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select("doc_id", *COUNTS[:5], "base_failed", "kept", "rule")
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    at = free_name(docs.columns, "counts")
    return with_counts(docs, text, at).where(~base_failed(at) & (verdict(rules, at) == 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
