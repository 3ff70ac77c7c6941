"""Racing as a stream: candidates stop as soon as their outcomes, in the order of their numbers, beat them for sure.

Outcomes may arrive in any order, over any batches and more than once. The state of a candidate is the number that is
expected next, the sum so far, the decision, and what came early; it is released when the gap closes, so the decisions are
those of ``operators.evaluate.racing`` over the same rows. A decision comes out once, in the batch that brings it about.

Defined results: rows with a null candidate, number or outcome are left out; of a number that comes again the first counts; a
candidate with a gap waits; one that is never beaten has no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import ship

_STATE = "expected long, right double, stop long, early array<long>, outcomes array<double>"


def advanced(state: tuple, rows: dict[int, float], baseline: float, min_n: int, alpha: float) -> tuple:
    """The state after further rows (number to outcome): what follows without a gap is counted, the rest is kept."""
    expected, right, stop, early, outcomes = state
    waiting = {**rows, **dict(zip(early, outcomes))}
    while stop is None and expected in waiting:
        right += waiting.pop(expected)
        if expected >= min_n and right / expected + math.sqrt(math.log(2.0 / alpha) / (2 * expected)) < baseline:
            stop = expected
        expected += 1
    kept = [] if stop is not None else sorted(n for n in waiting if n >= expected)
    return expected, right, stop, kept, [waiting[n] for n in kept]


def racing_stops(outcomes: DataFrame, baseline: float, by: str = "record_id", n: str = "n", correct: str = "correct", min_n: int = 10, alpha: float = 0.05) -> DataFrame:
    """A streaming table of ``by, stop_n``: one row for each candidate that is beaten, when it is."""
    ship(outcomes.sparkSession)
    rows = outcomes.select(F.col(by).alias("k"), F.col(n).cast("long").alias("n"), F.col(correct).cast("double").alias("c")).dropna()
    made = T.StructType([T.StructField(by, rows.schema["k"].dataType), T.StructField("stop_n", T.LongType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = tuple(state.get) if state.exists else (1, 0.0, None, [], [])
        if before[2] is not None:
            return
        now = before
        for batch in batches:
            if now[2] is None:
                first = batch.drop_duplicates("n")
                now = advanced(now, dict(zip(first["n"].tolist(), first["c"].tolist())), baseline, min_n, alpha)
        state.update(now)
        if now[2] is not None:
            yield pd.DataFrame({by: [key[0]], "stop_n": [now[2]]})

    return rows.groupBy("k").applyInPandasWithState(step, made, _STATE, "append", "NoTimeout")
