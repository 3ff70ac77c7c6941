"""Budgets and configuration of a run: driver objects, and the same caps over tables of requests."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import time
from collections import deque
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import running_totals


#: The caps in the order in which they are told, with the name that is told of each.
LIMITS = {"seconds": "time", "calls": "calls", "total_tokens": "total_tokens", "input_tokens": "input_tokens", "output_tokens": "output_tokens"}


def admitted(requests: DataFrame, order: Sequence[Column], caps: dict[str, float]) -> DataFrame:
    """``requests`` (seconds, calls, input_tokens, output_tokens of each) with ``refused``: the first cap that what came before has used up, null while there is none."""
    priced = requests.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    spent = running_totals(priced, order, list(caps))
    reasons = [F.when(F.col(f"{c}_so_far") - F.col(c) >= caps[c], told) for c, told in LIMITS.items() if c in caps]
    return spent.withColumn("refused", F.coalesce(*reasons)).drop("total_tokens", *(f"{c}_so_far" for c in caps))


class BudgetExceeded(RuntimeError):
    """A cap would be passed; ``kind`` names it."""

    def __init__(self, kind: str):
        super().__init__(f"budget exhausted: {kind}")
        self.kind = kind


@dataclasses.dataclass
class Budget:
    """Caps of a run and what is used of them. None is no cap."""

    seconds: float | None = None
    calls: int | None = None
    total_tokens: int | None = None
    input_tokens: int | None = None
    output_tokens: int | None = None
    reserve_seconds: float = 180.0
    reserve_share: float = 0.08
    reserve_evaluations: int = 6
    clock: object = time.time

    def __post_init__(self) -> None:
        self.started = self.clock()
        self.used = {"calls": 0, "input_tokens": 0, "output_tokens": 0}
        self.durations: deque[float] = deque(maxlen=10)

    def spend(self, calls: int = 0, input_tokens: int = 0, output_tokens: int = 0) -> None:
        for k, v in (("calls", calls), ("input_tokens", input_tokens), ("output_tokens", output_tokens)):
            self.used[k] += v

    def observe_evaluation(self, seconds: float) -> None:
        self.durations.append(seconds)

    @property
    def mean_evaluation(self) -> float | None:
        return sum(self.durations) / len(self.durations) if self.durations else None

    def left(self, what: str) -> float | None:
        if what == "seconds":
            return None if self.seconds is None else max(0.0, self.seconds - (self.clock() - self.started))
        cap = getattr(self, what)
        spent = self.used["input_tokens"] + self.used["output_tokens"] if what == "total_tokens" else self.used[what]
        return None if cap is None else max(0, cap - spent)

    def search_seconds(self) -> float | None:
        """Time left for the search: what stays is kept for the last evaluations."""
        left = self.left("seconds")
        if left is None:
            return None
        reserve = max(self.reserve_seconds, self.seconds * self.reserve_share, (self.mean_evaluation or 0.0) * self.reserve_evaluations)
        return max(0.0, left - reserve)

    def exhausted(self, search: bool = False) -> str | None:
        """The first cap that is used up: time, calls, then tokens in total, in and out."""
        if search and (left := self.search_seconds()) is not None and left <= 0:
            return "time_reserved_for_finalize"
        for what, told in LIMITS.items():
            if (left := self.left(what)) is not None and left <= 0:
                return told
        return None

    def time_for_evaluation(self) -> bool:
        left, mean = self.search_seconds(), self.mean_evaluation
        return left is None or (left > 0 if mean is None else left > mean)

    def new_tokens(self, input_tokens: int, prompts: int, wanted: int) -> int:
        """New tokens that each of ``prompts`` may have in one call."""
        if prompts <= 0:
            raise ValueError("a call needs a prompt")
        if reason := self.exhausted():
            raise BudgetExceeded(reason)
        total, into, out = (self.left(w) for w in ("total_tokens", "input_tokens", "output_tokens"))
        for kind, left in (("total_tokens", total), ("input_tokens", into)):
            if left is not None and input_tokens > left:
                raise BudgetExceeded(kind)
        caps = [wanted, *([int(out) // prompts] if out is not None else []), *([max(0, int(total) - input_tokens) // prompts] if total is not None else [])]
        if min(caps) <= 0:
            raise BudgetExceeded("output_tokens")
        return min(caps)


def substituted(value):
    """``${NAME}`` in texts, replaced by the environment; unset names are empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: substituted(v) for k, v in value.items()}
    return [substituted(v) for v in value] if isinstance(value, list) else value


def merged(base: dict, over: dict) -> dict:
    """``over`` on top of ``base``, maps within maps too."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(path: str, overrides: dict | None = None) -> dict:
    """A JSON or YAML configuration with the environment put in and overrides on top."""
    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(path)
    text = file.read_text(encoding="utf-8")
    if file.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML needs the yaml package; use JSON here") from missing
        config = yaml.safe_load(text) or {}
    else:
        config = json.loads(text)
    return merged(substituted(config), overrides or {})
