"""Text generation as a partition function: a client is made once a partition and asked in batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import ship

BATCH = 16


class Client(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class StubClient:
    """Answers that depend on the prompt alone: the same at every run and on every executor."""

    def __init__(self, answers: tuple[str, ...] = ("yes", "no", "maybe")):
        self.answers = answers

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            h = int.from_bytes(hashlib.sha256(p.encode()).digest()[:8], "big")
            if "\nInstruction:" in p:
                out.append(f"{p.rsplit('Instruction:', 1)[-1].strip()} Think about case {h % 1000}.".strip())
            else:
                out.append(f"The answer is {self.answers[h % len(self.answers)]}.")
        return out


def retry_delay(attempt: int, retry_after: float | None = None, jitter: float = 0.0) -> float:
    """Seconds to wait: what the server says, else doubling from 2 up to 60, with up to a quarter more."""
    return retry_after if retry_after is not None else min(2.0 * 2**attempt, 60.0) * (1 + 0.25 * min(max(jitter, 0.0), 1.0))


def generate(df: DataFrame, make: Callable[[], Client], prompt: str = "prompt", into: str = "reply") -> DataFrame:
    """``df`` with the reply to each prompt. An empty reply is asked for once more; a null prompt is not asked, its reply is null.

    What a call uses is returned as columns, not counted in accumulators, which retried tasks would
    count twice.
    """
    ship(df.sparkSession)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` string", "calls int", "input_words long", "output_words long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            prompts = batch.column(prompt).to_pylist()
            replies: list[str | None] = [None] * len(prompts)
            calls = [0] * len(prompts)

            def ask(rows: list[int]) -> None:
                for i in range(0, len(rows), BATCH):
                    part = rows[i : i + BATCH]
                    for k, r in zip(part, client.generate([prompts[k] for k in part])):
                        replies[k] = r or ""
                        calls[k] += 1

            ask([k for k, p in enumerate(prompts) if p is not None])
            ask([k for k, r in enumerate(replies) if r is not None and not r.strip()])
            words = [pa.array([len((t or "").split()) for t in ts], pa.int64()) for ts in (prompts, replies)]
            extra = [pa.array(replies, pa.string()), pa.array(calls, pa.int32()), *words]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, into, "calls", "input_words", "output_words"])

    return df.mapInArrow(run, schema)


def usage(generated: DataFrame) -> DataFrame:
    return generated.agg(F.sum("calls").alias("calls"), F.sum("input_words").alias("input_words"), F.sum("output_words").alias("output_words"))
