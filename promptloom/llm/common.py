"""Helpers shared by the training-data operators: tables, shared storage, column names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.storage import cut, remove_folder, shared_folder, shared_storage, ship  # noqa: F401  shared with the library

#: Rows and bytes of one Arrow batch: texts can be long, and a batch ends with the row that reaches either.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, or ``wish`` with underscores added until no column of any letter case has it."""
    used = {c.lower() for c in taken}
    while wish.lower() in used:
        wish += "_"
    return wish


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches small. The setting is read when a plan runs, so it stays on the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[list], dict[str, list]]],
    text: str,
    adds: T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Arrow map over batches: ``make()`` runs once a task and gives ``texts -> {column: values}``.

    The rows of ``df`` stay as they are (all columns, or those in ``keep``), in place and number; the
    columns of ``adds`` follow. ``None`` reaches the function as ``None``.
    """
    ship(df.sparkSession)
    bound_batches(df.sparkSession)
    kept = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in kept), *adds.fields])
    arrow = to_arrow_schema(schema)
    names = [f.name for f in adds.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            made = function(batch.column(text).to_pylist())
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(made[n], type=arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
