"""Arrow batches in and out of Python functions: helpers shared by the operators that run numpy code."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of one Arrow batch: what a Python worker holds at once doesn't depend on how long texts are.
BATCH_BYTES = 2 << 20
ROWS = 1024


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Spark sends to Python, in rows and, where this Spark can, in bytes."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            spark.conf.set(key, value)
        except Exception:  # an unknown or fixed setting: batches keep Spark's own bounds
            continue


def binary(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in pc.cast(column, pa.binary()).to_pylist()]


def as_array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], dict | None], schema: str | StructType, columns: Sequence[str]) -> DataFrame:
    """``df`` through ``work``, batch by batch: it gets ``columns`` and returns a column dict (or None)."""
    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)
