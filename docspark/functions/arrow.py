"""Flat maps over Arrow batches: the one way in which kernels are called."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from docspark.kernels.core import Bad

#: Arrow batches from the JVM hold about this many bytes, unless the session says otherwise; those of results as many before they leave.
BATCH_BYTES = 4 << 20
#: Rows of a batch that are Python objects at a time.
TAKEN = 64
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, so that large rows don't add up; a setting of the session's own stays."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def release() -> None:
    """Gives a worker's free memory back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if os.uname().sysname == "Linux" and hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def _held(x) -> int:
    """About the bytes that a value holds."""
    if isinstance(x, (bytes, bytearray, str)):
        return 40 + len(x)
    return 40 + sum(map(_held, x)) if isinstance(x, (list, tuple)) else 8


def flat_map(df: DataFrame, schema: T.StructType | str, call: Callable[..., Iterable[tuple]], rows: int = 1024) -> DataFrame:
    """call(*row) yields result rows for every row of df; results leave in batches of at most ``rows`` rows, or of fewer that hold BATCH_BYTES."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, TAKEN):
                for given in zip(*(c.slice(at, TAKEN).to_pylist() for c in b.columns), strict=True):
                    for row in call(*given):
                        out.append(row)
                        size += _held(row)
                        if len(out) >= rows or size >= BATCH_BYTES:
                            yield batch(out)
                            out, size = [], 0
        if out:
            yield batch(out)
        del out
        release()

    return df.mapInArrow(run, schema)


def guarded(call: Callable, *args) -> tuple[object, str, str | None]:
    """(result, status, why): a typed failure is data."""
    try:
        return call(*args), "ok", None
    except Bad as e:
        return None, e.code, e.why or None
