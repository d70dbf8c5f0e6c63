"""Tags under which running questions can be cancelled; output of a cancelled one is never published."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry the tag, on this thread."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Cancel what runs under a tag; the waiting caller gets an error. Returns the ids of the cancelled operations."""
    return spark.interruptTag(tag)
