"""A Python data source that lists the chunks of documents by seeking from header to header.

``spark.read.format("layered_chunks").load(folder)``: one partition a file, a row a chunk. Payloads are read only if they are asked for.
Option ``chunk_ids`` names the chunks to read, so a scan for annotations never touches image data. With option ``pushdown`` filters on
``chunk_id`` do the same; Spark then keeps the reader for the frame, so load a frame anew for every other filter.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "doc_id string, component long, chunk_id string, offset long, length long, payload binary"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool, ids: set[str] | None, pushdown: bool):
        self.path, self.payload, self.ids, self.pushdown = path, payload, ids, pushdown

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.pushdown:
                yield f
            elif isinstance(f, EqualTo) and f.attribute == ("chunk_id",):
                self.ids = {f.value} if self.ids is None else self.ids & {f.value}
            elif isinstance(f, In) and f.attribute == ("chunk_id",):
                self.ids = set(f.value) if self.ids is None else self.ids & set(f.value)
            else:
                yield f

    def partitions(self) -> list[_File]:
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if not n.startswith((".", "_"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        """Rows of one file; a damaged tail ends it."""
        size = os.path.getsize(partition.path)
        with open(partition.path, "rb") as f:
            start = 4 if f.read(4) == b"AT&T" else 0
            yield from self._chunks(f, partition.path, start, size, start)

    def _chunks(self, f, path: str, at: int, end: int, component: int) -> Iterator[tuple]:
        while at + 8 <= end:
            f.seek(at)
            head = f.read(8)
            id_, length = head[:4].decode("latin-1"), int.from_bytes(head[4:], "big")
            if at + 8 + length > end:
                return
            if id_ == "FORM":
                yield from self._chunks(f, path, at + 12, at + 8 + length, at)
            elif self.ids is None or id_ in self.ids:
                yield path, component, id_, at, length, f.read(length) if self.payload else None
            at += 8 + length + (length & 1)


class LayeredChunks(DataSource):
    """Options: path; payload (true or false, true by default)."""

    @classmethod
    def name(cls) -> str:
        return "layered_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        told = lambda name, default: self.options.get(name, default).lower() == "true"
        ids = {x.strip() for x in self.options.get("chunk_ids", "").split(",") if x.strip()} or None
        return _Reader(self.options["path"].removeprefix("file://"), told("payload", "true"), ids, told("pushdown", "false"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LayeredChunks)
