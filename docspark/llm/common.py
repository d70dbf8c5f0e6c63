"""What the operators share: scratch tables on the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions.arrow import bounded_batches, release

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A small side is broadcast only after it was counted and found to have at most this many rows.
BROADCAST_ROWS = 20_000

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; without one a folder of our own in local mode, where all tasks see it, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="docspark-")
    return _own[key]


def materialize(df: DataFrame, name: str, **written: str) -> DataFrame:
    """Write df as Parquet to the shared folder (``written``: the writer's options) and read it back: cuts lineage, survives lost executors, stays columnar."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/docspark/{name}-{uuid.uuid4().hex}"
    df.write.options(**written).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return spark.read.schema(nullable).parquet(path)


def small_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join with a side that is broadcast only if its counted rows stay under BROADCAST_ROWS; else a shuffled join."""
    few = small.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(small) if few else small, on, how)


def some_rows(rows: DataFrame, most: int, salt: str, *keys: str) -> DataFrame:
    """The rows whose keys have a low hash, about ``most`` of them; all, if there are no more. Nothing is sorted or gathered for it."""
    n, parts = rows.count(), 1 << 30
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(parts)) < most * parts // n)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew if it is read in fewer parts than there are cores, as small tables are; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: T.StructType, rows: int = 4096) -> DataFrame:
    """mapInArrow whose function gets a batch as {column: list} and yields result rows; make() runs once a task.

    Results leave in batches of at most ``rows`` rows, so memory stays bounded whatever a batch expands to.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out = make(), []
        for batch in batches:
            for row in step({n: batch.column(i) for i, n in enumerate(batch.schema.names)}):
                out.append(row)
                if len(out) >= rows:
                    yield to_batch(out, arrow)
                    out = []
        if out:
            yield to_batch(out, arrow)
        del step, out
        release()

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column as UTF-8 bytes, null as empty."""
    for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield x.as_py() or b""
