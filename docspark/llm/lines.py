"""Line deduplication: drop the lines that another, earlier document already holds.

Lines are normalised and hashed to 128 bits; each document sends every hash once. A hash whose smallest and largest document differ
is found in two documents at least, so the count of distinct documents needs no distinct aggregate. Only hashes are shuffled by key;
texts move once, by doc_id, to be reassembled.

A line goes if at least ``min_docs`` documents hold it (two by contract, so that the smallest and largest one suffice).

Defined cases: a null or empty text is one empty line; a row with a null doc_id is a document after all others, by a hash of its text (equal
texts are one document); repeated rows of one doc_id are one document and each row is answered; an empty table gives an empty result;
columns beyond doc_id and text are carried by ``dedup_lines`` and ignored by ``line_report``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import SPACES, bounded_batches, map_rows, materialize, utf8

#: Rows without a doc_id have the last numbers, below 2^63 by the hash of their text modulo this.
UNNAMED = 1 << 61
#: A hash held by more than one in so many of all (document, hash) rows is hot; there are at most so many hot ones, so they are broadcast.
HOT_SHARE = 1000

_KEYS = T.StructType([T.StructField("d", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None if the key has fewer than min_chars code points."""
    key = line.strip(SPACES)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    def make():
        def step(batch):
            for d, text in zip(batch["d"].to_pylist(), utf8(batch["t"]), strict=True):
                found = {line_hash(x, min_chars) for x in text.split(b"\n")}
                found.discard(None)
                if found:
                    halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2).tolist()
                    for a, b in halves:
                        yield d, a, b

        return step

    return map_rows(docs, make, _KEYS, 65_536)


def _number(docs: DataFrame):
    """What orders documents: doc_id, or a number after all others."""
    unnamed = F.lit(2**63 - 1) - F.pmod(F.xxhash64(F.coalesce(docs["text"], F.lit(""))), F.lit(UNNAMED))
    return F.coalesce(docs["doc_id"].cast("long"), unnamed)


def dropped_hashes(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(d, drop): for every document that loses lines, the hashes of the lines it loses."""
    few = docs.select(_number(docs).alias("d"), F.col("text").alias("t"))
    keys = materialize(_keys(few, min_chars), "line-keys")
    total = keys.count()
    held = keys.groupBy("h1", "h2").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n")).where("lo < hi").drop("hi")
    if min_docs > 2:  # documents are counted apart only where rows may repeat one
        several = keys.distinct().groupBy("h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
        held = held.join(several.drop("docs"), ["h1", "h2"], "left_semi")
    shared = materialize(held, "line-shared")
    hot = F.col("n") * HOT_SHARE > total
    drops = keys.join(F.broadcast(shared.where(hot).drop("n")), ["h1", "h2"]).unionByName(keys.join(shared.where(~hot).drop("n"), ["h1", "h2"])).where("d > lo")
    return drops.groupBy("d").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))


def _with_drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    # Written, so that the join has plain exchanges on both sides and rows that repeat a doc_id can be split.
    drops = materialize(dropped_hashes(docs, min_chars, min_docs), "line-drops").select(F.col("d").alias("__llm_d"), F.col("drop").alias("__llm_drop"))
    return docs.withColumn("__llm_d", _number(docs)).join(drops, "__llm_d", "left").drop("__llm_d")


def _split(text: bytes, drop, min_chars: int) -> tuple[list[bytes], list[bytes]]:
    lines = text.split(b"\n")
    if drop is None or not len(drop):
        return lines, lines
    gone = {np.array([x["h1"], x["h2"]], "<i8").tobytes() for x in drop}
    return lines, [x for x in lines if line_hash(x, min_chars) not in gone]


def line_report(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each row's text after line deduplication."""

    def make():
        def step(batch):
            for d, text, drop in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), batch["__llm_drop"].to_pylist(), strict=True):
                lines, kept = _split(text, drop, min_chars)
                yield d, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    return map_rows(_with_drops(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs), make, schema)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """The rows of docs, all columns kept, with repeated lines taken out of ``text``; n_chars, if there, follows the text."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def rebuild(text, drop):
        import pandas as pd

        out = [b"\n".join(_split((t or "").encode(), d, min_chars)[1]).decode() for t, d in zip(text, drop, strict=True)]
        return pd.Series(out, dtype=object)

    lost = F.col("__llm_drop").isNotNull()
    packed = F.transform("__llm_drop", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2")))
    with_drops = _with_drops(docs, min_chars, min_docs).withColumn("__llm_drop", packed)
    out = with_drops.withColumn("text", F.when(lost, rebuild("text", "__llm_drop")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line, lower_ascii AS k FROM (
    SELECT doc_id, unnest(list_zip(range(len(ls)), ls)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
  ) s, LATERAL (SELECT z[1] AS pos, z[2] AS line) u,
  LATERAL (SELECT translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) t
), g AS (
  SELECT k, min(doc_id) AS lo FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT l.doc_id, l.pos, l.line, (g.k IS NOT NULL AND l.doc_id > g.lo) AS gone FROM l LEFT JOIN g ON l.k = g.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
