"""A corpus pipeline of five stages; each gets what the one before kept.

Documents that the quality rules reject go; lines that an earlier document holds go; of near copies (five-word shingles, Jaccard similarity
0.8 or more) the smallest doc_id stays; sources are mixed to their target weights, so a document may go or come up to three times; the
last stage gives the token ids of every text, and the text that they decode to as a digest.

SQL can express neither the trained trees nor fingerprints, so ORACLE_SQL is None; tests hold run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import bpe, lines, mixing, neardup, quality
from docspark.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs but text, then n_tokens, the token ids of every text, and the SHA-256 of the text that they decode to.

    A new column whose name docs has already gets underscores behind it.
    """
    out = bpe.encode(docs, digest="decoded_sha256", text=False)
    *kept, ids, digest = out.columns
    n = bpe.free_name("n_tokens", out.columns)
    return out.select(*kept, F.size(ids).cast("long").alias(n), ids, digest)


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", simhash_near_dedup), ("mix sources", mix_sources), ("bpe encoding", bpe_encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
