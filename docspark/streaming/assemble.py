"""Indirect documents whose component files arrive one by one.

A document is held, keyed by its id, until its index and every file the index names are there; then it leaves once, as files for
``DocumentSet``. One that waits longer than the timeout leaves with what it has and the status MissingComponent. For as long again its id
is remembered, without its files, so that files that come late or twice don't make it leave again. A run with
``availableNow`` needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off, or it stays to wait for timeouts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.kernels import iff
from docspark.kernels.core import Bad
from docspark.sources.documents import directory_of

ARRIVALS = "doc_id string, name string, content binary"
OUT = "doc_id string, status string, missing array<string>, content binary, files array<struct<name:string,content:binary>>"
#: What a document that has left is remembered by.
LEFT = "left"
STATE = "index binary, names array<string>, contents array<binary>, wanted string"


def assemble(arrivals: DataFrame, timeout_ms: int = 3_600_000) -> DataFrame:
    """arrivals: a stream of (doc_id, name, content); name is empty for the index. One row for each document that is complete or timed out."""

    def wanted_names(index: bytes) -> list[str]:
        from docspark.kernels.core import LIMITS

        _, entries = directory_of(iff.root(index), LIMITS)
        return [e[2] for e in entries if e[6] is None]

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        index, names, contents, wanted = state.get if state.exists else (None, [], [], None)
        timed_out = state.hasTimedOut
        if wanted == LEFT:
            if timed_out:
                state.remove()
            else:
                state.setTimeoutDuration(timeout_ms)
            return
        files = dict(zip(names, contents, strict=True))
        if not timed_out:
            for batch in batches:
                for name, content in zip(batch["name"], batch["content"], strict=True):
                    if name:
                        files.setdefault(name, bytes(content))
                    elif index is None:
                        index = bytes(content)
        status, lack = "ok", []
        if index is not None:
            try:
                lack = [n for n in wanted_names(index) if n not in files]
            except Bad as e:
                status = e.code
        if timed_out or index is not None and (not lack or status != "ok"):
            if timed_out and (index is None or lack):
                status = "MissingComponent"
            state.update((None, [], [], LEFT))
            state.setTimeoutDuration(timeout_ms)
            kept = [{"name": n, "content": c} for n, c in sorted(files.items())]
            yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "missing": [lack], "content": [index], "files": [kept]})
            return
        state.update((index, list(files), list(files.values()), json.dumps(lack)))
        state.setTimeoutDuration(timeout_ms)

    keyed = arrivals.select("doc_id", F.coalesce("name", F.lit("")).alias("name"), "content").groupBy("doc_id")
    return keyed.applyInPandasWithState(step, OUT, STATE, "append", "ProcessingTimeTimeout")


def arrivals_of(files: DataFrame) -> DataFrame:
    """Arrivals from a binaryFile stream: a folder is a document, index.* its index, other files its components."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace("path", r"/[^/]*\z", "").alias("doc_id"), F.when(name.rlike(r"\Aindex\."), "").otherwise(name).alias("name"), "content")
