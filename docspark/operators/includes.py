"""Expansion of included components in place, once each, in the order of a depth-first walk.

The graph of a document is small beside its payloads: only (source, place, target) edges are gathered, the walk runs once a document for
all its roots, and chunks are joined to the result by component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.arrow import flat_map
from docspark.kernels.core import LIMITS, Limits

#: path: places of the includes that lead to a component; with a chunk's own place behind it, paths sort in the order of expansion.
EXPANSION = "doc_id string, root int, comp int, path array<int>, status string, missing int"


def edges(chunks: DataFrame, components: DataFrame) -> DataFrame:
    """(doc_id, src, ord, dst): includes resolved by id, exactly or without trailing NUL and line ends; dst is null if there is none."""
    raw = chunks.where("chunk_id = 'INCL'").select("doc_id", F.col("comp").alias("src"), "ord", F.col("payload").cast("string").alias("raw"))
    raw = raw.withColumn("trimmed", F.rtrim("raw", F.lit("\0\r\n")))
    ids = components.select("doc_id", "id", "comp")
    exact = ids.select("doc_id", F.col("id").alias("raw"), F.col("comp").alias("exact"))
    loose = ids.select("doc_id", F.col("id").alias("trimmed"), F.col("comp").alias("loose"))
    found = raw.join(exact, ["doc_id", "raw"], "left").join(loose, ["doc_id", "trimmed"], "left")
    return found.select("doc_id", "src", "ord", F.coalesce("exact", "loose").alias("dst"))


def expansion(components: DataFrame, edges_: DataFrame, roots: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """For each root (doc_id, root) the components its expansion visits, with paths; or one row with the status that ends it.

    components: (doc_id, comp, kind, loaded). A root whose walk meets a component that isn't loaded has MissingComponent and its number.
    """
    graph = edges_.groupBy("doc_id").agg(F.collect_list(F.struct("src", "ord", "dst")).alias("edges"))
    parts = components.groupBy("doc_id").agg(F.collect_list(F.struct("comp", "kind", "loaded")).alias("parts"))
    starts = roots.groupBy("doc_id").agg(F.sort_array(F.collect_list("root")).alias("roots"))
    rows = starts.join(parts, "doc_id").join(graph, "doc_id", "left").select("doc_id", "roots", "parts", "edges")

    def call(doc_id, starts, parts, found):
        kind = {p["comp"]: p["kind"] for p in parts}
        loaded = {p["comp"] for p in parts if p["loaded"]}
        out: dict[int, list] = {}
        for e in sorted(found or (), key=lambda e: (e["src"], e["ord"])):
            out.setdefault(e["src"], []).append((e["ord"], e["dst"]))
        for root in starts:
            yield from ((doc_id, root, *r) for r in walk(root, kind, loaded, out, limits.include_depth))

    return flat_map(rows, EXPANSION, call)


def walk(root: int, kind: dict[int, str], loaded: set[int], out: dict[int, list], most: int) -> list[tuple]:
    """(comp, path, status, missing) rows of one root's expansion."""
    if root not in loaded:
        return [(None, None, "MissingComponent", root)]
    rows = [(root, [], "ok", None)]
    state = {root: 1}
    stack = [(root, [], iter(out.get(root, ())))]
    while stack:
        comp, path, targets = stack[-1]
        step = next(targets, None)
        if step is None:
            state[comp] = 2
            stack.pop()
            continue
        place, target = step
        if target is None or kind[target] not in ("shared", "shared_annotations") or state.get(target) == 1:
            return [(None, None, "InvalidData", None)]
        if state.get(target) == 2:
            continue
        if len(stack) >= most:
            return [(None, None, "LimitExceeded", None)]
        if target not in loaded:
            return [(None, None, "MissingComponent", target)]
        state[target] = 1
        rows.append((target, [*path, place], "ok", None))
        stack.append((target, [*path, place], iter(out.get(target, ()))))
    return rows


def missing(expansions: DataFrame, components: DataFrame) -> DataFrame:
    """(doc_id, root, comp, id): the next component that each root needs and that isn't loaded."""
    lack = expansions.where("status = 'MissingComponent'").select("doc_id", "root", F.col("missing").alias("comp"))
    return lack.join(components.select("doc_id", "comp", "id"), ["doc_id", "comp"], "left").select("doc_id", "root", "comp", "id")
