"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned to the principal axes of a bounded sample, so that what tells them apart comes first, and cut into segments that keep
mean and deviation. The squared distance of two vectors is at least the sum over segments of ``length * ((mean_q - mean_x)^2 + (dev_q -
dev_x)^2)``, so, as ``2 q.x = |q|^2 + |x|^2 - distance^2``, the inner product is at most the sum of ``length * (mean_q * mean_x + dev_q *
dev_x)``. Segments split from level to level, leading axes first; rows whose bound falls below the k-th best score known leave at each
level, and exact integer scores are computed for the survivors. A turn keeps inner products, and bounds leave room for its rounding.

Rows are dealt in blocks by the nearest of at most ``CLUSTERS`` centres of the sample; every row is in one. A block of queries first meets a
block of its own cluster, which gives each query a limit; then it goes to the blocks of those clusters alone that can hold a better row: centre
and radius of a cluster bound its scores before any vector is shuffled. The best of all cells follow by a window that keeps k rows a
query before it shuffles. How much is pruned depends on the data (README); on vectors without any structure every row is scored.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a row with a null vec_id; an empty vector scores 0
with every other; of rows that repeat a vec_id the smallest vector counts; a shorter vector counts as padded with zeros; components of any finite
size are scored exactly, and a score among the results that leaves 64 bits is an error; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import bounded_batches, materialize, release, some_rows

#: Rows of a block of candidates and of one of queries; queries that are looked at together. Wide vectors have fewer, by NUMBERS components.
CANDIDATES, QUERIES, TILE = 8192, 8192, 64
NUMBERS = 1 << 21
#: How tables of vectors and blocks are written: row groups of bounded bytes, as readers hold whole ones, looked at after every row and not the hundredth.
WRITTEN = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Leading axes that are segments of their own, by level; behind them segments double in length.
HEADS = (2, 8, 32)
#: Clusters at most, rows and components of the sample they are fitted on, and axes up to which vectors are turned.
CLUSTERS, SAMPLE, SAMPLE_NUMBERS, MOST_AXES = 256, 4096, 1 << 20, 1024
#: Room for rounding, relative to the product of two norms.
ROUNDING = 1e-10
SCALE = 64
K = 20


def finite_rows(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the vector as doubles, of the rows that take part, one a vec_id."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    twice = materialize(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "vector-repeats")
    if twice.isEmpty():
        return rows
    return rows.join(twice, "vec_id", "left_anti").unionByName(rows.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def quantized(v: np.ndarray) -> np.ndarray:
    """floor(64 * x) of doubles, as integers in doubles."""
    out = np.floor(v * float(SCALE))
    if out.size and float(np.abs(out).max()) > 1e100:
        raise OverflowError("a component is beyond 1e100")
    return out


def most_rows(most: int, axes: int) -> int:
    """Rows of so many components that are held at a time."""
    return max(1, min(most, NUMBERS // axes))


def edges_of(axes: int, head: int) -> np.ndarray:
    """Where segments of a level begin, and the end: ``head`` single axes, then lengths that double."""
    out = list(range(min(head, axes)))
    at = min(head, axes)
    while at < axes:
        out.append(at)
        at *= 2
    return np.array([*out, axes])


def segment_features(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Rows of means and deviations of a vector's segments, scaled so that the inner product of two rows is the bound."""
    length = np.diff(edges)
    mean = np.add.reduceat(v, edges[:-1], axis=1) / length
    spread = v - np.repeat(mean, length, axis=1)
    deviation = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1) / length)
    wide = length > 1
    return np.concatenate([mean * np.sqrt(length), deviation[:, wide] * np.sqrt(length[wide])], axis=1)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of paired rows of integers in doubles."""
    if not len(q):
        return np.zeros(0, np.int64)
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if most < 2**62:
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    out = [sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q.tolist(), x.tolist(), strict=True)]
    if any(not -(2**63) <= s < 2**63 for s in out):
        raise OverflowError("a score among the results leaves 64 bits")
    return np.array(out, np.int64)


@dataclass
class Space:
    """Axes (None: as they are) and centres, fitted on a sample."""

    axes: int
    turn: np.ndarray | None
    centres: np.ndarray

    def turned(self, v: np.ndarray) -> np.ndarray:
        return v if self.turn is None else v @ self.turn

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster of each row, and its distance from the centre, rounded up."""
        t = self.turned(v)
        cluster = np.empty(len(t), np.int64)
        for a in range(0, len(t), 4096):
            part = t[a : a + 4096]
            cluster[a : a + 4096] = ((self.centres**2).sum(1) - 2 * part @ self.centres.T).argmin(1)
        return cluster, np.linalg.norm(t - self.centres[cluster], axis=1) * (1 + ROUNDING) + 1e-9


def fit_space(sample: np.ndarray, axes: int, clusters: int) -> Space:
    turn = None
    if 1 < axes <= MOST_AXES and len(sample) > 1:
        scale = max(1.0, float(np.abs(sample).max()))
        values, vectors = np.linalg.eigh((sample / scale).T @ (sample / scale))
        turn = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")])
    points = sample if turn is None else sample @ turn
    if not len(points):
        return Space(axes, turn, np.zeros((1, axes)))
    centres = points[np.linspace(0, len(points) - 1, min(clusters, len(points))).astype(int)].copy()
    for _ in range(12 if len(centres) > 1 else 1):
        own = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return Space(axes, turn, centres)


def search_cell(space: Space, qi: np.ndarray, q: np.ndarray, limits: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int, tally: dict | None = None):
    """Each query's k best (query_id, vec_id, score) of a block that may reach its limit, and the limits that follow.

    q and x are integers in doubles, of ``space.axes`` columns; a limit is a score that the k-th best of all reaches at least.
    """
    qt, xt = space.turned(q), space.turned(x)
    levels = [edges_of(space.axes, h) for h in HEADS if h < space.axes]
    qf, xf = [segment_features(qt, e) for e in levels], [segment_features(xt, e) for e in levels]
    slack = ROUNDING * (np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0) + 1)
    limits, out = limits.copy(), []
    tile, some = most_rows(TILE, 2 * k * space.axes), most_rows(65_536, space.axes)
    for a in range(0, len(q), tile):
        at = np.arange(a, min(a + tile, len(q)))
        low = (limits[at] - slack[at])[:, None]
        alive = np.arange(len(x))
        for qs, xs in zip(qf, xf, strict=True):  # a row stays while any query of the tile may want it
            bound = qs[at] @ xs[alive].T
            if len(alive) > 2 * k and not np.isfinite(low).all():  # scores of the most promising rows are a first limit
                first = alive[np.argpartition(bound, len(alive) - 2 * k, axis=1)[:, -2 * k :]]
                known = np.einsum("ij,ikj->ik", qt[at], xt[first])
                known[qi[at][:, None] == xi[first]] = -np.inf
                low = np.maximum(low, np.partition(known, k, axis=1)[:, [k]] - 2 * slack[at][:, None])
            alive = alive[(bound >= low).any(0)]
        score = qt[at] @ xt[alive].T
        score[qi[at][:, None] == xi[alive]] = -np.inf  # its own row is no candidate
        if tally is not None:
            tally["scored"] = tally.get("scored", 0) + score.size
            tally["pairs"] = tally.get("pairs", 0) + len(at) * len(x)
        if len(alive) > k:
            low = np.maximum(low, np.partition(score, len(alive) - k, axis=1)[:, [len(alive) - k]] - 2 * slack[at][:, None])
        i, j = np.nonzero((score >= low) & ~np.isneginf(score))
        exact = np.concatenate([np.zeros(0, np.int64), *(exact_scores(q[at[i[b : b + some]]], x[alive[j[b : b + some]]]) for b in range(0, len(i), some))])
        order = np.lexsort((xi[alive[j]], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i, "left")
        last = place == k - 1
        limits[at[i[last]]] = np.maximum(limits[at[i[last]]], exact[last].astype(np.float64))
        best = place < k
        out.append((qi[at[i[best]]], xi[alive[j[best]]], exact[best]))
    hits = tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return hits, limits


def promising(space: Space, radii: np.ndarray, q: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """(query, cluster): whether a row of the cluster may reach the query's limit."""
    t, norm = space.turned(q), np.linalg.norm(q, axis=1)
    reach = t @ space.centres.T + norm[:, None] * radii
    room = ROUNDING * (norm[:, None] * (np.linalg.norm(space.centres, axis=1) + np.maximum(radii, 0)) + 1)
    return (radii >= 0) & (reach + room >= limits[:, None])


def narrow(v: np.ndarray) -> bytes:
    """Integers in doubles in the fewest bytes that hold them all; ``_matrix`` knows the kind by the length."""
    most = float(np.abs(v).max(initial=0))
    return v.astype(next((kind for kind, room in (("<i1", 2**7), ("<i2", 2**15), ("<i4", 2**31)) if most < room), "<f8")).tobytes()


def _matrix(raw: bytes, n: int, axes: int) -> np.ndarray:
    kind = {1: "<i1", 2: "<i2", 4: "<i4"}.get(len(raw) // max(1, n * axes), "<f8")
    return np.frombuffer(raw, kind).reshape(n, axes).astype(np.float64)


def _mapped(df: DataFrame, step, schema: str) -> DataFrame:
    """step(row as a dict) yields Arrow tables for every row of df, one row after the other, as rows are whole blocks."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                for made in step({n: batch.column(c)[k].as_py() for c, n in enumerate(batch.schema.names)}):
                    yield from made.to_batches()
        release()

    return df.mapInArrow(run, schema)


def _packed(rows: DataFrame, axes: int) -> DataFrame:
    """One row a block: block, ids, and vectors of ``axes`` columns as ``narrow`` writes them; ids ascend."""

    def pack(t: pa.Table) -> pa.Table:
        ids, v = t.column("vec_id").to_numpy(), padded(t.column("v"), axes)
        order = np.argsort(ids)
        return pa.table({"block": t.column("block")[:1], "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "v": pa.array([narrow(v[order])], pa.binary())})

    return rows.select("block", "vec_id", "v").groupBy("block").applyInArrow(pack, "block long, ids binary, v binary")


def padded(column, axes: int) -> np.ndarray:
    """Lists of doubles as rows of ``axes`` columns, with zeros behind the shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), axes))
    out[np.arange(axes) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _space_of(rows: DataFrame) -> tuple[Space, int]:
    """The space of rows (vec_id, v), fitted on about SAMPLE of them at most by hash of vec_id, and how many rows there are."""
    n, axes = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    axes = max(1, axes)
    few = max(1, min(SAMPLE, SAMPLE_NUMBERS // axes))
    sample = sorted(some_rows(rows, few, "sample", "vec_id").collect(), key=lambda r: r.vec_id)
    points = np.zeros((len(sample), axes))
    for k, r in enumerate(sample):
        points[k, : len(r.v)] = r.v
    return fit_space(quantized(points), axes, max(1, min(CLUSTERS, -(-n // CANDIDATES)))), n


def top_k(vectors: DataFrame, wanted, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for every row (vec_id, v) that ``wanted`` holds for, the k others with the highest scores."""
    space, _ = _space_of(vectors)
    axes = space.axes

    def assign(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, most_rows(CANDIDATES, axes)):
                ids, lists = (c.slice(a, most_rows(CANDIDATES, axes)) for c in batch.columns)
                cluster, far = space.nearest(quantized(padded(lists, axes)))
                ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(quantized(lists.flatten().to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays([ids, lists, pa.array(cluster), pa.array(far)], names=["vec_id", "v", "cluster", "far"])

    bounded_batches(vectors.sparkSession)
    rows = materialize(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, cluster long, far double"), "vectors", **WRITTEN)
    counts, asked, radii = np.zeros(len(space.centres), int), np.zeros(len(space.centres), int), np.full(len(space.centres), -1.0)
    for r in rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.when(wanted, 1).otherwise(0)).alias("nq"), F.max("far").alias("far")).collect():  # a row a cluster
        counts[r.cluster], asked[r.cluster], radii[r.cluster] = r.n, r.nq, r.far

    def blocks(sizes: np.ndarray, most: int) -> list[int]:
        return [max(1, -(-int(n) // most)) for n in sizes]

    def block(parts: list[int]):
        n = F.element_at(F.array(*map(F.lit, parts)), (F.col("cluster") + 1).cast("int"))
        return F.shiftleft(F.col("cluster"), 32) + F.pmod(F.xxhash64(F.lit("block"), "vec_id"), n)

    parts = blocks(counts, most_rows(CANDIDATES, axes))
    # Never broadcast, whatever the session's threshold: blocks would pass through the driver.
    right = materialize(_packed(rows.withColumn("block", block(parts)), axes), "vector-blocks", **WRITTEN).toDF("block", "xi", "x").hint("merge")
    left = _packed(rows.where(wanted).withColumn("block", block(blocks(asked, most_rows(QUERIES, axes)))), axes).toDF("qb", "ids", "v")

    def first(row: dict):
        qi, xi = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["xi"] or b"", "<i8")
        x = _matrix(row["x"], len(xi), axes) if len(xi) else np.zeros((0, axes))
        hits, limits = search_cell(space, qi, _matrix(row["v"], len(qi), axes), np.full(len(qi), -np.inf), xi, x, k)
        blob = lambda a, kind: pa.array([a.astype(kind).tobytes()], pa.binary())
        yield pa.table({
            "cluster": pa.array([row["block"] >> 32]), "ids": pa.array([row["ids"]], pa.binary()), "v": pa.array([row["v"]], pa.binary()), "limits": blob(limits, "<f8"),
            "hit_q": blob(hits[0], "<i8"), "hit_x": blob(hits[1], "<i8"), "hit_s": blob(hits[2], "<i8"),
        })

    own = left.withColumn("block", F.shiftleft(F.shiftright("qb", 32), 32)).join(right, "block", "left")
    begun = materialize(_mapped(own, first, "cluster long, ids binary, v binary, limits binary, hit_q binary, hit_x binary, hit_s binary"), "vector-first", **WRITTEN)

    def deal(row: dict):
        qi, limits = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["limits"], "<f8")
        q = _matrix(row["v"], len(qi), axes)
        fine = promising(space, radii, q, limits)
        for c in np.flatnonzero(fine.any(0)).tolist():
            at = fine[:, c]
            made = {"ids": pa.array([qi[at].tobytes()], pa.binary()), "v": pa.array([narrow(q[at])], pa.binary()), "limits": pa.array([limits[at].tobytes()], pa.binary())}
            for sub in range(int(c == row["cluster"]), parts[c]):
                yield pa.table({"block": pa.array([(c << 32) + sub]), **made})

    cells = _mapped(begun.select("cluster", "ids", "v", "limits"), deal, "block long, ids binary, v binary, limits binary").join(right, "block")

    def further(row: dict):
        qi, xi = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["xi"], "<i8")
        hits, _ = search_cell(space, qi, _matrix(row["v"], len(qi), axes), np.frombuffer(row["limits"], "<f8"), xi, _matrix(row["x"], len(xi), axes), k)
        yield pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, hits), strict=True)))

    def known(row: dict):
        yield pa.table({n: pa.array(np.frombuffer(row[c], "<i8")) for n, c in (("query_id", "hit_q"), ("vec_id", "hit_x"), ("score", "hit_s"))})

    hit = "query_id long, vec_id long, score long"
    best = _mapped(begun.select("hit_q", "hit_x", "hit_s"), known, hit).unionByName(_mapped(cells, further, hit))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_report(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """The registered search: queries are the rows whose vec_id is divisible by ``every``, against all rows."""
    rows = materialize(finite_rows(vectors), "vectors-finite", **WRITTEN)
    return top_k(rows, F.pmod("vec_id", F.lit(every)) == 0, k)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
) WHERE rank <= 20
"""
