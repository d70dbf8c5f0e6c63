"""SimHash near-duplicates: fingerprints of word shingles, linked within a few bits by a Gray-order hierarchical index.

Equal fingerprints are one node. Two fingerprints that differ in at most two of four 16-bit blocks' worth of bits agree on two whole
blocks, so each goes to the six pairs of blocks, moved to the front of the word. A group that shares a pair of blocks is still large
only where near copies crowd; such groups are divided once more by two of the four bytes among the remaining 32 bits. After that a
group has at most 65,536 members, whatever the data, and no row was left out.

Rows reach a task sorted by Gray rank, so that neighbours differ in few bits. There an index is built upwards over each group: a node
holds the bits that all below it share and its parent does not (mask and pattern). Searching starts at the group's root with all
its members; the differences to the patterns add up on the way down and whole nodes are pruned once the sum exceeds the limit.

Only a spanning forest of the links found leaves a task. Components are found by contracting links to labels, tables written to the shared
folder between rounds, until the links are few enough for one task.

Defined cases: a null or empty text, or one without words, has fingerprint 0 and is linked like any other; a null doc_id is answered,
but gives no component its name unless no other does (then null); rows that repeat a doc_id are nodes of their own text; an empty
table gives an empty result; other columns are carried by ``keep_one`` and ignored by the report.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import map_rows, materialize, utf8

SEED = 42
#: Groups of more than this many fingerprints are divided again.
CROWD = 512
#: Children of an index node; rows of a task's batch; pairs looked at together.
FAN, BATCH, FRONTIER = 8, 200_000, 2_000_000
#: Links that one task may solve.
SMALL = 1_000_000

_LAST = 2**63 - 1


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of a text, A-Z lower-cased: a bit is set if it is in over half of the hashes."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(found) - words + 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 16_384):
        part = hashes[k : k + 16_384].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int, *more: str) -> DataFrame:
    """doc_id and fp (the bits as a signed long) of every row, written once."""

    def make():
        def step(batch):
            for d, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                fp = fingerprint(text, words)
                yield d, fp - (fp >> 63 << 64)

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    return materialize(map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema), "simhash")


def _moved(bits, chosen: tuple[int, ...], width: int, start: int):
    """bits with the chosen fields of ``width`` bits, counted from bit 64 - start down, put right behind the first ``start`` bits."""
    n = (64 - start) // width
    order = [*chosen, *(k for k in range(n) if k not in chosen)]
    mask = (1 << width) - 1
    out = bits.bitwiseAND(F.lit(-1 << (64 - start) if start else 0)) if start else F.lit(0).cast("long")
    for place, k in enumerate(order):
        field = F.shiftrightunsigned(bits, 64 - start - width * (k + 1)).bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(field, 64 - start - width * (place + 1)))
    return out


def _gray_rank(bits):
    """Place of a word in the order of the reflected Gray code: each bit becomes the parity of the bits down to it."""
    for s in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, s))
    return bits


_PAIRS = list(itertools.combinations(range(4), 2))


def _groups(nodes: DataFrame) -> DataFrame:
    """(g, r, node): each node once in every group it belongs to; r is the Gray rank of its bits with the group's shared bits first."""
    each = nodes.select("node", F.explode(F.array(*[F.struct(F.lit(k).alias("g"), _moved(F.col("fp"), p, 16, 0).alias("m")) for k, p in enumerate(_PAIRS)])).alias("x")).select("node", "x.g", "x.m")
    each = each.withColumn("key", F.shiftrightunsigned("m", 32))
    crowded = materialize(each.groupBy("g", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("g", "key", F.lit(True).alias("crowd")), "simhash-crowds")
    # Every crowd holds over CROWD rows: there are at most 6 * nodes / CROWD. Spark chooses the join by the written size.
    each = each.join(crowded, ["g", "key"], "left")
    plain = each.where("crowd IS NULL").select("g", F.col("key"), "m", "node")
    again = each.where("crowd").select("node", "g", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _moved(F.col("m"), p, 8, 32).alias("m")) for k, p in enumerate(_PAIRS)])).alias("x"))
    again = again.select(((F.col("g") + 1) * 6 + F.col("x.k")).alias("g"), F.shiftrightunsigned("x.m", 16).alias("key"), F.col("x.m").alias("m"), "node")
    return plain.unionByName(again).select("g", "key", _gray_rank(F.col("m")).alias("r"), "node")


def index_links(group: np.ndarray, bits: np.ndarray, most: int):
    """Pairs (i, j), i < j, of rows of equal group within ``most`` differing bits, in pieces. Rows are sorted by group, then Gray rank.

    Level 0 of the index is the rows; a node of a level covers up to FAN neighbours of one group in the level below, up to one root a
    group. ``mask`` has the bits common to a node's rows beyond those of its parent, ``bits`` their values.
    """
    n = len(bits)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    levels = [(bits, np.full(n, ~np.uint64(0)), np.zeros(n + 1, np.int64), starts)]
    sizes = np.diff(np.concatenate((starts, [n])))
    while True:
        values, common, _, first = levels[-1]
        if (sizes <= 1).all() and len(levels) > 1:
            break
        total = len(values)
        inside = np.arange(total) - np.repeat(first, sizes)
        heads = np.flatnonzero(inside % FAN == 0)
        ones = np.bitwise_and.reduceat(values & common, heads)
        zeros = np.bitwise_and.reduceat(~values & common, heads)
        up = (sizes + FAN - 1) // FAN
        levels.append((ones, ones | zeros, np.concatenate((heads, [total])), np.cumsum(up) - up))
        sizes = up
    residual = [levels[-1][1]]
    for k in range(len(levels) - 2, -1, -1):  # what a parent shares isn't counted again below it
        heads = levels[k + 1][2]
        residual.append(levels[k][1] & ~np.repeat(levels[k + 1][1], np.diff(heads)))
    residual.reverse()
    group_of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [n]))))
    alone = np.diff(np.concatenate((starts, [n])))[group_of] == 1
    queries = np.flatnonzero(~alone)
    for a in range(0, len(queries), BATCH // 8):
        q = queries[a : a + BATCH // 8]
        stack = [(len(levels) - 1, q, group_of[q], np.zeros(len(q), np.int64))]
        while stack:
            level, q, node, before = stack.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                stack += [(level, q[:half], node[:half], before[:half]), (level, q[half:], node[half:], before[half:])]
                continue
            differ = before + np.bitwise_count((bits[q] ^ levels[level][0][node]) & residual[level][node])
            near = differ <= most
            q, node, differ = q[near], node[near], differ[near]
            if level == 0:
                later = node > q
                if later.any():
                    yield q[later], node[later]
            elif len(q):
                heads = levels[level][2]
                kids = heads[node + 1] - heads[node]
                child = np.repeat(heads[node], kids) + np.arange(kids.sum()) - np.repeat(np.cumsum(kids) - kids, kids)
                q, differ = np.repeat(q, kids), np.repeat(differ, kids)
                last = child if level == 1 else levels[level - 1][2][child + 1]
                stack.append((level - 1, q, child, differ) if level > 1 else (0, *(x[last > q] for x in (q, child, differ))))


def forest(n: int, pieces) -> list[tuple[int, int]]:
    """A spanning forest of the given links among n rows, as (row, smaller row) pairs."""
    from itertools import chain

    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in chain.from_iterable(zip(x.tolist(), y.tolist(), strict=True) for x, y in pieces):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _search(batches, most: int):
    """Arrow batches of (g, key, r, node), sorted, in; links between nodes out. Whole groups are searched, many at a time."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(g, key, r, node):
        change = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        group = np.concatenate(([0], np.cumsum(change)))
        rank = r.view(np.uint64)
        found = forest(len(rank), index_links(group, rank ^ (rank >> np.uint64(1)), most))
        if found:
            i, j = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], schema=arrow)

    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(4)])
        if sum(len(x[0]) for x in held) >= BATCH:
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            g, key = rows[0], rows[1]
            last = np.flatnonzero((g != g[-1]) | (key != key[-1]))
            end = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if end:
                yield from links(*(x[:end] for x in rows))
            held = [[x[end:] for x in rows]]
    if held and sum(len(x[0]) for x in held):
        yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and the smallest node that links reach from each."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    lead = np.arange(len(nodes))
    while True:
        u, v = lead[x], lead[y]
        across = u != v
        if not across.any():
            return nodes, nodes[lead]
        x, y, u, v = x[across], y[across], u[across], v[across]
        low = np.minimum(u, v)
        np.minimum.at(lead, u, low)
        np.minimum.at(lead, v, low)
        while (lead[lead] != lead).any():
            lead = lead[lead]


_LABELS = T.StructType([T.StructField("node", T.LongType()), T.StructField("label", T.LongType())])


def _solved(links: DataFrame) -> DataFrame:
    """Components of links that were counted and found to be few, in one task."""

    def solve(batches):
        held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if held:
            node, label = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
            for k in range(0, len(node), 65_536):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 65_536]), pa.array(label[k : k + 65_536])], names=["node", "label"])

    return links.select("a", "b").coalesce(1).mapInArrow(solve, _LABELS)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, for all nodes with links.

    While links are many, each node takes the smallest label among its neighbours, then the label of its label, and the links go on between
    labels alone: every round leaves half of the nodes at most. Once there are at most SMALL links, one task solves the rest.
    """
    links = materialize(links.where("a <> b").select("a", "b").distinct(), "simhash-links")
    steps = []
    while links.count() > SMALL:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "simhash-near")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = materialize(near.join(jump, "label").select("node", F.col("further").alias("label")), "simhash-labels")
        steps.append(labels)
        between = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la <> lb")
        links = materialize(between.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "simhash-links")
    out = materialize(_solved(links), "simhash-labels")
    for labels in reversed(steps):
        later = labels.join(out.toDF("label", "last"), "label", "left")
        out = materialize(later.select("node", F.coalesce("last", "label").alias("label")), "simhash-labels")
    return out


def node_components(nodes: DataFrame, most: int = 2) -> DataFrame:
    """(node, label) of the nodes (node, fp) that have a link; fp and node are distinct. At most 2 differing bits."""
    if not 0 <= most <= 2:
        raise ValueError("four blocks hold two agreeing ones for up to 2 differing bits")
    dealt = _groups(nodes).repartition("g", "key").sortWithinPartitions("g", "key", "r")
    return components(dealt.mapInArrow(lambda batches: _search(batches, most), _LINKS))


def _classes(prints: DataFrame, most: int) -> DataFrame:
    """(fp, component): the smallest doc_id of the component, for every distinct fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    # A node is named by its smallest doc_id; rows without one, or with one id and several texts, are told apart by the fingerprint.
    named = distinct.select("fp", F.coalesce("least", F.lit(_LAST)).alias("least"))
    labels = node_components(named.select(F.col("fp").alias("node"), "fp"), most)
    whole = labels.join(named.withColumnRenamed("fp", "node"), "node").groupBy("label").agg(F.min("least").alias("least"))
    linked = labels.join(materialize(whole, "simhash-least"), "label").select(F.col("node").alias("fp"), F.col("least").alias("in"))
    out = named.join(linked, "fp", "left").select("fp", F.coalesce("in", "least").alias("c"))
    return materialize(out.select("fp", F.when(F.col("c") != _LAST, F.col("c")).alias("component_id")), "simhash-classes")


def simhash_report(docs: DataFrame, words: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = fingerprints(docs, words)
    return prints.join(_classes(prints, most), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
