"""Near-duplicates by similarity: SimHash fingerprints of shingle sets in Gray-order indexes, links checked on the shingles themselves.

At a Jaccard similarity of 0.8 about 15 % of fingerprint bits differ, too many for the blocks of ``simhash`` to find with certainty. So rows
are dealt by ``BANDS`` keys, each of ``ROWS`` smallest shingle hashes; a pair at the threshold agrees on one with a chance of 0.987, whatever the
number of documents. Inside a key, rows come in Gray order of a fingerprint word; the index of ``simhash`` shares masked bit patterns among
neighbours, prunes whole groups by the differences that add up, and the other words confine what is left. A key that many rows share (a
crowd of near copies, or of a shared passage) is cut by further fingerprint bits, as many times over, by other bits, as leave similar pairs
together in one of the cuts; what is still crowded then, rows that agree on those bits too, is dealt by hash, in each band and cut anew.
That is quick but leaves some pairs apart. So once its links are settled, every crowded key whose rows are not yet one group is searched whole, in
pieces for any two parts of it: no pair that shares a key and looks similar is left out. Its work grows with the square of such a key's rows.

Of each piece the minimum spanning forest by differing bits leaves the task, and its links are checked on the sets of shingles. Where links fail,
the parts that they would have joined are searched again, for the nearest pairs across and each time for 64 times as many, until the parts are
joined by a checked link or no candidate across is unchecked. So every candidate is checked, or joined by links that were.

Defined cases: texts of equal shingle sets are one group, compared by a 64-bit digest; a null or empty text has no shingles and equals others like
it; rows without a doc_id stay; rows that repeat a doc_id are one document, whose texts link; an empty table gives an empty result; all columns
are kept. Sets are compared through 32 bits of each shingle's hash.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import map_rows, materialize, utf8
from docspark.llm.simhash import BATCH, _gray_rank, components, index_links

#: Keys of a document and smallest hashes of a key: a pair of similarity s meets with a chance of 1 - (1 - s ** ROWS) ** BANDS.
BANDS, ROWS = 6, 3
#: Words of a fingerprint.
WORDS = 8
#: Rows of a key beyond which it is cut, and the share of its similar pairs that some cut leaves together.
PIECE, CUT_RECALL = 1024, 0.99
#: Deviations beyond the expected differing bits that candidates may show, in the word of the index and in all words.
WORD_SLACK, SLACK = 3.5, 2.5
#: Pairs across two parts in the first further search; each next one takes so many times more.
QUOTA = 64
#: Ids are broadcast only after they were counted and found to be at most this many.
BROADCAST_IDS = 200_000
#: Pairs held by a task before only their forest is kept.
HELD = 2_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of so many words, A-Z lower-cased; of the whole sequence if it is shorter; none without words."""
    found = text.lower().split()
    n = max(1, len(found) - words + 1) if found else 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)) if found else ends
    last = ends[min(words, len(found)) - 1 :] if found else ends
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def wide_fingerprint(hashes: np.ndarray, count: int = WORDS) -> list[int]:
    """``count`` signed 64-bit words of a set of hashes; a bit is set if it is in over half of them, mixed anew for each word."""
    if not len(hashes):
        return [0] * count
    out = []
    for w in range(count):
        counts = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 16_384):
            h = hashes[k : k + 16_384] + np.uint64(int(_MIX[0]) * w % 2**64)
            h = (h ^ (h >> np.uint64(30))) * _MIX[1]
            h = (h ^ (h >> np.uint64(27))) * _MIX[2]
            h ^= h >> np.uint64(31)
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0]))
    return out


@functools.cache
def _turns(bands: int, rows: int) -> list[np.uint64]:
    """Odd multipliers, one for each order in which the smallest hash is taken."""
    return [np.uint64(xxhash.xxh64_intdigest(b"turn", k) | 1) for k in range(bands * rows)]


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> list[int]:
    """A signed 64-bit key for each band: a digest of the smallest members of the set in ``rows`` orders of its own."""
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX[2]
    mixed ^= mixed >> np.uint64(29)
    least = [int((mixed * t).min()).to_bytes(8, "little") for t in _turns(bands, rows)]
    each = [xxhash.xxh64_intdigest(b"".join(least[rows * b : rows * (b + 1)]), b) for b in range(bands)]
    return [k - (k >> 63 << 64) for k in each]


def set_digest(hashes: np.ndarray) -> int:
    """Signed 64-bit digest of a sorted set of hashes."""
    h = xxhash.xxh64_intdigest(hashes.astype("<u8", copy=False).tobytes(), 1)
    return h - (h >> 63 << 64)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two documents of equal size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_differing(bits: int, similarity: float, slack: float) -> int:
    """Differing bits, of so many, that a pair of this similarity hardly ever exceeds."""
    share = differing_share(similarity)
    return min(bits, int(bits * share + slack * math.sqrt(bits * share * (1 - share))))


def _window(start: str):
    """64 bits of the words w from bit ``start`` (an SQL expression) on, the first word after the last."""
    at = f"(({start}) % {64 * WORDS})"
    return F.expr(f"shiftleft(w[int({at} div 64)], int({at} % 64)) | shiftrightunsigned(shiftrightunsigned(w[int({at} div 64 + 1) % {WORDS}], 1), 63 - int({at} % 64))")


def nearest_forest(n: int, i: np.ndarray, j: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Places of the links (i, j) among n rows that make up their minimum spanning forest by ``differ``.

    Every part takes its nearest link to another part, all at once, until none is left; ties go by place, so that no ring can close.
    """
    order = np.argsort(differ, kind="stable")
    a, b = i[order], j[order]
    part, open_, out = np.arange(n), np.arange(len(order)), []
    while True:
        pa_, pb = part[a[open_]], part[b[open_]]
        across = pa_ != pb
        open_, pa_, pb = open_[across], pa_[across], pb[across]
        if not len(open_):
            return order[np.concatenate(out)] if out else np.zeros(0, np.int64)
        best = np.full(n, len(order))
        np.minimum.at(best, pa_, open_)
        np.minimum.at(best, pb, open_)
        taken = np.unique(best[best < len(order)])
        out.append(taken)
        x, y = part[a[taken]], part[b[taken]]
        lead = np.arange(n)
        while True:  # the smallest part that the taken links reach leads
            low = np.minimum(lead[x], lead[y])
            if (lead[x] == lead[y]).all():
                break
            np.minimum.at(lead, lead[x], low)
            np.minimum.at(lead, lead[y], low)
            while (lead[lead] != lead).any():
                lead = lead[lead]
        part = lead[part]


def nearest_across(la: np.ndarray, lb: np.ndarray, differ: np.ndarray, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``quota`` nearest links for each pair of labels (la < lb), and whether that pair has more."""
    order = np.lexsort((differ, lb, la))
    a, b = la[order], lb[order]
    head = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    starts = np.flatnonzero(head)
    sizes = np.diff(np.concatenate((starts, [len(order)])))
    inside = np.arange(len(order)) - np.repeat(starts, sizes) < quota
    return order[inside], np.repeat(sizes > quota, sizes)[inside]


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("more", T.BooleanType())])


def _search(batches, similarity: float, quota: int):
    """Arrow batches of (band, key, r, node, label, n, words...), sorted, in; links (a, b, more) between nodes out.

    Without a quota, the forest of each group; else the nearest links across each pair of labels, and whether there are more.
    """
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("more", pa.bool_())])
    near_word, near = most_differing(64, similarity, WORD_SLACK), most_differing(64 * WORDS, similarity, SLACK)

    def links(rows: list[np.ndarray]):
        band, key, r, node, label, size, *words = rows
        group = np.concatenate(([0], np.cumsum((band[1:] != band[:-1]) | (key[1:] != key[:-1]))))
        rank = r.view(np.uint64)
        words = [w.view(np.uint64) for w in words]
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]

        def kept(i, j, differ, more):
            if not quota:
                k = nearest_forest(len(node), i, j, differ)
                return [i[k], j[k], differ[k], more[k]]
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            k, beyond = nearest_across(low, high, differ, quota)
            return [i[k], j[k], differ[k], more[k] | beyond]

        for i, j in index_links(group, rank ^ (rank >> np.uint64(1)), near_word):
            fine = (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
            i, j = i[fine], j[fine]
            differ = np.zeros(len(i), np.int64)
            for w in words:
                differ += np.bitwise_count(w[i] ^ w[j])
            fine = differ <= near
            held = [np.concatenate((x, y)) for x, y in zip(held, (i[fine], j[fine], differ[fine], np.zeros(int(fine.sum()), bool)), strict=True)]
            if len(held[0]) > HELD:
                held = kept(*held)
        if len(held[0]):
            i, j, _, more = kept(*held)
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(more)], schema=arrow)

    pending: list[list[np.ndarray]] = []
    for batch in batches:
        pending.append([batch.column(k).to_numpy() for k in range(batch.num_columns)])
        if sum(len(x[0]) for x in pending) >= BATCH // 4:
            rows = [np.concatenate(x) for x in zip(*pending, strict=True)]
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            end = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if end:
                yield from links([x[:end] for x in rows])
            pending = [[x[end:] for x in rows]]
    if pending and len(pending[0][0]):
        yield from links([np.concatenate(x) for x in zip(*pending, strict=True)])


def _few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it was counted and found small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _ids_join(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined with a written table of ids (__llm_id); the ids are broadcast only if counted as few."""
    return docs.join(_few(ids), docs["doc_id"].cast("long") == F.col("__llm_id"), how)


def _banded(nodes: DataFrame) -> DataFrame:
    """nodes with shingles, once for each band: band, key."""
    return nodes.where("n > 0").select("*", F.posexplode("keys").alias("band", "key")).drop("keys")


def _cut(each: DataFrame, crowded: DataFrame) -> DataFrame:
    """Banded nodes with what the cuts of crowded keys make of band and key."""
    each = each.join(_few(crowded), ["band", "key"], "left")
    each = each.withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1)))
    # Every cut is by bits that no other cut of its band has, while there are as many.
    part = F.when(F.col("more") > 0, F.expr("shiftrightunsigned(at, 64 - more)")).otherwise(F.lit(0).cast("long"))
    each = each.withColumn("at", _window("64 * band + cut * coalesce(more, 0)")).withColumn("part", part)
    dealt = F.when(F.col("more").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part"))
    return each.withColumn("band0", F.col("band")).withColumn("key", dealt).withColumn("band", F.col("band") + F.lit(BANDS) * F.col("cut"))


def crowds(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """The keys of over PIECE nodes: (band, key, more, cuts), by how many further bits each is cut, and how many times over; and of the
    pieces that are still crowded, (band, key, salts), among how many each is dealt. Counts of keys are summed up before they are shuffled.

    A cut by ``more`` bits leaves a similar pair together with probability (1 - share)^more; there are as many as leave CUT_RECALL.
    """
    counted = _banded(nodes.select("node", "n", "keys")).groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > PIECE)
    more = F.least(F.lit(31), F.ceil(F.log2(F.col("n") / PIECE)).cast("int")).alias("more")
    stays = F.pow(F.lit(1 - differing_share(similarity)), F.col("more"))
    cuts = F.ceil(F.lit(math.log(1 - CUT_RECALL)) / F.log(1 - stays)).cast("int").alias("cuts")
    crowded = materialize(counted.select("band", "key", more).select("band", "key", "more", cuts), "near-crowds")
    if crowded.isEmpty():
        return crowded, None
    dense = _cut(_banded(nodes.select("node", "n", "w", "keys")), crowded).where("more IS NOT NULL").groupBy("band", "key").agg(F.count("*").alias("n"))
    dense = dense.where(F.col("n") > 4 * PIECE).select("band", "key", F.ceil(F.col("n") / PIECE).cast("int").alias("salts"))
    return crowded, materialize(dense, "near-dense")


def _by_twos(each: DataFrame, crowded: DataFrame) -> DataFrame:
    """Banded nodes of the crowded keys that hold more than one label, dealt so that any two of unlike labels meet in some piece.

    The rows of a key fall in parts of about PIECE, those of its largest label in parts of their own; every two parts are a piece, but
    not two of the largest label.
    """
    each = each.join(_few(crowded.select("band", "key")), ["band", "key"], "left_semi")
    counted = each.groupBy("band", "key", "label").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"))
    parts = [F.ceil(n / PIECE).cast("int").alias(name) for n, name in ((F.col("n") - F.col("top.n"), "others"), (F.col("top.n"), "tops"))]
    each = each.join(_few(materialize(counted.where("labels > 1").select("band", "key", F.col("top.label").alias("top"), *parts), "near-unlike")), ["band", "key"])
    place, in_top = F.xxhash64("node", "band"), F.col("label") == F.col("top")
    each = each.withColumn("part", F.when(in_top, F.col("others") + F.pmod(place, F.col("tops"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    meets = F.sequence(F.lit(0), F.col("others") - 1 + F.when(in_top, 0).otherwise(F.col("tops")))
    each = each.withColumn("other", F.explode(meets)).where("other <> part")
    return each.withColumn("band0", F.col("band")).withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))


def candidate_links(nodes: DataFrame, cuts: tuple[DataFrame, DataFrame | None], similarity: float, quota: int = 0, whole: bool = False) -> DataFrame:
    """(a, b, more), a < b: links between nodes (node, label, n, w, keys) of different labels that look similar.

    A forest of them for each piece, or with a quota the nearest for each pair of labels in a piece, and whether some piece had more.
    Crowded keys are cut and dealt, or (``whole``) they alone are searched, without leaving out any pair.
    """
    crowded, dense = cuts
    each = _banded(nodes.select("node", "label", "n", "w", "keys"))
    if whole:
        each = _by_twos(each, crowded)
    else:
        each = each.withColumn("band0", F.col("band")) if dense is None else _cut(each, crowded)
    if dense is not None and not whole:
        each = each.join(_few(dense), ["band", "key"], "left")
        salt = F.pmod(F.xxhash64("node", "band"), F.col("salts"))
        each = each.withColumn("key", F.when(F.col("salts").isNull(), F.col("key")).otherwise(F.xxhash64("key", salt)))
    word = F.expr(f"w[band0 % {WORDS}]")
    dealt = each.select("band", "key", _gray_rank(word).alias("r"), "node", "label", F.col("n").cast("long").alias("n"), *[F.col("w")[k].alias(f"w{k}") for k in range(WORDS)])
    found = dealt.repartition("band", "key").sortWithinPartitions("band", "key", "r").mapInArrow(lambda b: _search(b, similarity, quota), _LINKS)
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("more").alias("more"))


def _sets(ids: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, s): the shingles of nodes (node, least), as sorted 32-bit hashes, from the texts of the documents that stand for them."""
    wanted = materialize(wanted.select("node", F.col("least").alias("__llm_id")), "near-ends")

    def sets():
        def step(batch):
            for text in utf8(batch["text"]):
                hashes = np.unique(shingle_hashes(text, words))
                yield set_digest(hashes), np.unique(hashes.astype("<u4")).tobytes()

        return step

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("s", T.BinaryType())])
    texts = map_rows(_ids_join(ids, wanted.select("__llm_id"), "left_semi"), sets, schema, 256)
    return materialize(texts.join(_few(wanted.select("node")), "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")), "near-sets")


def _checked(shingles: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """(a, b, same): whether the shingles of linked nodes are similar."""
    both = links.select("a", "b").join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b")

    def compare():
        def step(batch):
            for a, b, sa, sb in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["sa"], batch["sb"], strict=True):
                x, y = np.frombuffer(sa.as_buffer(), "<u4"), np.frombuffer(sb.as_buffer(), "<u4")
                same = len(np.intersect1d(x, y, assume_unique=True))
                yield a, b, bool(same >= similarity * (len(x) + len(y) - same) - 1e-9)

        return step

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("same", T.BooleanType())])
    return materialize(map_rows(both, compare, schema), "near-checked")


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with their label; one that has none is its own."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _linked(ids: DataFrame, nodes: DataFrame, also: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, label) of the nodes that links of sufficient similarity, or those of ``also``, join to others."""
    cuts = crowds(nodes, similarity)
    true, labels, checked, shingles = also, None, None, None
    for whole in (False, True) if cuts[1] is not None else (False,):
        of = nodes.withColumn("label", F.col("node")) if labels is None else _labelled(nodes, labels)
        links = materialize(candidate_links(of, cuts, similarity, whole=whole), "near-candidates")
        if whole and links.isEmpty():
            break
        linked = links.select("a", "b") if whole else links.select("a", "b").unionByName(also)
        ends = linked.select(F.col("a").alias("node")).unionByName(linked.select(F.col("b").alias("node"))).distinct()
        if shingles is None:
            shingles = _sets(ids, nodes.join(ends, "node"), words)
        else:
            shingles = shingles.unionByName(_sets(ids, nodes.join(ends.join(_few(shingles.select("node")), "node", "left_anti"), "node"), words))
        answers = _checked(shingles, links, similarity)
        checked = answers if checked is None else checked.unionByName(answers)
        true = true.unionByName(answers.where("same").select("a", "b"))
        labels = components(true)
        pending, quota = answers.where("NOT same"), QUOTA
        while True:
            of = _labelled(nodes, labels)
            at = materialize(of.join(_few(shingles.select("node")), "node", "left_semi").select("node", "label"), "near-at")
            apart = pending.select("a", "b").join(_few(at.toDF("a", "la")), "a").join(_few(at.toDF("b", "lb")), "b").where("la <> lb")
            apart = materialize(apart.select(F.explode(F.array("la", "lb")).alias("label")).distinct(), "near-apart")
            if apart.isEmpty():
                break
            found = materialize(candidate_links(of.join(_few(apart), "label", "left_semi"), cuts, similarity, quota, whole), "near-again")
            new = materialize(found.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "near-skipped")
            if not new.isEmpty():  # its ends are ends of failed or true links, so their sets are there
                answers = _checked(shingles, new, similarity)
                checked = checked.unionByName(answers)
                true = true.unionByName(answers.where("same").select("a", "b"))
                labels = components(true)
            pending, quota = found.where("more"), quota * QUOTA
    return labels


def near_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): for documents with an id, the smallest doc_id of their group of near copies."""
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bands, rows = BANDS, ROWS

    def make():
        def step(batch):
            for d, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                hashes = np.unique(shingle_hashes(text, words))
                yield d, set_digest(hashes), len(hashes), wide_fingerprint(hashes), band_keys(hashes, bands, rows) if len(hashes) else []

        return step

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", longs), T.StructField("keys", longs)])
    prints = materialize(map_rows(ids, make, schema), "near-prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "n", "w", "keys")).alias("x")).select("node", F.col("x.doc_id").alias("least"), "x.n", "x.w", "x.keys")
    nodes = materialize(nodes, "near-nodes")
    # Texts of one doc_id link: all to the smallest node.
    several = prints.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    also = prints.select("doc_id", F.col("node").alias("b")).join(several, "doc_id").where("a <> b").select("a", "b").distinct()
    labels = _linked(ids, nodes, materialize(also, "near-same-id"), words, similarity)

    named = labels.join(nodes.select("node", "least"), "node")
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "near-least")
    linked = materialize(named.join(least, "label").select("node", "component_id"), "near-linked")
    # Written, so that the join below has plain exchanges on both sides and a text that thousands share can be split.
    of = materialize(nodes.select("node", "least").join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "near-classes")
    return prints.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; all columns kept."""
    gone = materialize(near_classes(docs, words, similarity).where("doc_id <> component_id").select(F.col("doc_id").alias("__llm_id")).distinct(), "near-gone")
    return _ids_join(docs, gone, "left_anti")
