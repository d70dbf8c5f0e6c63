"""Removal of long byte strings that an earlier document already holds (suffix-array style, on Burrows-Wheeler transforms).

Every window of ``length`` bytes is answered exactly: it goes if it also starts in a document with a smaller doc_id. Three rounds, each a
shuffle of packed blobs:

1. Texts are packed into batches of a few MB, written once. Of each window the k-byte string with the smallest hash is its anchor; equal
   windows have equal anchors. Batches send their distinct anchor hashes to buckets; a bucket answers, one bit each, which anchors
   more than one document holds, and which so many batches hold that their windows must be dealt one by one.
2. For shared anchors a batch sends each distinct string of neighbouring windows with that anchor once, with the smallest doc_id that
   holds it. A bucket merges equal strings and, over the rest, builds a Burrows-Wheeler transform, from which breadth-first backward
   extension derives common prefixes by increasing value, all intervals of a length at once, and stops at ``length``: the borders
   not found by then separate nothing. Each remaining interval is one repeated window; its smallest doc_id decides. The answer is one bit
   a window: whether a smaller document than the batch's own first one holds it.
3. Batches mark the windows that go and remove the bytes they cover.

So a passage that a third of all documents hold reaches a bucket once a batch, and no bucket gets an unbounded group: the windows of an
anchor that more than ``CROWD`` batches hold are dealt by their own hash, and batches grow with the input, so that at 100 TB there are 3
million of them and as many rows at most for one window.

Defined cases: a null or empty text has nothing to remove; rows with a null doc_id are one document with the largest id; rows that
repeat a doc_id are one document, so they remove nothing from each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import map_rows, materialize, utf8

LENGTH = 50
#: Bytes of an anchor. A window of LENGTH has LENGTH - ANCHOR + 1 of them, which must not exceed 32 (a word of answers a string).
ANCHOR = 20
#: Least bytes of a batch and of a bucket; beyond PARTS of them they grow with the input, up to MOST_BYTES.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
PARTS, MOST_BYTES = 1 << 18, (32 << 20, 64 << 20)
CROWD = 512
#: Bytes looked at together, for anchors and for one transform.
CHUNK, BLOCK = 1 << 15, 1 << 17
LAST = 2**63 - 1

_C1, _C2, _C3, _C4 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a little-endian word; raw is padded by 8 bytes at least."""
    n = len(raw) - 8
    out = np.empty(n + (-n) % 8, np.uint64)
    padded = np.concatenate((raw, np.zeros(16, np.uint8)))
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view("<u8")
    return out[:n]


def _hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each position on."""
    n = len(raw) - ANCHOR + 1
    w = _words(np.concatenate((raw, np.zeros(8, np.uint8))))
    h = w[:n] * _C1
    at, left = 8, ANCHOR - 8
    while left > 0:
        part = w[at : at + n] if left >= 8 else w[at : at + n] & np.uint64((1 << 8 * left) - 1)
        h = (h ^ (h >> np.uint64(29))) * _C2 + part * _C3
        at, left = at + 8, left - 8
    h ^= h >> np.uint64(32)
    h *= _C4
    return h ^ (h >> np.uint64(29))


def anchored(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of one document and one anchor: first window, last window, place and hash of the anchor, document.

    raw: the documents' bytes on end; starts: where each begins, and the end. Of equal hashes in a window the first counts.
    """
    n, w = len(raw), length - ANCHOR + 1
    out = []
    for a in range(0, max(0, n - length + 1), CHUNK):
        b = min(a + CHUNK, n - length + 1)  # windows a..b
        h = _hashes(raw[a : b + length - 1])
        m = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size < w:
            step = min(size, w - size)
            m = np.minimum(m[:-step], m[step:])
            size += step
        place = (m & np.uint64((1 << 20) - 1)).astype(np.int64)
        at = np.arange(a, b)
        doc = np.searchsorted(starts, at, "right") - 1
        whole = at + length <= starts[doc + 1]
        head = np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])))
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(at)])) - 1
        fine = whole[first]
        first, last = first[fine], last[fine]
        out.append((first + a, last + a, place[first] + a, h[place[first]], doc[first]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def repeated_intervals(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of raw, and for each rank whether its suffix shares fewer than ``length`` bytes with that of the rank before.

    The order is exact in the first 64 bytes or more, which is all that borders under ``length`` need.
    """
    n = len(raw)
    big = _words(np.concatenate((raw, np.zeros(8, np.uint8)))).byteswap()
    order = np.argsort(big)
    # The last suffixes end inside their word: each comes before all that go on with NUL where it ends, and equals none.
    tail = np.arange(max(0, n - 7), n)[::-1]
    tail = tail[np.argsort(big[tail], kind="stable")]
    rest = order[order < n - 7]
    order = np.insert(rest, np.searchsorted(big[rest], big[tail]), tail)
    short = order >= n - 7
    depth = 8
    key = big
    while True:
        change = np.concatenate(([False], key[order[1:]] != key[order[:-1]]))
        if depth == 8:
            change[1:] |= short[1:] | short[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        if depth >= length or rank[order[-1]] == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: max(0, n - depth)] = rank[depth:] + 1
        key = (rank * (n + 1) + after).astype(np.uint64)
        order = np.argsort(key)
        depth *= 2
    # Rank 0 is the empty suffix, so that every suffix has a byte before it but the whole text.
    ranked = np.concatenate(([n], order))
    bwt = np.where(ranked > 0, raw[ranked - 1].astype(np.int16), -1)
    before = np.argsort(bwt, kind="stable").astype(np.int32)  # where each rank's suffix without its first byte stands
    heads = np.concatenate(([-1], raw[order].astype(np.int16)))
    full = np.concatenate(([True], heads[1:] != heads[:-1]))
    open_ = np.flatnonzero(~full)
    this, last = before[open_], before[open_ - 1]
    for _ in range(length - 1):
        if not len(open_):
            break
        interval = np.cumsum(full, dtype=np.int32)
        parted = interval[this] != interval[last]
        if parted.any():
            full[open_[parted]] = True
            open_, this, last = (x[~parted] for x in (open_, this, last))
    border = full[1:]
    return order, border


class Strings:
    """Distinct strings of a batch: text, offset of the anchor, smallest document; in the order in which buckets get them."""

    def __init__(self, blob: bytes, ids: np.ndarray, runs, shared: np.ndarray, crowded: np.ndarray, buckets: int, length: int):
        first, last, place, h, doc = runs
        seen: dict[bytes, int] = {}
        offsets: list[int] = []
        route: list[int] = []
        owner, string, window, count = [], [], [], []
        for k in np.flatnonzero(shared).tolist():
            a, b = int(first[k]), int(last[k]) + length
            pieces = [(a, b, int(place[k]) - a)] if not crowded[k] else [(x, x + length, 255) for x in range(a, b - length + 1)]
            for x, y, o in pieces:
                s = blob[x:y]
                j = seen.get(s)
                if j is None:
                    j = seen[s] = len(offsets)
                    offsets.append(o)
                    route.append((int(h[k]) if o != 255 else xxhash.xxh64_intdigest(s)) % buckets)
                owner.append(k)
                string.append(j)
                window.append(x)
                count.append(y - x - length + 1)
        self.string, self.window, self.count = (np.array(x, np.int64) for x in (string, window, count))
        self.doc = ids[doc[np.array(owner, np.int64)]] if owner else np.zeros(0, np.int64)
        self.least = np.full(len(offsets), LAST, np.int64)
        np.minimum.at(self.least, self.string, self.doc)
        self.text, self.offsets = list(seen), np.array(offsets, np.uint8)
        self.route = np.array(route, np.int64)
        self.order = np.argsort(self.route, kind="stable")

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, blob) for each bucket."""
        edges = np.flatnonzero(np.diff(self.route[self.order], prepend=-1))
        for a, b in zip(edges, [*edges[1:], len(self.order)], strict=True):
            rows = self.order[a:b]
            text = [self.text[j] for j in rows.tolist()]
            head = np.array([len(rows)], "<i8").tobytes() + self.least[rows].astype("<i8").tobytes() + self.offsets[rows].tobytes()
            yield int(self.route[rows[0]]), _zip(head + np.array([len(t) for t in text], np.uint8).tobytes() + b"".join(text))


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def answer(requests: list[bytes], length: int) -> list[bytes]:
    """For each request of a bucket a word of bits for each of its strings: windows that a smaller document than the string's holds."""
    texts: list[bytes] = []
    least, offsets, counts = [], [], []
    for blob in map(_unzip, requests):
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        least.append(np.frombuffer(blob, "<i8", n, 8))
        offsets.append(np.frombuffer(blob, np.uint8, n, 8 + 8 * n))
        sizes = np.frombuffer(blob, np.uint8, n, 8 + 9 * n)
        ends = 8 + 10 * n + np.cumsum(sizes, dtype=np.int64)
        texts += [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        counts.append(n)
    own, offset = np.concatenate(least), np.concatenate(offsets).tolist()
    known: dict[bytes, int] = {}
    merged = np.array([known.setdefault(t, len(known)) for t in texts], np.int64)
    text = list(known)
    first = np.full(len(text), LAST, np.int64)
    np.minimum.at(first, merged, own)
    windows = np.repeat(first[:, None], 32, axis=1)  # smallest document of each window of each string
    groups: dict[bytes, list[int]] = {}
    done = set()
    for t, o in zip(texts, offset, strict=True):
        j = known[t]
        if j not in done:
            done.add(j)
            groups.setdefault(t if o == 255 else t[o : o + ANCHOR], []).append(j)
    todo: list[int] = []
    size = 0
    for members in groups.values():
        if len(members) > 1:  # a string alone with its anchor shares no window with another
            todo += members
            size += sum(len(text[j]) for j in members)
            if size >= BLOCK:
                _share(text, todo, first, windows, length)
                todo, size = [], 0
    if todo:
        _share(text, todo, first, windows, length)
    smaller = windows[merged] < own[:, None]
    bits = np.packbits(smaller, axis=1, bitorder="little").view("<u4").ravel()
    edges = np.cumsum([0, *counts])
    return [_zip(bits[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]


def _share(text: list[bytes], members: list[int], first: np.ndarray, windows: np.ndarray, length: int) -> None:
    """Put the smallest document of each window of the members' strings into ``windows``."""
    sizes = np.array([len(text[j]) for j in members])
    raw = np.frombuffer(b"".join(text[j] for j in members), np.uint8)
    order, border = repeated_intervals(raw, length)
    row = np.repeat(np.arange(len(members)), sizes)
    inside = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    window = inside + length <= sizes[row]
    member = np.array(members)
    holder = np.where(window, first[member[row]], LAST)[order]
    heads = np.flatnonzero(border)
    least = np.repeat(np.minimum.reduceat(holder, heads), np.diff(np.concatenate((heads, [len(raw)]))))
    found = np.empty(len(raw), np.int64)
    found[order] = least
    windows[member[row[window]], inside[window]] = found[window]


def sizes_for(total: int) -> tuple[int, int]:
    """Bytes of a batch and of a bucket for so many bytes of text."""
    return tuple(max(least, min(most, total // PARTS)) for least, most in zip((BATCH_BYTES, BUCKET_BYTES), MOST_BYTES, strict=True))


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(batch, n, ids, sizes, blob): documents packed in batches of about batch_bytes, compressed."""

    def make(batches):
        ids, texts, size = [], [], 0
        number = TaskContext.get().partitionId() << 32

        def pack():
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()), pa.array([_zip(b"".join(texts))], pa.binary()),
            ], names=["batch", "bytes", "ids", "sizes", "blob"])

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(d)
                texts.append(text)
                size += len(text)
                if size >= batch_bytes or len(ids) >= 65_536:
                    yield pack()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield pack()

    few = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "text")
    return materialize(few.mapInArrow(make, "batch long, bytes long, ids binary, sizes binary, blob binary"), "repeat-batches")


def _load(row: dict) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], "<i8")
    return _unzip(row["blob"]), np.frombuffer(row["ids"], "<i8"), np.concatenate(([0], np.cumsum(sizes)))


def _rows(batch: dict) -> Iterator[dict]:
    names = list(batch)
    for k in range(len(batch[names[0]])):
        yield {n: batch[n][k].as_py() for n in names}


def _anchors(runs, ids: np.ndarray, buckets: int):
    """Distinct anchors of a batch by bucket: (order of runs, heads, bucket of each head, whether several documents hold it)."""
    _, _, _, h, doc = runs
    route = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, route))
    sorted_h = h[order]
    heads = np.flatnonzero(np.concatenate(([True], (sorted_h[1:] != sorted_h[:-1]))))
    owner = ids[doc[order]]
    several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    return order, heads, route[order[heads]], several


def _marks(runs, ids, buckets: int, replies) -> tuple[np.ndarray, np.ndarray]:
    """For each run whether its anchor is shared, and whether it is crowded."""
    order, heads, route, _ = _anchors(runs, ids, buckets)
    edges = np.flatnonzero(np.diff(route, prepend=-1))
    bits = {r["bucket"]: r["reply"] for r in replies or ()}
    state = np.concatenate([np.frombuffer(_unzip(bits[int(route[a])]), np.uint8) for a in edges])
    each = np.repeat(state, np.diff(np.concatenate((heads, [len(order)]))))
    out = np.empty(len(order), np.uint8)
    out[order] = each
    return out > 0, out == 2


_REQUEST = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("data", T.BinaryType())])


def _first_round(packed: DataFrame, buckets: int, length: int) -> DataFrame:
    def make():
        def step(batch):
            for row in _rows(batch):
                blob, ids, starts = _load(row)
                runs = anchored(np.frombuffer(blob, np.uint8), starts, length)
                if not len(runs[0]):
                    continue
                order, heads, route, several = _anchors(runs, ids, buckets)
                h = runs[3][order[heads]]
                edges = np.flatnonzero(np.diff(route, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(heads)], strict=True):
                    six = (h[a:b] // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    yield int(route[a]), row["batch"], six.tobytes() + np.packbits(several[a:b]).tobytes() + np.array([b - a], "<i8").tobytes()

        return step

    def shared(table: pa.Table) -> pa.Table:
        hashes, several, sizes = [], [], []
        for data in table.column("data").to_pylist():
            n = int(np.frombuffer(data[-8:], "<i8")[0])
            eight = np.zeros((n, 8), np.uint8)
            eight[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(-1, 6)
            hashes.append(eight.view("<u8").ravel())
            several.append(np.unpackbits(np.frombuffer(data[6 * n : -8], np.uint8), count=n).astype(bool))
            sizes.append(n)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
        count = np.diff(np.concatenate((heads, [len(h)])))
        many = (count > 1) | np.logical_or.reduceat(np.concatenate(several)[order], heads)
        state = np.empty(len(h), np.uint8)
        state[order] = np.repeat(many.astype(np.uint8) + (count > CROWD), count)
        edges = np.cumsum([0, *sizes])
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "data": pa.array([_zip(state[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)], pa.binary())})

    return map_rows(packed, make, _REQUEST, 256).groupBy("bucket").applyInArrow(shared, _REQUEST)


def _second_round(marked: DataFrame, buckets: int, length: int) -> DataFrame:
    def make():
        def step(batch):
            for row in _rows(batch):
                strings = _strings(row, buckets, length)[0]
                if strings is not None:
                    yield from ((b, row["batch"], data) for b, data in strings.requests())

        return step

    def shared(table: pa.Table) -> pa.Table:
        return pa.table({"bucket": table.column("bucket"), "batch": table.column("batch"), "data": pa.array(answer(table.column("data").to_pylist(), length), pa.binary())})

    return map_rows(marked, make, _REQUEST, 64).groupBy("bucket").applyInArrow(shared, _REQUEST)


def _strings(row: dict, buckets: int, length: int):
    blob, ids, starts = _load(row)
    runs = anchored(np.frombuffer(blob, np.uint8), starts, length)
    if not len(runs[0]):
        return None, blob, ids, starts
    return Strings(blob, ids, runs, *_marks(runs, ids, buckets, row["marks"]), buckets, length), blob, ids, starts


def _by_batch(replies: DataFrame, name: str) -> DataFrame:
    """One row a batch: what the buckets answered it, as many as it asked."""
    return replies.groupBy("batch").agg(F.collect_list(F.struct("bucket", F.col("data").alias("reply"))).alias(name))


def _removed(docs: DataFrame, length: int, finish, schema: T.StructType) -> DataFrame:
    """finish(doc_id, text bytes, removed [start, end) spans) for every row of docs."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batch_bytes, bucket_bytes = sizes_for(total)
    packed = _batches(docs, batch_bytes)
    buckets = max(1, -(-total // bucket_bytes))
    marks = materialize(_by_batch(_first_round(packed, buckets, length), "marks"), "repeat-marks")
    marked = packed.join(marks, "batch", "left")
    replies = materialize(_by_batch(_second_round(marked, buckets, length), "replies"), "repeat-replies")

    def make():
        def step(batch):
            for row in _rows(batch):
                strings, blob, ids, starts = _strings(row, buckets, length)
                gone = np.zeros((0, 2), np.int64)
                if strings is not None and len(strings.string):
                    edges = np.flatnonzero(np.diff(strings.route[strings.order], prepend=-1))
                    bits = {r["bucket"]: r["reply"] for r in row["replies"]}
                    got = np.concatenate([np.frombuffer(_unzip(bits[int(strings.route[strings.order[a]])]), "<u4") for a in edges])
                    words = np.empty(len(got), np.uint32)
                    words[strings.order] = got
                    gone = _covered(strings, words, starts, length)
                k = np.searchsorted(gone[:, 0], starts)
                for i, d in enumerate(ids.tolist()):
                    a, b = int(starts[i]), int(starts[i + 1])
                    yield finish(None if d == LAST else d, blob[a:b], (gone[k[i] : k[i + 1]] - a).tolist())

        return step

    return map_rows(marked.join(replies, "batch", "left"), make, schema, 512)


def kept_bytes(raw: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kept (the remaining bytes) and spans ([start, end) of removed bytes) of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))])
    return _removed(docs, length, lambda d, raw, spans: (d, kept_bytes(raw, spans), spans), schema)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def finish(d, raw, spans):
        return d, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest()

    longs = [T.StructField(n, T.LongType()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    return _removed(docs, length, finish, T.StructType([*longs, T.StructField("kept_sha256", T.StringType())]))


def _covered(strings: Strings, words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Maximal [start, end) spans of removed bytes of a batch; spans of neighbouring documents stay apart."""
    later = strings.doc > strings.least[strings.string]
    runs = strings.count
    at = np.repeat(strings.window, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    shift = at - np.repeat(strings.window, runs)
    goes = np.repeat(later, runs) | ((np.repeat(words[strings.string], runs) >> shift.astype(np.uint32)) & 1).astype(bool)
    start = np.unique(at[goes])
    if not len(start):
        return np.zeros((0, 2), np.int64)
    doc = np.searchsorted(starts, start, "right")
    first = np.flatnonzero(np.concatenate(([True], (start[1:] > start[:-1] + length) | (doc[1:] != doc[:-1]))))
    return np.stack([start[first], start[np.concatenate((first[1:], [len(start)])) - 1] + length], 1)
