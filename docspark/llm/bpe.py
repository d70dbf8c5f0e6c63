"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique. The tokens that end a prefix come from a suffix-matching automaton
over the vocabulary; of these exactly one fits: the one whose pair with the last token of the shorter prefix BPE would leave standing.
Following the stored tokens back from the end of the word gives the ids of greedy merging by rank, without merging anything.

A pair (a, b) stands if no merge ever joins the two across their border: walking down the right edge of a's merge tree and the left
edge of b's, no two parts that stand side by side at the same time have a merge of their own.

Words are the vocabulary's pre-tokens; results are kept per chunk of text between white space in a cache of bounded size, which all
tasks of a worker share. Time is linear in the text, whole texts are encoded however long.

Defined cases: a null or empty text has no tokens; the vocabulary's special strings in a text become their ids; a null doc_id, repeated
rows and an empty table need nothing special; other columns are carried by ``encode``, whatever their names, and ignored by ``token_report``.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.llm.common import bounded_batches, map_rows, release

#: Entries of the caches of a worker: of chunks and of pre-tokens, and of the table of pairs, a power of two.
CACHE, PRETOKENS, PAIRS = 200_000, 300_000, 1 << 20
#: Longer chunks are encoded anew each time.
CACHE_CHARS = 64
WHITE = "[\t-\r \x85\xa0  -     　]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next one from U+0100 on."""
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
    rest = (c for c in range(256, 512))
    return [chr(c) if c in shown else chr(next(rest)) for c in range(256)]


class Vocabulary:
    """The tokens of a tokenizer file as strings over 512 symbols: 256 bytes inside a word, 256 at its end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        inside = {c: chr(b) for b, c in enumerate(letters)}
        text: dict[int, str] = {}
        for c, s in inside.items():
            text[ids[c]] = s
            if self.end:
                text[ids[c + self.end]] = chr(ord(s) + 256)
        #: Rank of a pair of ids, kept as one number. Of an id: the rank that made it and its two parts.
        self.merge: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (ids[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[self.names[a] + self.names[b]]
            self.merge.setdefault(a << 32 | b, rank)
            self.parts.setdefault(made, (rank, a, b))
            text.setdefault(made, text[a] + text[b])
        #: Each slot has the last pair that fell on it, doubled, plus whether it stands; a pair of 0 and 0 is left out.
        self.pairs = array("Q", bytes(8 * PAIRS))
        self.whole: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i, s in text.items():
            if self.is_whole(i):  # others are parts of merges that no encoding ends with
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.packed = {i: i.to_bytes(4, "little") for i in self.names}
        self.pretokens: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE[1:-2])
        self.words = regex.compile(split).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.openers = {t[0] for t in self.special if t}
        self.white = regex.compile(WHITE).split
        self.symbols = {True: [chr(b + 256) if self.end else chr(b) for b in range(256)], False: [chr(b) for b in range(256)]}

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """Parts along one edge of a token's merge tree, each with the rank that ends it."""
        out, until = [(token, float("inf"))], float("inf")
        while token in self.parts:
            until, a, b = self.parts[token]
            token = b if right else a
            out.append((token, until))
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether BPE keeps the border between tokens a and b."""
        merge, left = self.merge, self.edge(b, False)
        for x, until_x in self.edge(a, True):
            for y, until_y in left:
                m = merge.get(x << 32 | y)
                # Of equal merges the leftmost goes first: one inside a before ours, ours before one inside b.
                if m is not None and m < until_x and m <= until_y:
                    return False
        return True

    def is_whole(self, token: int) -> bool:
        """Whether a token's own text is encoded as that token: its parts are whole and stand together until they merge."""
        known = self.whole.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                rank, a, b = self.parts[token]
                known = self.is_whole(a) and self.is_whole(b) and self.meets(a, b, rank)
            self.whole[token] = known
        return known

    def meets(self, a: int, b: int, rank: int) -> bool:
        """Whether no merge other than ``rank`` itself joins parts of a and b across their border."""
        for x, until_x in self.edge(a, True):
            for y, until_y in self.edge(b, False):
                m = self.merge.get(x << 32 | y)
                if m is not None and (x, y) != (a, b) and m < until_x and m <= until_y:
                    return False
        return self.merge.get(a << 32 | b) == rank

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8")
        if not raw:
            return []
        text = raw[:-1].decode("latin-1") + self.symbols[True][raw[-1]]
        n = len(text)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        pairs = self.pairs
        for at, (size, token) in self.automaton.iter(text):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                slot = (before * 31153 ^ token) & PAIRS - 1
                pair = (before << 32 | token) << 1
                known = pairs[slot] ^ pair
                if known > 1 or not pair:
                    known = int(self.stands(before, token))
                    pairs[slot] = pair | known
                if not known:
                    continue
            last[end], back[end] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def pretoken(self, word: str) -> bytes:
        """Ids (little-endian 32 bits) of one pre-token."""
        packed = self.packed
        got = b"".join([packed[i] for i in self.word(word)])
        if len(word) <= CACHE_CHARS:
            if len(self.pretokens) >= PRETOKENS:
                self.pretokens.clear()
            self.pretokens[word] = got
        return got

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space."""
        if not chunk.isascii():
            plain = unicodedata.normalize("NFC", chunk)
            plain = "".join(c.lower() for c in plain) if "Σ" in plain else plain.lower()
        else:
            plain = chunk.lower()
        known = self.pretokens.get
        if plain.isalpha():  # letters are one pre-token
            got = known(plain) or self.pretoken(plain)
        else:
            head, end = plain[:-1], plain[-1:]
            each = (head, end) if head.isalpha() and not end.isalpha() and not end.isnumeric() and head else self.words(plain)
            got = b"".join([known(w) or self.pretoken(w) for w in each])
        if len(chunk) <= CACHE_CHARS:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32 bits."""
        ids = []
        for piece in self.cut(text) if self.cut and any(c in text for c in self.openers) else (text,):
            if piece in self.special:
                ids.append(self.special[piece].to_bytes(4, "little"))
                continue
            odd = any(c in piece for c in "\x1c\x1d\x1e\x1f")
            for chunk in self.white(piece) if odd else piece.split():
                ids.append(self.chunks.get(chunk) or self.chunk(chunk))
        return b"".join(ids)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text, and the text that they decode to."""
        ids = self.ids(text)
        return ids, self.decode(np.frombuffer(ids, "<i4").tolist())

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included: their names joined by spaces, as the file names no decoder; unknown ids are left out."""
        try:
            return " ".join(map(self.names.__getitem__, ids))
        except KeyError:
            return " ".join(self.names[i] for i in ids if i in self.names)

    def decoded_sha256(self, ids: np.ndarray) -> str:
        return hashlib.sha256(self.decode(ids.tolist()).encode()).hexdigest()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    path = path or default_vocabulary()
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def make():
        known = vocabulary(path)

        def step(batch):
            for d, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = known.ids(text.as_py() or "")
                yield d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), known.decoded_sha256(np.frombuffer(ids, "<i4"))

        return step

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)


def encode(docs: DataFrame, path: str | None = None, column: str = "ids", rows: int = 256, digest: str | None = None, text: bool = True) -> DataFrame:
    """docs with the token ids of ``text`` as a further column of arrays, named ``column``, or with underscores behind if docs has one of that name.

    ``digest`` names another one in the same way, the SHA-256 of the text that the ids decode to. Without ``text`` the text itself stays behind.

    Rows leave the worker a few hundred at a time, so that neither side holds the ids of a whole batch.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at = [k for k, n in enumerate(names) if text or n != "text"]
    kept = [docs.schema.fields[k] for k in at]
    column, digest = free_name(column, names), digest and free_name(digest, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                ids = [np.frombuffer(known.ids(t.as_py() or ""), "<i4") for t in part.column(names.index("text"))]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                decoded = [pa.array([known.decoded_sha256(i) for i in ids], pa.string())] if digest else []
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at), lists, *decoded], names=[f.name for f in [*kept, *made]])
        release()

    more = [digest] if digest else []
    made = [T.StructField(column, T.ArrayType(T.IntegerType())), *(T.StructField(n, T.StringType()) for n in more)]
    return docs.select(*names).mapInArrow(run, T.StructType([*kept, *made]))


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as make it differ from the taken ones."""
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


def decode(tokens: DataFrame, path: str | None = None, column: str = "ids", to: str = "decoded") -> DataFrame:
    """tokens with the text of the ids in ``column``; null ids give a null text."""

    @F.pandas_udf("string")
    def text(ids):
        import pandas as pd

        known = vocabulary(path)
        return pd.Series([None if i is None else known.decode(list(map(int, i))) for i in ids], dtype=object)

    return tokens.withColumn(to, text(column))
