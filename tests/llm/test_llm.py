"""The training-data operators against brute force, round trips and held-out labels; nulls, empties, ties, repeats and odd columns."""

import hashlib
import os
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docspark.llm import bpe, chat, common, lines, mixing, neardup, pii, quality, queries, repeats, simhash, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "one two three four five six seven eight nine ten " * 4000
EDGE = [
    (1, "Alpha beta gamma delta epsilon\nshared line of text\nlast words here", "en", "b", 60), (2, "shared line of text\nSHARED LINE OF TEXT  \nother line of mine", "en", None, 40),
    (None, "no id at all but the shared line of text", None, "a", None), (None, None, None, None, None), (3, None, "de", "a", 0), (4, "", "de", "b", 0), (5, " \n\t ", "fr", "b", 4), (6, LONG, "en", "b", len(LONG)),
    (7, LONG, "en", "c", len(LONG)), (7, LONG, "en", "c", len(LONG)), (8, "Alpha beta gamma delta epsilon\nshared line of text\nlast words here", "en", "a", 60), (9, "é" * 9 + "\nab\nab", "fr", "a", 15),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def odd(edge):
    """Extra columns with names that operators use inside."""
    return edge.select("*", *[F.lit(k).alias(n) for k, n in enumerate(["size", "u", "h1", "drop", "fp", "ids_", "copies", "s", "b", "target", "node", "label", "x", "keep"])])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def pairs(df):
    return [(r.doc_id, (r.text or "")) for r in df.select("doc_id", "text").collect()]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# 1


def brute_top_k(rows, every, k):
    v = {i: [int(np.floor(64 * a)) for a in x] for i, x in rows if i is not None and x is not None and all(a is not None and np.isfinite(a) for a in x)}
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  a shorter one counts as padded
    out = []
    for q in v:
        if q % every == 0:
            best = sorted((-score(v[q], v[c]), c) for c in v if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def as_float32(rows):
    return [(i, None if x is None else [None if a is None else float(np.float32(a)) for a in x]) for i, x in rows]


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k(spark, clustered, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "SAMPLE", 100)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(5, 16)) if clustered else np.zeros((5, 16))
    rows = [(k, (base[k % 5] + rng.normal(size=16) * 0.3).round(2).tolist()) for k in range(300)]
    rows += [(300, None), (301, [float("nan")] * 16), (302, [None, *[1.0] * 15]), (303, [float("inf")] * 16), (304, rows[0][1]), (320, []), (None, [1.0] * 16), (305, [2.5, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("cluster", F.lit("c")).withColumn("v", F.lit("v"))
    assert sorted(map(tuple, topk.search_report(df).collect())) == brute_top_k(as_float32(rows), 20, 20)


def test_segment_bounds_hold():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(40, 64)) * 50, rng.normal(size=(50, 64)) * 50
    last = None
    for h in topk.HEADS:
        edges = topk.edges_of(64, h)
        bound = topk.segment_features(a, edges) @ topk.segment_features(b, edges).T
        assert (bound >= a @ b.T - 1e-6).all()
        if last is not None:
            assert (bound <= last + 1e-6).all()
        last = bound
    space = topk.fit_space(b, 64, 4)
    assert np.allclose(space.turned(a) @ space.turned(b).T, a @ b.T)
    assert [topk.edges_of(n, 8).tolist() for n in (1, 8, 9, 20)] == [[0, 1], list(range(9)), list(range(10)), [*range(9), 16, 20]]


def test_top_k_prunes_clustered_rows():
    """Most rows never reach exact scoring, and most clusters are never sent a query, where vectors have any structure."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    x = topk.quantized(base[np.arange(4000) % 40] + rng.normal(size=(4000, 64)) * 0.15)
    space = topk.fit_space(x[:1000], 64, 40)
    cluster, far = space.nearest(x)
    radii = np.array([far[cluster == c].max(initial=-1) for c in range(len(space.centres))])
    ids, at = np.arange(4000), np.flatnonzero(cluster == cluster[0])
    tally = {}
    _, limits = topk.search_cell(space, ids[at], x[at], np.full(len(at), -np.inf), ids[at], x[at], 20)
    fine = topk.promising(space, radii, x[at], limits)
    (q, v, s), _ = topk.search_cell(space, ids[at], x[at], np.full(len(at), -np.inf), ids, x, 20, tally)
    exact = x[at] @ x.T
    exact[np.arange(len(at)), at] = -np.inf
    assert (s.reshape(len(at), 20) == -np.sort(-exact, axis=1)[:, :20]).all()
    assert all(fine[k, cluster[j]] for k in range(len(at)) for j in np.argsort(-exact[k], kind="stable")[:20])
    assert fine.mean() < 0.3 and tally["scored"] < 0.2 * tally["pairs"]


def test_top_k_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.search_report(spark.createDataFrame([], kind)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (0, [1.0, 2.0]), (1, [5.0, 2.0])], kind)
    assert {r.vec_id: r.score for r in topk.search_report(few).collect()} == {1: 64 * 64 * 5, 2: 64 * 192}
    large = [(0, [3e6, 0.0]), (1, [3e6, 0.0]), (2, [3e6, 0.0]), (3, []), (4, [1e-30, -5.0])]
    assert sorted(map(tuple, topk.search_report(spark.createDataFrame(large, kind)).collect())) == brute_top_k(as_float32(large), 20, 20)
    assert topk.exact_scores(np.array([[2.0**40, 1.0, -(2.0**40)]]), np.array([[2.0**30, 7.0, 2.0**30]])).tolist() == [7]
    with pytest.raises(OverflowError):
        topk.exact_scores(np.array([[2.0**40]]), np.array([[2.0**40]]))
    with pytest.raises(Exception, match="leaves 64 bits"):
        topk.search_report(spark.createDataFrame([(0, [1e30]), (1, [1e30])], kind)).collect()


def test_top_k_broadcasts_no_blocks(spark):
    """Blocks of vectors don't pass through the driver, however small their table is."""
    rows = spark.range(200).selectExpr("id AS vec_id", "transform(sequence(1, 8), k -> float((id * k) % 17)) AS embedding")
    found = topk.search_report(rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 200


def test_top_k_of_wide_vectors(spark, monkeypatch):
    """Blocks are bounded by bytes: no row of a table holds more than a few wide vectors. One of the vectors is short."""
    longest, real = [], topk.materialize

    def noted(df, name, **written):
        out = real(df, name, **written)
        longest.extend(out.agg(*[F.coalesce(F.max(F.length(c)), F.lit(0)) for c, t in out.dtypes if t == "binary"] or [F.lit(0)]).first())
        return out

    monkeypatch.setattr(topk, "materialize", noted)
    axes = 2**17
    value = f"transform(sequence(0, IF(id = 7, 9, {axes - 1})), x -> CAST((id * id * 31 + x * (id + 7)) % 101 - 50 AS float) / 64)"
    df = spark.range(40, numPartitions=4).selectExpr("id AS vec_id", f"{value} AS embedding")
    x = np.arange(axes)
    v = np.array([np.where(x < (10 if k == 7 else axes), (k * k * 31 + x * (k + 7)) % 101 - 50, 0) for k in range(40)], np.int64)
    scores = v @ v.T
    expected = [(q, r + 1, c, int(scores[q, c])) for q in (0, 20) for r, c in enumerate(sorted((c for c in range(40) if c != q), key=lambda c: (-scores[q, c], c))[:20])]
    assert sorted(map(tuple, topk.search_report(df).collect())) == expected
    assert 0 < max(longest) <= 16 << 20


def test_narrow_matrices():
    for most in (0, 127, 128, 32_768, 2**31 - 1, 2**31, 2**60):
        v = np.array([[most, -most, 0.0], [1.0, -1.0, most]])
        assert (topk._matrix(topk.narrow(v), 2, 3) == v).all()


# 2


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def check_tokens(library, text):
    ids, decoded = bpe.vocabulary().encode(text)
    theirs = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == theirs
    assert decoded == library.decode(theirs, skip_special_tokens=False) == bpe.vocabulary().decode(theirs)


def test_tokens_of_odd_texts(library):
    rng = np.random.default_rng(5)
    odd = [
        "", " ", "<|endoftext|>a<|startoftext|> b<|endoftext|>", "a" * 3000, "aaaa bbbb abab ababab", "I'LL don't we've 's 'S", "ΣΑΣ Σ", "İstanbul", "é ́x", "１２３ 45 ab5 a² ½ x٣", "\x1c\x1d a\x1fb", "日本語 한국어",
        "🙂👩‍👩‍👧", "<|endoftext", "ﬁ ǅ ẞ", "ab́ ab_ a‍b",
    ]
    letters = list("abAB' .,0é\n<|>ßΣ́\x85　²½٣_thein")
    odd += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(400)]
    for text in odd:
        check_tokens(library, text)


def test_tokens_of_documents(library, docs, edge):
    for df in (docs, edge):
        for r, (_, text) in zip(bpe.token_report(df).collect(), pairs(df), strict=True):
            theirs = library.encode(text, add_special_tokens=False).ids
            assert r.n_tokens == len(theirs) and r.ids_sha256 == hashlib.sha256(np.array(theirs, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(theirs, skip_special_tokens=False).encode()).hexdigest()


def test_encode_and_decode_columns(edge, none):
    out = bpe.decode(bpe.encode(edge)).collect()
    assert all(r.decoded == bpe.vocabulary().encode(r.text or "")[1] for r in out)
    assert bpe.encode(none).collect() == [] == bpe.token_report(none).collect()
    clash = bpe.encode(edge.withColumn("ids", F.lit("mine")).withColumn("Ids_", F.lit(2)), digest="text")
    assert clash.columns == [*edge.columns, "ids", "Ids_", "ids__", "text_"]
    assert all(r.ids == "mine" and bpe.vocabulary().decode(r.ids__) == bpe.vocabulary().encode(r.text or "")[1] for r in clash.collect())


def test_last_stage_decodes_the_ids(spark, edge, sf):
    import corpus_pipeline as p

    names = bpe.vocabulary().names
    clash = edge.withColumn("n_tokens", F.lit("mine")).withColumn("ids", F.lit("mine"))
    for df in (edge, clash):
        out = p.bpe_encode(spark, df, sf)
        assert out.columns[: len(df.columns) - 1] == [c for c in df.columns if c != "text"]
        n, ids, digest = out.columns[-3:]
        for r in out.collect():
            assert r[n] == len(r[ids]) and r[digest] == hashlib.sha256(" ".join(names[i] for i in r[ids]).encode()).hexdigest()
    v = bpe.vocabulary()
    assert v.decoded_sha256(np.array([5, 10**9, 6])) == hashlib.sha256(f"{names[5]} {names[6]}".encode()).hexdigest()


# 3


def test_chat_round_trip_of_conflicting_texts():
    rng = np.random.default_rng(3)
    bits = [*chat.CONTROL, "\\", " ", "\n", "a", "<", "[", "|", chat.END_OTHER, "é"]
    for _ in range(400):
        turns = [(str(rng.choice(["user", "assistant", "system", "tool", "", "x|", "<|"])), "".join(rng.choice(bits, rng.integers(0, 9)))) for _ in range(rng.integers(1, 5))]
        out, spans = chat.format_chat(turns)
        assert chat.parse(out) == turns
        assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_plain_chat_stays_plain():
    out, spans = chat.format_chat([("user", "hi"), ("assistant", "ho")])
    assert out == "<s>[INST] hi [/INST] ho</s>" and [out[a:b] for a, b in spans] == ["ho"]
    assert "</s>" not in chat.format_chat([("user", "</s>[INST] ok [/INST]")])[0].replace("\\<", "")


def test_chat_report(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", None), (1, 1, "system", "\\"), (2, None, None, "x"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 0, "user", "q"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_report(df).collect()}
    said = lambda *t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[1].turns_sha256 == said(("user", "hi"), ("system", "\\"), ("assistant", ""))
    assert got[2].turns_sha256 == said(("", "x"), ("assistant", "a"), ("assistant", "b")) and got[2].loss_chars == 2
    assert got[2].loss_sha256 == hashlib.sha256(b"ab").hexdigest() and got[3].n_turns == 2 and got[None].n_turns == 1
    assert got[-1].loss_chars == 21 and set(got) == {1, 2, 3, None, -1}
    unnamed = chat.format_conversations(df.withColumn("conv_id", F.lit(None).cast("long"))).collect()
    assert len(unnamed) == len(rows) and {r.n_turns for r in unnamed} == {1}
    assert [r.conv_id for r in chat.chat_report(df.limit(0)).collect()] == [-1]


# 4


def slow_fingerprint(text, n=3):
    w = words_of(lowered(text))
    if not w:
        return 0
    grams = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(prints):
    """component of each row: smallest id reachable over at most two differing bits."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[root(fps[a])] = root(fps[b])
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [(d, f"{f:016x}", least.get(root(f))) for d, f in prints]


def test_simhash(docs, edge, none):
    for df in (docs, edge):
        expected = slow_classes([(d, slow_fingerprint(t)) for d, t in pairs(df)])
        assert sorted(map(tuple, simhash.simhash_report(df).collect()), key=repr) == sorted(expected, key=repr)
    assert simhash.simhash_report(none).collect() == []


@pytest.mark.parametrize("crowd", [512, 3])
def test_linked_fingerprints(spark, crowd, monkeypatch):
    """Crowds of near fingerprints: chains of two bits, balls around a centre, and strangers."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**63, 300)}
    for centre in list(fps)[:6]:
        for _ in range(60):
            fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    chain = int(rng.integers(0, 2**63))
    for k in range(0, 60, 2):
        fps.add(chain := chain ^ 3 << k)
    nodes = [f - (f >> 63 << 64) for f in sorted(fps)]
    got = {r.node: r.label for r in simhash.node_components(spark.createDataFrame([(n, n) for n in nodes], "node long, fp long"), 2).collect()}
    expected = defaultdict(set)
    for n, (_, _, c) in zip(sorted(fps), slow_classes([(k, f) for k, f in enumerate(sorted(fps))]), strict=True):
        expected[c].add(n - (n >> 63 << 64))
    ours = defaultdict(set)
    for n in nodes:
        ours[got.get(n, n)].add(n)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("small", [1_000_000, 5])
def test_components(spark, small, monkeypatch):
    """Chains, stars and strangers, solved in one task or contracted by joins first."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = np.random.default_rng(12)
    ids = rng.permutation(400).tolist()
    links = [(ids[k], ids[k + 1]) for k in range(120)] + [(ids[200], ids[k]) for k in range(201, 260)] + [(ids[300 + 2 * k], ids[301 + 2 * k]) for k in range(20)] + [(ids[5], ids[5]), (ids[0], ids[120])]
    parent = {x: x for x in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.label for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links for x in (a, b)} and len(got) == 121 + 60 + 40
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_index_finds_all_near_pairs():
    rng = np.random.default_rng(4)
    group = np.sort(rng.integers(0, 20, 400))
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)[group]
    bits = base ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    for most in (0, 2, 9):
        found = {(int(i), int(j)) for a, b in simhash.index_links(group, bits, most) for i, j in zip(a, b, strict=True)}
        assert found == {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] == group[j] and int(bits[i] ^ bits[j]).bit_count() <= most}


def slow_shingles(text, n=5):
    w = words_of(lowered(text))
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies_by_similarity(spark):
    """Recall at least 0.9 of pairs at or above 0.8, no merge of texts that aren't connected by such pairs."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(600)]
    texts = []
    for _ in range(25):
        base = rng.choice(vocabulary, rng.integers(60, 260)).tolist()
        texts.append(" ".join(base))
        for edits in (0, 1, 2, 3, 5, 9):
            w = list(base)
            for k in rng.choice(len(w), edits, replace=False):
                w[k] = str(rng.choice(vocabulary))
            texts.append(" ".join(w))
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(1000, None, None, None, None), (1001, "", None, None, None), (None, texts[0], None, None, None)], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_classes(df).collect()}
    sets = [slow_shingles(t) for t in texts]
    true = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(got[a] == got[b] for a, b in true) >= 0.9 * len(true)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in true:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(got[k]) == root(k) for k in range(len(texts))) and got[1001] == 1000
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 1000").collect()) == sorted({got[k] for k in range(len(texts))})


def crowd_of_copies(n, seed=11):
    """Texts that share most of a template of 150 shingles; their pairs lie around a similarity of 0.8."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in range(154)]
    texts = []
    for k in range(n):
        w = list(base)
        for at in rng.choice(len(w), 2 + k % 2, replace=False):
            w[at] = f"x{k}y{at}"
        texts.append(" ".join(w))
    return texts


def rows_of(texts):
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]


def fingerprint_bits(hashes):
    return np.unpackbits(np.array(neardup.wide_fingerprint(hashes), ">i8").view(np.uint8))


def test_near_copies_skip_no_candidate(spark, monkeypatch):
    """True pairs that look similar in some band are always in one group, however many candidates between them fail."""
    monkeypatch.setattr(neardup, "BANDS", 3)
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup, "QUOTA", 2)
    texts = crowd_of_copies(160)
    sets = [slow_shingles(t) for t in texts]
    got = {r.doc_id: r.component_id for r in neardup.near_classes(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    hashes = [np.unique(neardup.shingle_hashes(t.encode(), 5)) for t in texts]
    bits, keys = [fingerprint_bits(h) for h in hashes], [neardup.band_keys(h, 3, 1) for h in hashes]

    def candidate(a, b):
        x, y = bits[a], bits[b]
        near = (x != y).sum() <= neardup.most_differing(512, 0.8, neardup.SLACK)
        return near and any(keys[a][k] == keys[b][k] and (x[64 * k : 64 * k + 64] != y[64 * k : 64 * k + 64]).sum() <= neardup.most_differing(64, 0.8, neardup.WORD_SLACK) for k in range(3))

    pairs_ = [(a, b, len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])) for a in range(len(texts)) for b in range(a) if candidate(a, b)]
    assert sum(t for _, _, t in pairs_) > 300 and sum(not t for _, _, t in pairs_) > 300
    assert all(got[a] == got[b] for a, b, t in pairs_ if t)


def test_forest_is_the_minimum_one():
    rng = np.random.default_rng(3)
    for n in (2, 30, 300):
        i, j = rng.integers(0, n, (2, 4 * n))
        i, j = i[i != j], j[i != j]
        differ = rng.integers(0, 9, len(i))
        parent = list(range(n))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        cost = 0
        for k in np.argsort(differ, kind="stable").tolist():
            if root(i[k]) != root(j[k]):
                parent[root(i[k])] = root(j[k])
                cost += differ[k]
        got = neardup.nearest_forest(n, i, j, differ)
        assert differ[got].sum() == cost and len(got) == n - len({root(x) for x in range(n)}) and len(set(got.tolist())) == len(got)


def test_near_copies_of_a_large_crowd(spark, monkeypatch):
    """3,000 near copies whose keys are cut and dealt by hash are one group, and texts that only share half of theirs stay."""
    monkeypatch.setattr(neardup, "PIECE", 32)
    rng = np.random.default_rng(19)
    base = [f"w{k}" for k in range(400)]
    texts = []
    for k in range(3000):
        w = list(base)
        w[int(rng.integers(0, 400))] = f"x{k}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:200] + [f"s{k}w{x}" for x in range(200)]) for k in range(40)]
    got = {r.doc_id: r.component_id for r in neardup.near_classes(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert all(got[k] == 0 for k in range(3000)) and all(got[k] == k for k in range(3000, 3040))


def test_near_copies_keep_one_cases(spark, odd, none):
    assert neardup.keep_one(none).collect() == []
    out = neardup.keep_one(odd)
    assert out.columns == odd.columns
    # 6 and both rows of 7 are one text, 3, 4 and 5 have no words, 8 repeats 1, rows without an id stay.
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted([1, 2, None, None, 3, 6, 9], key=repr)
    # Texts of one doc_id link: 5 stands for 6, which also has the text of 7.
    one, two = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(6, one), (6, two), (5, one), (7, two), (8, "other words"), (8, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("label", F.lit(3))
    assert sorted(r.doc_id for r in neardup.keep_one(df).collect()) == [5, 8, 8]


def test_near_copies_with_repeats(spark):
    """Similarity is that of sets: how often a text repeats a phrase does not matter to the search either."""
    rng = np.random.default_rng(13)
    texts = []
    for k in range(20):
        base, phrase = [f"b{k}w{x}" for x in range(304)], [f"p{k}w{x}" for x in range(10)]
        texts += [" ".join(base), " ".join(base + phrase * int(rng.integers(10, 40)))]
    sets = [slow_shingles(t) for t in texts]
    assert all(len(sets[k] & sets[k + 1]) >= 0.9 * len(sets[k] | sets[k + 1]) for k in range(0, 40, 2))
    got = {r.doc_id: r.component_id for r in neardup.near_classes(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)).collect()}
    assert all(got[k + 1] == k for k in range(0, 40, 2))


def test_keys_and_filters_find_pairs_at_the_threshold(spark):
    """Recall of pairs at a similarity of 0.8, which does not depend on how many documents there are."""
    rng = np.random.default_rng(17)
    for n in (200, 50, 15):
        met = 0
        for x in rng.integers(0, 2**64, (400, n), dtype=np.uint64):
            a, b = (np.sort(y) for y in (np.concatenate([x[: n * 8 // 10], x[n * 8 // 10 : n * 9 // 10]]), np.concatenate([x[: n * 8 // 10], x[n * 9 // 10 :]])))
            fa, fb = fingerprint_bits(a), fingerprint_bits(b)
            near = (fa != fb).sum() <= neardup.most_differing(512, 0.8, neardup.SLACK)
            keys = zip(neardup.band_keys(a, neardup.BANDS, neardup.ROWS), neardup.band_keys(b, neardup.BANDS, neardup.ROWS), strict=True)
            word = [(fa[64 * k : 64 * k + 64] != fb[64 * k : 64 * k + 64]).sum() <= neardup.most_differing(64, 0.8, neardup.WORD_SLACK) for k in range(8)]
            met += bool(near and any(x == y and word[k] for k, (x, y) in enumerate(keys)))
        assert met >= 0.95 * 400, (n, met)
    words = neardup.wide_fingerprint(x)
    whole = "".join(f"{w % 2**64:064b}" for w in words) * 2
    got = spark.createDataFrame([(words, k) for k in range(0, 512, 7)], "w array<long>, k int").select("k", neardup._window("k").alias("m")).collect()
    assert all(f"{r.m % 2**64:064b}" == whole[r.k : r.k + 64] for r in got)


def test_near_copies_inside_a_crowd(spark, monkeypatch):
    """Pairs just above 0.8 are found where crowded keys are cut into pieces."""
    monkeypatch.setattr(neardup, "ROWS", 1)
    monkeypatch.setattr(neardup, "PIECE", 8)
    texts = []
    for k in range(150):
        base = [f"shared{x}" for x in range(100)] + [f"own{k}w{x}" for x in range(140)]
        copy = list(base)
        for x in (105, 130, 155, 180, 205):
            copy[x] = f"other{k}w{x}"
        texts += [" ".join(base), " ".join(copy)]
    got = {r.doc_id: r.component_id for r in neardup.near_classes(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)).collect()}
    assert all(r == d - d % 2 or r == d for d, r in got.items())
    assert sum(got[k + 1] == k for k in range(0, 300, 2)) >= 0.9 * 150


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """However small the pieces of crowded keys are, the groups are those of keys searched whole."""
    monkeypatch.setattr(neardup, "BANDS", 1)
    monkeypatch.setattr(neardup, "ROWS", 1)
    rng = np.random.default_rng(23)
    texts = []
    for k in range(200):  # half of each text is shared by all, and one other text is near it
        base = [f"shared{x}" for x in range(120)] + [f"own{k}w{x}" for x in range(120)]
        copy = list(base)
        for x in rng.choice(np.arange(120, 240), 4, replace=False):
            copy[x] = f"other{k}w{x}"
        texts += [" ".join(base), " ".join(copy)]
    df = spark.createDataFrame(rows_of(texts), DOCS)
    got = {}
    for piece in (2, 10**9):
        monkeypatch.setattr(neardup, "PIECE", piece)
        got[piece] = {r.doc_id: r.component_id for r in neardup.near_classes(df).collect()}
    assert sum(got[10**9][k + 1] == k for k in range(0, 400, 2)) > 100
    assert got[2] == got[10**9]


# 5


def slow_statistics(text):
    w, ls = words_of(text), text.split("\n")
    grams = defaultdict(list)
    for k in range(len(w) - 2):
        grams[tuple(w[k : k + 3])].append(k)
    covered = {j for at in grams.values() if len(at) > 1 for k in at for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for x in ls:
        if words_of(x):
            dup += x in seen
            seen.add(x)
    n = len(w)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_statistics(docs, labels, edge, none):
    for df in (docs, edge):
        got = sorted((tuple(r)[:7] for r in quality.quality_report(df, labels).collect()), key=repr)
        assert got == sorted(((d, *slow_statistics(t)) for d, t in pairs(df)), key=repr)
    assert quality.quality_report(none, labels).collect() == []
    no_labels = labels.limit(0)
    assert all(r.kept != r.base_failed for r in quality.quality_report(edge, no_labels).collect())


def test_quality_on_labels_that_it_did_not_train_on(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    report = quality.quality_report(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in report]) > 0.95


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.FEATURES)))
    y = (x[:, 2] + 0.3 * x[:, 0] + rng.normal(size=2000) * 0.3 < 0.7).astype(float)
    trees = quality.fit(x, y)
    probe = rng.random((300, x.shape[1]))
    for j, way in enumerate(quality.MONOTONE):
        if way:
            scores = [trees.score(np.concatenate([probe[:, :j], np.full((300, 1), v), probe[:, j + 1 :]], 1)) for v in np.linspace(0, 1, 21)]
            assert (np.diff(scores, axis=0) <= 1e-12).all()
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.75


# 6


def slow_feistel(a, b, l, r, key, kind):  # noqa: E741
    for k in range(pii.ROUNDS):
        h = int(hashlib.sha256(":".join(map(str, (key, kind, k, r if k % 2 == 0 else l, a, b))).encode()).hexdigest()[:14], 16)
        if k % 2 == 0:
            l = (l + h % a) % a  # noqa: E741
        else:
            r = (r + h % b) % b
    return l, r


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


KEY = "a key of the tests"


def slow_digits(d, kind):
    u = len(d) // 2
    l, r = slow_feistel(10**u, 10 ** (len(d) - u), int(d[:u]), int(d[u:]), KEY, kind)  # noqa: E741
    return f"{l:0{u}d}{r:0{len(d) - u}d}"


def refilled(m, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), m)


def slow_card(m):
    groups, out, k, found = re.findall("[0-9]+[ -]*", m), "", 0, False
    while k < len(groups):
        for n in range(min(19, len(groups) - k), 0, -1):
            x = "".join(groups[k : k + n])
            d = re.sub("[^0-9]", "", x)
            if re.fullmatch("[0-9]+([ -][0-9]+)*[ -]*", x) and 13 <= len(d) <= 19 and luhn(d):
                body = d[0] + slow_digits(d[1:-1], "card")
                out += refilled(x, body + next(c for c in "0123456789" if luhn(body + c)))
                k, found = k + n, True
                break
        else:
            out, k = out + groups[k], k + 1
    return out if found else None


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x)) % 97


def slow_iban(m):
    groups = m.split(" ")
    for n in range(len(groups), 0, -1):
        x = "".join(groups[:n])
        if len(x) >= 13 and mod97(x[4:] + x[:4]) == 1 and len(re.sub("[^0-9]", "", x[4:])) >= 2:
            rest = refilled(x[4:], slow_digits(re.sub("[^0-9]", "", x[4:]), "iban"))
            it = iter(f"{x[:2]}{98 - mod97(rest + x[:2] + '00'):02d}{rest}")
            old = " ".join(groups[:n])
            return "".join(c if c == " " else next(it) for c in old) + m[len(old) :]
    return None


def slow_phone(m):
    d = re.sub("[^0-9]", "", m)
    if re.match(r"\+[2-9]", m):
        return refilled(m, d[:2] + slow_digits(d[2:], "phone")) if 8 <= len(d) <= 15 else None
    if not 10 <= len(d) <= 11:
        return None
    area, rest = int(d[-10:-7]), int(d[-7:])
    first, a = (200, 800) if area >= 200 else (0, 200)
    low, b = (0, 10_000_000) if area < 200 else (2_000_000, 8_000_000) if rest >= 2_000_000 else (0, 2_000_000)
    l, r = slow_feistel(a, b, area - first, rest - low, KEY, "phone")  # noqa: E741
    return refilled(m, d[:-10] + f"{l + first:03d}{r + low:07d}")


def slow_ssn(m):
    area, group, serial = (int(x) for x in m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    l, r = slow_feistel(898, 99 * 9999, area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, KEY, "ssn")  # noqa: E741
    return f"{l + (2 if l >= 665 else 1):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"


def slow_ip(m):
    p = [int(x) for x in m.split(".")]
    if max(p) > 255:
        return None
    l, r = slow_feistel(65536, 65536, p[0] * 256 + p[1], p[2] * 256 + p[3], KEY, "ip")  # noqa: E741
    return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"


def slow_date(m):
    import datetime

    first = datetime.date(1900, 1, 1)

    def day(y, mo, d):
        try:
            n = (datetime.date(int(y), int(mo), int(d)) - first).days
        except ValueError:
            return None
        return n if 0 <= n < 17 * 4297 else None

    def moved(n, kind):
        l, r = slow_feistel(17, 4297, n // 4297, n % 4297, KEY, kind)  # noqa: E741
        return l * 4297 + r

    if m[4] == "-":
        n = day(*m.split("-"))
        return None if n is None else (first + datetime.timedelta(moved(n, "date"))).isoformat()
    a, b, y = re.split(r"[/.]", m)
    sep = m[2]
    if (n := day(y, b, a)) is not None:
        return (first + datetime.timedelta(moved(n, "date"))).strftime(f"%d{sep}%m{sep}%Y")
    if sep == "/" and (n := day(y, a, b)) is not None:
        n = moved(n, "date-mdy")
        while (first + datetime.timedelta(n)).day <= 12:
            n = moved(n, "date-mdy")
        return (first + datetime.timedelta(n)).strftime("%m/%d/%Y")
    return None


SLOW_KINDS = {
    "email": lambda m: "p" + hashlib.sha256(f"{KEY}:email:{m.lower()}".encode()).hexdigest()[:24] + "@" + m.rpartition("@")[2], "secret": lambda m: hashlib.sha256(f"{KEY}:secret:{m}".encode()).hexdigest()[:40],
    "iban": slow_iban, "date": slow_date, "ssn": slow_ssn, "ip": slow_ip, "phone": slow_phone, "card": slow_card,
}


def slow_pii(text):
    """Text with pseudonyms and the kinds found, by plain functions; the forms are those of the module."""
    import regex

    kinds = []

    def put(m):
        for kind, make in SLOW_KINDS.items():
            if regex.fullmatch(pii.FORMS[kind], m[0]) and (new := make(m[0])) is not None:
                kinds.append(kind)
                return new
        return m[0]

    return regex.sub(pii.PATTERN, put, text), ",".join(kinds)


def test_pseudonyms_against_brute_force(spark, docs):
    texts = [
        "card 4111 1111 1111 1111, bad 4111 1111 1111 1112; 5500-0000-0000-0004.", "call +1 (741) 555-3069 or 741-555-3069 now", "ssn 123-45-6789 666-12-1234", "ip 128.212.154.77. and 300.1.1.1",
        "born 1984-02-29, 29/02/1984 and 31.12.1999 or 2023-02-30, 12/25/2020 and 13/13/2020 or 12.25.2020", "mail for.43@mail7.example.com.", 'token = "1c5c31775edb0e97c8e972c4a50a0d9e0560c638"',
        "iban DE89370400440532013000 and DE89370400440532013001, DE89 3704 0044 0532 0130 00 or GB82 WEST 1234 5698 7654 32 THE END", "4111111111111111", "+1 (041) 155-3069", "", "plain 12 text 3.4 and 12 34 56 78 90",
        "4111 1111 1111 1111 12/27 and 4111 1111 1111 1111 123 and 12 4111111111111111 but 123456 4111 1111 1111 1111 5500 0000 0000 0004 99x", "4111 1111 1111 1111abc 4111-1111 11111111  22",
        "+44 20 7946 0958, +49-30-901820 and +33123456789, +99 1", "1 " * 3000 + "4111 1111 1111 1111", "9" * 5000,
    ]
    rows = [(k, t) for k, t in enumerate([*texts, *(t for _, t in pairs(docs))])] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(0)).repartition(4)
    out = {r.doc_id: r for r in pii.pii_report(df, KEY).collect()}
    for k, t in rows:
        text, kinds = (None, "") if t is None else slow_pii(t)
        assert (out[k].text, out[k].kinds, out[k].n_found) == (text, kinds, len(kinds.split(",")) if kinds else 0), t
    of = lambda k: out[k].text
    card = re.search(r"card (\d{4}(?: \d{4}){3}),", of(0))[1]
    assert card[0] == "4" and luhn(card.replace(" ", "")) and "4111 1111 1111 1112" in of(0)
    # Equal values stay linked whatever stands beside them.
    assert of(8) == card.replace(" ", "") and of(12).startswith(f"{card} 12/27 and {card} 123 and 12 {of(8)} but 123456 {card} 5") and of(12).endswith(" 99x")
    iban = re.findall(r"DE[0-9 ]+?(?= and|, | or)", of(7))
    assert iban[0] == iban[2].replace(" ", "") and iban[1] == "DE89370400440532013001" and re.search(r" or GB\d\d WEST \d{4} \d{4} \d{4} \d\d THE END$", of(7))
    iso, d, m, y, us = re.search(r"born (\S+), (\d\d)/(\d\d)/(\d{4}) and .* or 2023-02-30, (\S+) and 13/13/2020 or 12.25.2020$", of(4)).groups()
    assert iso == f"{y}-{m}-{d}" and int(us[3:5]) > 12 and out[9].n_found == 1


def test_pii_key(spark):
    """Without a configured key a session has one of its own; the configured one counts."""
    df = spark.createDataFrame([(1, "mail a.b@example.com")], "doc_id long, text string")
    text = lambda: pii.pii_report(df).first().text
    own = text()
    assert own == text() and pii.key_of(spark) != KEY
    spark.conf.set(pii.KEY_CONF, KEY)
    try:
        assert text() == slow_pii("mail a.b@example.com")[0] != own
    finally:
        spark.conf.unset(pii.KEY_CONF)


def test_permutations_are_bijective(spark):
    df = spark.range(17 * 23).select(F.floor(F.col("id") / 23).alias("l"), (F.col("id") % 23).alias("r"))
    got = df.withColumn("m", pii.feistel(F.col("l"), F.col("r"), F.lit(17), F.lit(23), "k", "t")).select("l", "r", "m.*").toDF("l", "r", "a", "b").collect()
    assert len({(r.a, r.b) for r in got}) == 17 * 23
    assert all((r.a, r.b) == slow_feistel(17, 23, r.l, r.r, "k", "t") for r in got)


def test_pseudonymize_keeps_rows_and_columns(docs, odd, none):
    for df in (docs, odd):
        out = pii.pseudonymize(df)
        assert out.columns == df.columns and out.count() == df.count()
    assert pii.pii_report(none).collect() == []
    clean = docs.where("NOT text RLIKE '[0-9@]'")
    assert clean.exceptAll(pii.pseudonymize(clean)).count() == 0
    left = pii.pii_report(docs)
    before = {m for _, t in pairs(docs) for m in re.findall(r"\b[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}", t)}
    assert before and not any(m in (r.text or "") for r in left.collect() for m in before)


def test_pii_plan_has_no_python(docs):
    plan = pii.pii_report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7


def slow_line_dedup(rows, min_docs=2):
    number = lambda d, t: 2**63 - 1 - xxhash.xxh64_intdigest(t.encode(), 42) % 2**61 if d is None else d  # noqa: E731  modulo 2^61 of two's complement
    keys = defaultdict(set)
    for d, t in rows:
        for x in t.split("\n"):
            k = lowered(x.strip(" \t\n\v\f\r"))
            if len(k) >= 10:
                keys[k].add(number(d, t))
    out = []
    for d, t in rows:
        ls = t.split("\n")
        kept = [x for x in ls if not (len(keys.get(k := lowered(x.strip(" \t\n\v\f\r")), ())) >= min_docs and min(keys[k]) != number(d, t))]
        out.append((d, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(docs, odd, none):
    for df in (docs, odd):
        assert sorted(map(tuple, lines.line_report(df).collect()), key=repr) == slow_line_dedup(pairs(df))
    assert lines.line_report(none).collect() == []
    assert sorted(map(tuple, lines.line_report(docs, min_docs=4).collect()), key=repr) == slow_line_dedup(pairs(docs), 4)
    unnamed = odd.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert sorted(map(tuple, lines.line_report(unnamed).collect()), key=repr) == slow_line_dedup(pairs(unnamed))
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert [r.text for r in out.where("doc_id = 2").collect()] == ["other line of mine"]


# 8


def test_segments_are_all_maximal_ones():
    """Against the definition: recursively the best segment, then what is left and right of it; places and scores."""

    def slow(scores, offset=0):
        best = max(((sum(scores[a:b]), -a, -b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 1e-9:
            return []
        _, _, _, a, b = best
        return slow(scores[:a], offset) + [(a + offset, b + offset, best[0])] + slow(scores[b:], offset + b)

    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(1, 14))
        hit = rng.random(n) < 0.4
        scores = [float(rng.uniform(1, 40)) if h else -7.0 for h in hit]  # no ties
        places = [k for k in range(n) if hit[k]]
        got = toxicity.segments(places, [scores[k] for k in places], n, 7.0)
        want = slow(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_toxicity_report_against_brute_force(docs, labels):
    """Every row's score, segments and verdict from the trained model, by the definition on whole texts."""
    model = toxicity.train(docs, labels)
    texts = dict(pairs(docs))
    for r in toxicity.toxicity_report(docs, labels).collect():
        words = toxicity.words_of(texts[r.doc_id].encode())
        known = {w: max((model.score[f] for f in toxicity.features_of(w) if f in model.score), default=-model.drift) for w in set(words)}
        total, left, best = 0.0, 0.0, 0.0
        for w in words:  # the best segment's score, by the least running total so far
            total += known[w]
            left = min(left, total)
            best = max(best, total - left)
        e = (model.decay * best - np.log(model.size * len(words))) / np.log(10) if best else 0.0
        assert max(0.0, e) == pytest.approx(model.evidence(words)[0], abs=1e-6)
        assert r.score == pytest.approx(model.probability(model.evidence(words))) and r.predicted == int(r.score >= 0.7)
    counts = {r.feature: (r.n1, r.n0) for r in toxicity.feature_counts(docs.join(labels, "doc_id").select("toxic", "text")).collect()}
    slow = defaultdict(lambda: [0, 0])
    for r in docs.join(labels, "doc_id").collect():
        for f in {f for w in toxicity.words_of((r.text or "").encode()) for f in toxicity.features_of(w)}:
            slow[f][1 - r.toxic] += 1
    assert counts == {f: tuple(n) for f, n in slow.items()}


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    r = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    score, toxic = np.array([x.score for x in r]), np.array([x.toxic for x in r])
    rank = score.argsort().argsort()
    auc = (rank[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (toxic == 0).sum()
    assert auc > 0.93 and ((score >= 0.7) & (toxic == 0)).mean() < 0.01


def test_toxicity_cases(edge, none, labels):
    out = toxicity.toxicity_report(edge, labels).collect()
    assert len(out) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert {r.score for r in out if r.doc_id in (3, 4, 5)} == {out[3].score}
    assert toxicity.toxicity_report(none, labels).collect() == []
    assert all(r.score == 0 for r in toxicity.toxicity_report(edge, labels.limit(0)).collect())
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_toxicity_learns_from_the_stated_rows(spark, monkeypatch):
    """A word that only 60 of 60,000 labelled rows hold has its score, whether ids are broadcast or joined; a bound holds about."""
    ids = spark.range(90_000).select(F.col("id").alias("doc_id"))
    rare = F.col("doc_id") % 1000 < 1
    docs = ids.withColumn("text", F.concat(F.lit("plain words "), F.col("doc_id").cast("string"), F.when(rare, F.lit(" vilest")).otherwise(F.lit(""))))
    labels = ids.withColumn("toxic", rare.cast("int"))
    counts, real = [], toxicity.feature_counts
    monkeypatch.setattr(toxicity, "feature_counts", lambda rows: counts.append(real(rows)) or counts[-1])
    want = toxicity.training_rows(labels)
    toxic, n = want.where("toxic = 1").count(), want.count()
    for most in (toxicity.BROADCAST_IDS, 10):
        monkeypatch.setattr(toxicity, "BROADCAST_IDS", most)
        assert "vilest$" in toxicity.train(docs, labels).score
        got = {r.feature: (r.n1, r.n0) for r in counts[-1].where("feature IN ('plain$', 'vilest$')").collect()}
        assert n > 55_000 and got == {"plain$": (toxic, n - toxic), "vilest$": (toxic, 0)}
    assert abs(common.some_rows(want, 6000, "x", "doc_id").count() - 6000) < 400 and common.some_rows(want, n, "x", "doc_id").count() == n


# 9


def slow_targets(sizes):
    """Shares by weight; above three times the size the excess is shared again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def check_mix(df):
    """Targets as defined, words near them, copies whole, and the mixture itself has as many rows of each document."""
    got = mixing.mix_report(df).collect()
    assert len(got) == df.count()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_report(df.repartition(3)).collect()), key=repr)
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    sizes, taken, mean = defaultdict(int), defaultdict(int), defaultdict(list)
    for r in df.select("source", F.coalesce("text", F.lit("")).alias("text")).collect():
        sizes[r.source] += len(words_of(r.text))
        mean[r.source].append(len(words_of(r.text)))
    expected = slow_targets(sizes)
    for r in got:
        assert r.taken == r.copies * r.size <= 3 * r.size
        if r.doc_id is not None:
            s = source[r.doc_id]
            assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
    out = mixing.mix(df)
    assert out.columns == df.columns
    there, wanted = defaultdict(int), defaultdict(int)
    for r in out.collect():
        taken[r.source] += len(words_of(r.text or ""))
        there[r.doc_id] += 1
    for r in got:
        wanted[r.doc_id] += r.copies
    assert sum(taken.values()) == sum(r.taken for r in got)
    assert there == {d: n for d, n in wanted.items() if n}
    return {s: (taken[s], expected[s], min((m for m in mean[s] if m), default=0)) for s in sizes}


def test_mixing(docs, odd, none):
    for taken, target, _ in check_mix(docs).values():  # sources of ten documents
        assert abs(taken - target) <= 0.05 * target
    check_mix(odd)
    assert mixing.mix_report(none).collect() == [] == mixing.mix(none).collect()


def test_mixing_of_repeated_rows(spark):
    """Equal rows are taken one by one, with or without a doc_id, whatever other columns they carry."""
    rows = [(1, "a b c d", "s")] * 7 + [(2, "x y z", "t")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = check_mix(df)
    assert got["t"][0] in (9, 12) and abs(got["s"][0] - got["s"][1]) <= 4  # a target of 10.57
    rows = [(None, "same words here", "b", k, k) for k in range(200)] + [(None, f"other words {k}", "b", k, k) for k in range(100)] + [(k % 9, "one two", "c", k, k) for k in range(300)] + [(1000 + k, "w " * k, None, k, k) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long, some long")
    for taken, target, least in check_mix(df.repartition(7)).values():
        assert abs(taken - target) <= max(0.02 * target, least)
    assert mixing.mix(df).groupBy("copies", "some", "doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 3


def test_mixing_of_many_sources(spark):
    rows = [(k, "word " * (1 + k % 37), f"site{k % 700:04d}" if k % 700 else None) for k in range(6000)]
    sums = check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5))
    assert sum(t for t, _, _ in sums.values()) == pytest.approx(sum(t for _, t, _ in sums.values()), rel=0.02)


def test_pareto_samples_have_a_fixed_size(spark):
    """Every class gives as many documents as planned, and larger ones of a class come in more often."""
    rng = np.random.default_rng(23)
    rows = [(k, "w " * int(rng.choice([64, 71])), "a") for k in range(400)] + [(1000 + k, "w " * 64, "b") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    large = small = 0
    for seed in ("1", "2", "3"):
        got = [r for r in mixing.mix_report(docs, weights=(1, 40), seed=seed).collect() if r.doc_id < 1000]
        assert len({r.target for r in got}) == 1 and 0 < got[0].target < got[0].source_size
        assert sum(r.copies for r in got) == np.floor(got[0].target / (got[0].source_size / 400) + 0.5)
        large, small = large + sum(r.copies for r in got if r.size == 71), small + sum(r.copies for r in got if r.size == 64)
    n = sum(1 for r in got if r.size == 71)
    assert large / n > small / (400 - n)


def test_mixing_plan_has_no_python(docs):
    assert not re.search("Python|Pandas|Arrow", mixing.mix_report(docs)._jdf.queryExecution().toString())


# 10


def slow_repeats(rows, length=50):
    first = {}
    for d, t in rows:
        for k in range(len(t) - length + 1):
            s = t[k : k + length]
            first[s] = min(d, first.get(s, d))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < d:
                gone[k + 1 : k + length + 1] = True
        edges = np.flatnonzero(np.diff(gone.astype(int)))
        kept = bytes(b for b, g in zip(t, gone[1:-1], strict=True) if not g)
        out.append((None if d == repeats.LAST else d, len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def raw(df):
    return [(repeats.LAST if d is None else d, t.encode()) for d, t in pairs(df)]


@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, docs, none, small, monkeypatch):
    if small:
        monkeypatch.setattr(repeats, "BATCH_BYTES", 20_000)
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 30_000)
        monkeypatch.setattr(repeats, "CROWD", 1)
    assert sorted(map(tuple, repeats.repeat_report(docs).collect()), key=repr) == slow_repeats(raw(docs))
    text = "abcdefghij" * 5 + "klmnopqrst" * 4 + "x"
    rows = [(5, text), (3, "zz" + text[1:] + "yy"), (9, text), (9, "new " + text[:55]), (None, text), (None, None), (1, ""), (7, "é" * 60), (8, "é" * 60 + "!"), (2, "\0" * 120), (4, "\0" * 51)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("batch", F.lit("b"))
    assert sorted(map(tuple, repeats.repeat_report(df).collect()), key=repr) == slow_repeats(raw(df))
    assert repeats.repeat_report(none).collect() == []


def test_batches_grow_with_the_input():
    assert repeats.sizes_for(0) == repeats.sizes_for(10**11) == (4 << 20, 4 << 20)
    assert repeats.sizes_for(4 * 10**12) == (4 * 10**12 // repeats.PARTS,) * 2 and repeats.sizes_for(10**14) == (32 << 20, 64 << 20)


def test_intervals_of_a_transform():
    rng = np.random.default_rng(7)
    for length in (3, 8, 50):
        for end in (b"", b"\0", b"\0" * 70):
            text = bytes(rng.choice(list(b"ab\0"), 400).tolist()) * 2 + bytes(rng.choice(list(b"abc"), 300).tolist()) + end
            order, border = repeats.repeated_intervals(np.frombuffer(text, np.uint8), length)
            at = [text[k : k + length] for k in order]
            assert at == sorted(at) and sorted(order) == list(range(len(text)))
            for k in range(1, len(at)):
                if len(at[k]) == len(at[k - 1]) == length:
                    assert border[k] == (at[k] != at[k - 1])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(9)
    passage = bytes(rng.integers(97, 123, 90, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) + passage + b"tail" * 9 for n in (3, 70_000, 11)]
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    blob = b"".join(texts)
    first, last, place, h, doc = repeats.anchored(np.frombuffer(blob, np.uint8), starts)
    seen = defaultdict(set)
    for a, b, p, x, d in zip(first, last, place, h, doc, strict=True):
        for k in range(a, b + 1):
            assert starts[d] <= k and k + 50 <= starts[d + 1] and k <= p <= k + 50 - repeats.ANCHOR
            seen[blob[k : k + 50]].add((int(x), int(p - k)))
    assert all(len(v) == 1 for v in seen.values()) and len(seen) > 1000
    assert (last - first + 1).sum() == sum(len(t) - 49 for t in texts)


# Pipeline and registration


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mix sources", "bpe encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    now = docs
    for name, stage in p.STAGES:
        step = stage(spark, now, sf)
        now = spark.createDataFrame(step.collect(), step.schema)
        kept[name] = now
        if name != "bpe encoding":
            assert now.columns == docs.columns
    good = {r.doc_id for r in quality.quality_report(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
    assert {r.doc_id for r in kept["quality rules"].collect()} == good
    expected = {d: (n, h) for d, n, _, h in slow_line_dedup(pairs(kept["quality rules"]))}
    assert all(hashlib.sha256(t.encode()).hexdigest() == expected[d][1] for d, t in pairs(kept["line dedup"]))
    single = pairs(kept["simhash near-dedup"])
    sets = {d: slow_shingles(t) for d, t in single}
    assert len(single) == len(sets) <= kept["line dedup"].count()
    assert not any(sets[a] and sets[a] == sets[b] for a in sets for b in sets if a < b)
    ran = sorted((r.doc_id, r.n_tokens) for r in p.run(spark, sf).collect())
    assert ran == sorted((r.doc_id, r.n_tokens) for r in kept["bpe encoding"].collect()) and sum(n for _, n in ran) > 0


def test_registered():
    import __spark_entry__ as e

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries()) and set(queries.ORACLES) <= set(e.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{t}'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    answer = con.execute(queries.ORACLES[name])
    at = [d[0] for d in answer.description]
    norm = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(at) == columns
    assert sorted(tuple(norm(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(norm(r[at.index(c)]) for c in columns) for r in answer.fetchall())
