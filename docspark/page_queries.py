"""More registered queries: views and escapes of annotations, attribution, zones, maps, masks of many symbols, colours, tiles and answers as JSON.

As in ``queries``, table rows are packed as documents and asked back, and each query has DuckDB SQL that knows the rows alone.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.encode import pack
from docspark.encode.pack import Component, ZoneTree
from docspark.functions import native
from docspark.functions.arrow import flat_map
from docspark.kernels.iw44 import encode_iw44
from docspark.kernels.jb2 import encode_jb2
from docspark.kernels.mmr import encode_mmr
from docspark.operators import links, zones
from docspark.plans.document_set import DocumentSet
from docspark.queries import _bits, _ink, _key, _pack, _page, _quoted, _spread, _t, _whole
from docspark.sources import sinks

# Pages and geometry


def page_versions(spark, sf_dir):
    """INFO payloads of 5 to 10 bytes: versions of one or two bytes, and defaults where the rest is missing."""
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 251, F.col("o_custkey") % 3, F.col("o_orderkey") % 6)

    def call(d, low, high, more):
        rest = bytes([(255, 1, 0)[high], 44, 1, 18, 1])[:more]
        yield d, pack.document(pack.form("DJVU", pack.chunk("INFO", b"\0\x07\0\x05" + bytes([low]) + rest)))

    return _whole(_pack(rows, call)).pages().select(_key("o_orderkey"), "version", "dpi", "gamma_tenths", "rotation", "status")


def _asked(spark, sf_dir):
    """Pages of 37 x 29 with a stored turn, and a request a customer: reduction or box, turn, and the corner of a region."""
    key = F.col("c_custkey")
    c = _t(spark, sf_dir, "customer").select("c_custkey", (key % 4).cast("string").alias("doc_id"), F.lit(0).alias("page"), F.floor(key / 4).alias("q"))
    pick = lambda e: e.cast("int")
    sized = F.col("q") % 2 == 1
    region = F.col("q") % 3 == 0
    c = c.withColumns({
        "subsample": pick(F.when(sized, 1).otherwise(F.col("q") % 7)), "box_width": pick(F.when(sized, F.col("q") % 50)), "box_height": pick(F.when(sized, F.col("q") % 41 + 1)), "rotation": pick(F.col("q") % 4),
    })
    return c.withColumns({n: pick(F.when(region, v)) for n, v in (("x", F.col("q") % 5), ("y", F.col("q") % 2), ("width", F.lit(3)), ("height", F.lit(4)))})


def affine_maps(spark, sf_dir):
    """Maps between pages and outputs in millionths, under stored and asked turns, reductions, boxes and regions; statuses of bad requests."""
    files = spark.createDataFrame([(str(r), bytearray(_page(width=37, height=29, rotation=r))) for r in range(4)], "doc_id string, content binary")
    g = _whole(files).geometry(_asked(spark, sf_dir))
    entry = lambda c, k: F.round(F.col(c)[k] * 1e6).cast("bigint").alias(f"{c[2]}{k}")
    return g.select("c_custkey", "status", *[entry("t.matrix", k) for k in range(6)], *[entry("t.inverse", k).alias(f"i{k}") for k in range(6)])


def layer_factors(spark, sf_dir):
    """The factor that leads from a page to a layer; every third layer is one pixel off."""
    p = _spread(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", (F.col("p_partkey") * 7 % 500 + 1).alias("w"), (F.col("p_partkey") * 3 % 400 + 1).alias("h"), (F.col("p_size") % 12 + 1).alias("r"))
    layer_w, layer_h = F.ceil(F.col("w") / F.col("r")), F.ceil(F.col("h") / F.col("r")) + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)
    return p.select("p_partkey", native.layer_reduction(F.col("w"), F.col("h"), layer_w, layer_h).cast("bigint").alias("factor"))


def tile_reductions(spark, sf_dir):
    """Whole reductions for a zoom, so that the display has enough pixels and at most 24 tiles are in view."""
    p = _spread(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", (F.col("p_partkey") * 37 % 30_000 + 1).alias("w"), (F.col("p_partkey") * 53 % 30_000 + 1).alias("h"), (1 / (F.col("p_size") % 16 + 1)).alias("zoom"))
    s = native.subsample_for(F.col("w"), F.col("h"), F.col("zoom"), F.lit(1000), F.lit(800), F.lit(1.0))
    return p.select("p_partkey", s.cast("bigint").alias("subsample"))


# Annotations and metadata

ZOOMS = ("page", "d75", "d0", "stretch", "d1000", "one2one", "width", "d999")


def stored_views(spark, sf_dir):
    """Background, zoom, mode, alignment and headers from two chunks, one of them cut inside an expression; of two values the last valid one counts."""
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.coalesce("s_name", F.lit("")))

    def call(key, nation, name):
        first = f"(background #{key % 4096:06X})(zoom width)(mode {('color', 'bw', 'fore', 'back', 'other')[key % 5]})(phead {_quoted('left::' + name)} {_quoted('center::c')})"
        second = f"(zoom {ZOOMS[key % 8]})(align {('left', 'center', 'right')[nation % 3]} {('top', 'bottom', 'odd')[key % 3]})(background #{'12' if key % 2 else '0012ab'})(pfoot {_quoted(f'right::{nation}')})"
        whole = first + second
        cut = len(first) + 5
        yield str(key), _page(pack.annotations(whole[:cut].encode()), pack.annotations(whole[cut:].encode(), compressed=key % 2 == 1))

    a = _whole(_pack(rows, call, 256)).annotations()
    return a.select(_key("s_suppkey"), "view.background", "view.zoom", "view.mode", F.col("view.alignment.horizontal").alias("horizontal"), "header.left", "header.center", F.col("footer.right").alias("foot"), F.size("chunks").alias("n_chunks"), "status")


def annotation_escapes(spark, sf_dir):
    """Strings with escapes; one that is no escape (every third row) turns those of the whole stream into plain text but for quotes."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.coalesce("p_name", F.lit("")))

    def call(key, name):
        yield str(key), _page(pack.annotations(f'(metadata (a "{name}\\t\\"\\101\\\\z") (b "{"1q" if key % 3 else chr(92) + "q"}"))'.encode()))

    a = _whole(_pack(rows, call)).annotations().select(_key("p_partkey"), "legacy_escapes", F.posexplode("metadata").alias("seq", "m"))
    return a.groupBy("p_partkey", "legacy_escapes").agg(F.max(F.when(F.col("m.key") == "a", F.col("m.value"))).alias("a"), F.max(F.when(F.col("m.key") == "b", F.col("m.value"))).alias("b"))


def metadata_attribution(spark, sf_dir):
    """A document a region: shared metadata that every page includes counts once and for no page, each page's own twice if it stands there twice."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.groupBy(F.col("r_regionkey").cast("string").alias("doc_id"), "r_name").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))

    def call(d, region, nations):
        shared = Component("s", "shared", pack.form("DJVI", pack.annotations(f"(metadata (region {_quoted(region)}))(xmp {_quoted('<' + region + '>')})".encode())))
        stray = Component("t", "shared", pack.form("DJVI", pack.annotations(b'(metadata (stray "kept"))')))
        own = lambda n: f"(metadata (nation {_quoted(n)}) (twice \"x\") (twice \"x\"))".encode()
        yield d, pack.bundle([shared, *(Component(f"p{k}", "page", pack.form("DJVU", pack.info(5, 5), pack.include("s"), pack.annotations(own(n["n_name"])))) for k, n in enumerate(nations)), stray])

    d = _whole(_pack(rows.select("doc_id", "r_name", "nations"), call))
    entries = d.metadata().select("doc_id", "key", "value", "page").unionByName(d.xmp().select("doc_id", F.lit("xmp").alias("key"), "value", "page"))
    return entries.select(_key("r_regionkey"), "key", "value", F.col("page").cast("bigint").alias("page"))


# Text and zones


def damaged_spans(spark, sf_dir):
    """Texts in ASCII with every 7th byte overwritten by 0xFF: repaired text, and a span of it repaired on its own."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F]", "?")

    def call(d, text):
        raw = bytearray(text.encode())
        raw[::7] = b"\xff" * len(raw[::7])
        yield d, _page(pack.text(bytes(raw)))

    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), plain)
    t = _whole(_pack(rows, call, 256)).text()
    start = F.col("doc_id").cast("bigint") % 11
    return t.select(_key("doc_id"), "has_replacements", "text", native.span_text(F.col("bytes"), start, F.lit(20)).alias("span"), F.length("bytes").cast("bigint").alias("n_bytes"))


def _word_pages(spark, sf_dir):
    """A page a part: the characters of its name in a grid of cells of 10 x 10, words of 7 x 8 with a character zone below each; the last is empty."""

    def call(key, name):
        data, words = name.encode(), []
        for k in range(len(data)):
            x, y = 10 * (k % 9), 10 * (k // 9)
            words.append(ZoneTree("word", x, y, 7, 8, k, 0 if k == len(data) - 1 else 1, [ZoneTree("character", x, y, 4, 8, k, 1)]))
        yield str(key), _page(pack.text(data, ZoneTree("page", 0, 0, 100, 100, 0, len(data), words), 100))

    rows = _t(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.coalesce("p_name", F.lit("")), r"[^\x00-\x7F]", "?"))
    return _whole(_pack(rows, call, 256))


def zone_descendants(spark, sf_dir):
    """Characters below words, as intervals of the preorder."""
    below = zones.descendants_in(_word_pages(spark, sf_dir).page_zones(), "character", "word")
    return below.groupBy(_key("p_partkey")).agg(F.count("*").alias("n"), F.sum(F.col("idx") - F.col("ancestor")).cast("bigint").alias("steps"), F.max("ancestor").cast("bigint").alias("last_word"))


def zone_hits(spark, sf_dir):
    """The word under a point, the one nearest to another point, and the text between the two; all inside a page's row."""
    key = F.col("doc_id").cast("bigint")
    z = _word_pages(spark, sf_dir).page_zones(selectable_only=True).withColumn("zones", F.filter("zones", lambda z: z["kind"] == "word"))
    words = F.col("zones")
    hits = z.withColumns({"a": zones.hit_in(words, 10 * (key % 3) + 4, F.lit(4)), "b": zones.hit_in(words, 10 * (key % 3) + 9, F.lit(5), nearest=True)}).where("a IS NOT NULL")
    s = hits.withColumn("s", zones.selection_in(words, F.col("a"), F.col("b")))
    return s.select(_key("p_partkey"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.col("s.start").cast("bigint").alias("start"), F.col("s.end").cast("bigint").alias("until"))


def outline_answers(spark, sf_dir):
    """Outlines as JSON: entries in preorder, absent parents as null."""
    n = _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))

    def call(d, nations):
        yield d, pack.bundle([Component("p", "page", pack.form("DJVU", pack.info(5, 5)))], pack.outline([("all", "#1", len(nations)), *((x["n_name"], f"#{x['n_nationkey']}", 0) for x in nations)]))

    return sinks.outline_json(_whole(_pack(n, call)).outline()).select(_key("r_regionkey"), "json")


def text_answers(spark, sf_dir):
    """Texts as JSON: bytes stand there, as numbers, only where the text was damaged (every third document)."""

    def call(key, name):
        yield str(key), _page(pack.text(name.encode() + (b"" if key % 3 else b"\xff")))

    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce("s_name", F.lit("")))
    return sinks.text_json(_whole(_pack(rows, call)).text()).select(_key("s_suppkey"), "json")


# Components


def include_gaps(spark, sf_dir):
    """Indirect documents whose pages include a component that is not there: what pages lack, by scope."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey")
    lists = orders.groupBy("doc_id").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    page = lambda k: pack.form("DJVU", pack.info(5, 5), pack.include(f"s{k % 2}"))
    shared = pack.form("DJVI", pack.chunk("NOTE", b"x"))

    def call(d, keys):
        yield d, pack.indirect([Component("s0", "shared", shared), Component("s1", "shared", shared), *(Component(f"o{k}", "page", page(k)) for k in keys)])[0]

    there = orders.where("o_orderkey % 5 <> 0").select("doc_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(pack.document(page(0)))).otherwise(F.lit(pack.document(page(1)))).alias("content"))
    there = there.unionByName(lists.select("doc_id", F.lit("s0").alias("name"), F.lit(pack.document(shared)).alias("content")))
    m = DocumentSet(_pack(lists, call, 256), there).missing("includes")
    return m.select(_key("o_custkey"), F.col("page").cast("bigint").alias("page"), "id")


def component_table(spark, sf_dir):
    """Components of bundles: ids, kinds, sizes and places, and how many chunks each has."""
    turns = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def call(d, turns):
        yield d, pack.bundle([Component("n", "shared", pack.form("DJVI", pack.chunk("NOTE", b"abc"))), *(Component(f"p{k}", "page", pack.form("DJVU", pack.info(9, 9), pack.chunk("SAID", t["text"].encode())), f"page-{k}", f"title {k}") for k, t in enumerate(turns))])

    d = _whole(_pack(turns, call, 256))
    counts = d.chunks().groupBy("doc_id", "comp").agg(F.count("*").alias("n_chunks"))
    c = d.components().join(counts, ["doc_id", "comp"])
    return c.select(_key("conv_id"), F.col("comp").cast("bigint").alias("comp"), "id", "name", "title", "kind", F.col("size").cast("bigint").alias("size"), (F.col("range_length") == F.col("size")).alias("whole"), "n_chunks", "status")


def href_checks(spark, sf_dir):
    """Hrefs as bytes: ones that are no UTF-8 or longer than an input may be are refused."""
    c = _t(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), "c_custkey", F.lit(None).cast("int").alias("from_page"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.unhex(F.lit("23FF41"))).when(F.col("c_custkey") % 3 == 1, F.lit(bytearray(b"#1"))).otherwise(F.lit(bytearray("#é".encode())))
    pages = spark.createDataFrame([("d", 0, "é", "n", "t")], "doc_id string, page int, id string, name string, title string")
    from docspark.kernels.core import Limits

    few = links.resolve_links(c.withColumn("href", raw), pages, Limits(input_bytes=2))
    return few.select("c_custkey", F.col("link.kind").alias("kind"), F.col("link.page").cast("bigint").alias("page"))


# Rasters


def _squares(spark, sf_dir) -> DataFrame:
    """An order's lines as (left, bottom) of squares of 3 x 3, in order."""
    li = _t(spark, sf_dir, "lineitem")
    at = F.struct("l_linenumber", (F.col("l_partkey") % 7).alias("x"), (F.col("l_suppkey") % 7).alias("y"))
    return li.groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(at)).alias("at"))


def shared_symbols(spark, sf_dir):
    """Masks whose one symbol comes from a dictionary that the pages include; every copy is placed by row and column."""
    square = np.ones((3, 3), np.uint8)
    dictionary = Component("dict", "shared", pack.form("DJVI", pack.chunk("Djbz", encode_jb2(0, 0, [(square, 0, 0)]))))

    def call(d, at):
        blits = [(square, a["x"], a["y"]) for a in at]
        page = pack.form("DJVU", pack.info(9, 9), pack.include("dict"), pack.chunk("Sjbz", encode_jb2(9, 9, blits, [square])))
        yield d, pack.bundle([dictionary, Component("p", "page", page)])

    return _ink(_whole(_pack(_squares(spark, sf_dir), call)).render(), "l_orderkey")


def refined_symbols(spark, sf_dir):
    """Masks of two symbols of one size, the second coded as a change of the first."""

    def call(d, bits):
        p = np.array(bits, np.uint8).reshape(-1, 8)
        h = len(p) // 2
        yield d, _page(pack.chunk("Sjbz", encode_jb2(8, 2 * h, [(p[:h][::-1], 0, h), (p[h:][::-1], 0, 0)], refine=True)), width=8, height=2 * h)

    return _ink(_whole(_pack(_bits(spark, sf_dir), call)).render(), "vec_id")


def palette_render(spark, sf_dir):
    """Squares in four colours of a palette, drawn in order: pixels by colour of the rendered page."""
    square = np.ones((3, 3), np.uint8)
    colors = [(10, 0, 0), (20, 0, 0), (30, 0, 0), (40, 0, 0)]

    def call(d, at):
        mask = encode_jb2(9, 9, [(square, a["x"], a["y"]) for a in at])
        yield d, _page(pack.chunk("Sjbz", mask), pack.palette(colors, [a["l_linenumber"] % 4 for a in at]), width=9, height=9)

    def counted(doc_id, rgba):
        red = np.frombuffer(rgba, np.uint8)[::4]
        yield from ((doc_id, v // 10 - 1, int(n)) for v, n in zip(*(x.tolist() for x in np.unique(red, return_counts=True)), strict=True) if v != 255)

    r = _whole(_pack(_squares(spark, sf_dir), call)).render()
    return flat_map(r.select("doc_id", "rgba"), "doc_id string, color long, n long", counted).select(_key("l_orderkey"), "color", "n")


def _masks(spark, sf_dir, rotation=0):
    def call(d, bits):
        p = np.array(bits, np.uint8).reshape(-1, 8)
        yield d, _page(pack.chunk("Smmr", encode_mmr(p)), width=8, height=len(p), rotation=(int(d) if d is not None else 0) % 4 if rotation else 0)

    return _pack(_bits(spark, sf_dir), call)


def tiles_of_masks(spark, sf_dir):
    """The left half of each page and its right half, as two requests: ink of each."""
    files = _masks(spark, sf_dir)
    pages = _whole(files).pages().select("doc_id", "page", "height")
    halves = F.array(*[F.struct(F.lit(n).alias("request_id"), F.lit(x).alias("x")) for n, x in (("left", 0), ("right", 4))])
    asked = pages.select("doc_id", "page", F.explode(halves).alias("h"), F.lit(0).alias("y"), F.lit(4).alias("width"), "height").select("doc_id", "page", "h.*", "y", "width", "height")
    r = _whole(files).render(asked).where("status = 'ok'")

    def ink(doc_id, request_id, rgba):
        yield doc_id, request_id, int((np.frombuffer(rgba, np.uint8)[::4] == 0).sum())

    return flat_map(r.select("doc_id", "request_id", "rgba"), "doc_id string, half string, ink long", ink).select(_key("vec_id"), "half", "ink")


def rotated_masks(spark, sf_dir):
    """Pages with a stored turn: size of the rendered page, and the sum of the places of its ink."""
    r = _whole(_masks(spark, sf_dir, rotation=1)).render()

    def places(doc_id, width, height, rgba):
        ys, xs = np.nonzero(np.frombuffer(rgba, np.uint8)[::4].reshape(height, width) == 0)
        yield doc_id, width, height, int(xs.sum()), int(ys.sum())

    return flat_map(r.select("doc_id", "width", "height", "rgba"), "doc_id string, width long, height long, xs long, ys long", places).select(_key("vec_id"), "width", "height", "xs", "ys")


def averaged_masks(spark, sf_dir):
    """Pages fitted into a box of half their size: every pixel is the exact mean of four."""
    files = _masks(spark, sf_dir)
    asked = _whole(files).pages().select("doc_id", "page", F.lit(4).alias("box_width"), F.floor(F.col("height") / 2).cast("int").alias("box_height"))
    r = _whole(files).render(asked).where("status = 'ok'")

    def values(doc_id, rgba):
        yield from ((doc_id, k, int(v)) for k, v in enumerate(np.frombuffer(rgba, np.uint8)[::4]))

    return flat_map(r.select("doc_id", "rgba"), "doc_id string, cell long, value long", values).select(_key("vec_id"), "cell", "value")


@lru_cache(4096)
def _picture(phase: int, size: int) -> np.ndarray:
    y, x = np.mgrid[: size % 29 + 20, : size % 23 + 20]
    return np.clip(128 + 70 * np.sin((x + phase) / 9) + 50 * np.cos(y / 7), 0, 255).astype(np.uint8)


@lru_cache(4096)
def _waves(phase: int, size: int) -> bytes:
    """A document of a picture; pictures repeat, and each is drawn and encoded once a worker."""
    return pack.document(pack.form("PM44", *(pack.chunk("PM44", c) for c in encode_iw44(_picture(phase, size), (60, 60)))))


def wavelet_waves(spark, sf_dir):
    """Pictures that are not constant, through the wavelet codec: whether every sample came back within six levels, and both means within one."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.col("p_size"))

    def call(d, size):
        yield d, _waves(int(d) % 13, size)

    r = _whole(_pack(rows, call)).render().where("status = 'ok'").join(rows.toDF("doc_id", "p_size"), "doc_id")

    def compare(doc_id, width, height, rgba, size):
        got, want = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[:, :, 1].astype(int), _picture(int(doc_id) % 13, size).astype(int)
        yield doc_id, width, height, bool(np.abs(got - want).max() <= 6), bool(abs(got.mean() - want.mean()) <= 1)

    out = flat_map(r.select("doc_id", "width", "height", "rgba", "p_size"), "doc_id string, width int, height int, near boolean, mean_near boolean", compare)
    return out.select(_key("p_partkey"), "width", "height", "near", "mean_near")


def stored_thumbnails(spark, sf_dir):
    """Documents with stored thumbnails of the pages behind them: sizes and gray levels."""
    n = _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))

    def call(d, keys):
        images = [pack.chunk("TH44", encode_iw44(np.full((k % 5 + 3, k % 4 + 6), 9 * k + 8, np.uint8), (100,))[0]) for k in keys]
        pages = [Component(f"p{k}", "page", pack.form("DJVU", pack.info(50, 40))) for k in keys]
        yield d, pack.bundle([Component("t", "thumbnail", pack.form("THUM", *images)), *pages])

    r = _whole(_pack(n, call)).thumbnails()

    def gray(doc_id, page, width, height, rgba, status):
        yield doc_id, page, width, height, None if rgba is None else int(np.frombuffer(rgba, np.uint8)[0]), status

    out = flat_map(r.select("doc_id", "page", "width", "height", "rgba", "status"), "doc_id string, page long, width int, height int, gray int, status string", gray)
    return out.select(_key("r_regionkey"), "page", "width", "height", "gray", "status")


QUERIES = {
    f.__name__: f
    for f in (
        page_versions, affine_maps, layer_factors, tile_reductions, stored_views, annotation_escapes, metadata_attribution, damaged_spans, zone_descendants, zone_hits, outline_answers, text_answers,
        include_gaps, component_table, href_checks, shared_symbols, refined_symbols, palette_render, tiles_of_masks, rotated_masks, averaged_masks, wavelet_waves, stored_thumbnails,
    )
}

_ASKED = """
SELECT c_custkey, c_custkey % 4 AS stored, c_custkey // 4 AS q, (c_custkey // 4) % 2 = 1 AS sized, (c_custkey // 4) % 3 = 0 AS part FROM customer"""
_FITTED = f"""
SELECT *, CASE WHEN sized THEN 1 ELSE q % 7 END AS ss, q % 50 AS bw, q % 41 + 1 AS bh, (stored + q % 4) % 4 AS turn, CASE WHEN part THEN q % 5 ELSE 0 END AS x, CASE WHEN part THEN q % 2 ELSE 0 END AS y FROM ({_ASKED})"""
_TURNED = f"SELECT *, CASE WHEN turn % 2 = 1 THEN 29 ELSE 37 END AS w, CASE WHEN turn % 2 = 1 THEN 37 ELSE 29 END AS h FROM ({_FITTED})"
_SQUARES = """
SELECT l_orderkey, l_linenumber, l_partkey % 7 + k % 3 AS x, l_suppkey % 7 + k // 3 AS y FROM lineitem, range(9) r(k)"""
_INKED = """
SELECT vec_id, k % 8 AS x, k // 8 AS y, greatest(2, (len(e) + 15) // 16 * 2) AS h FROM (SELECT vec_id, e, unnest(range(len(e))) AS k FROM (SELECT vec_id, coalesce(embedding, []) AS e FROM embeddings)) WHERE e[k + 1] > 0"""
_NAMES = "SELECT p_partkey, regexp_replace(coalesce(p_name, ''), '[^\\x00-\\x7F]', '?', 'g') AS name FROM part"

ORACLES = {
    "page_versions": """
SELECT o_orderkey, (o_orderkey % 251 + CASE WHEN o_orderkey % 6 >= 1 AND o_custkey % 3 = 1 THEN 256 ELSE 0 END)::INTEGER AS version, 300 AS dpi,
  CASE WHEN o_orderkey % 6 >= 4 THEN 18 ELSE 22 END AS gamma_tenths, 0 AS rotation, 'ok' AS status FROM orders""",
    "affine_maps": f"""
WITH f AS (
  SELECT *, CASE WHEN NOT sized THEN (w + ss - 1) // nullif(ss, 0) WHEN bw * h <= bh * w THEN bw ELSE greatest(1, w * bh // h) END AS pw,
    CASE WHEN NOT sized THEN (h + ss - 1) // nullif(ss, 0) WHEN bw * h <= bh * w THEN greatest(1, h * bw // w) ELSE bh END AS ph FROM ({_TURNED})),
b AS (SELECT *, CASE WHEN turn % 2 = 1 THEN ph ELSE pw END AS base_w, CASE WHEN turn % 2 = 1 THEN pw ELSE ph END AS base_h,
  ss >= 1 AND (NOT sized OR bw > 0) AND (NOT part OR (x + 3 <= pw AND y + 4 <= ph)) AS ok FROM f),
s AS (SELECT *, CASE WHEN sized THEN base_w / 37::DOUBLE ELSE 1 / nullif(ss, 0)::DOUBLE END AS sx, CASE WHEN sized THEN base_h / 29::DOUBLE ELSE 1 / nullif(ss, 0)::DOUBLE END AS sy FROM b WHERE ok),
p AS (SELECT *, CASE WHEN sized THEN 0 ELSE (base_h * ss - 29) * sy END AS pad FROM s),
m AS (SELECT *, CASE turn WHEN 0 THEN [sx, 0, 0, sy, 0, pad] WHEN 1 THEN [0, -sx, sy, 0, pad, base_w] WHEN 2 THEN [-sx, 0, 0, -sy, base_w, base_h - pad] ELSE [0, sx, -sy, 0, base_h - pad, 0] END AS t FROM p),
n AS (SELECT *, t[1] * t[4] - t[2] * t[3] AS det, t[5] - x AS e, t[6] - y AS f FROM m),
o AS (SELECT c_custkey, t[1] AS x0, t[2] AS x1, t[3] AS x2, t[4] AS x3, e AS x4, f AS x5, t[4] / det AS i0, -t[2] / det AS i1, -t[3] / det AS i2, t[1] / det AS i3,
  (t[3] * f - t[4] * e) / det AS i4, (t[2] * e - t[1] * f) / det AS i5 FROM n)
SELECT b.c_custkey, CASE WHEN coalesce(b.ok, false) THEN 'ok' ELSE 'InvalidArgument' END AS status, {', '.join(f'round({c}{k} * 1e6::DOUBLE)::BIGINT AS {a}{k}' for c, a in (('x', 'm'), ('i', 'i')) for k in range(6))}
FROM b LEFT JOIN o USING (c_custkey)""",
    "layer_factors": """
WITH p AS (SELECT p_partkey, p_partkey * 7 % 500 + 1 AS w, p_partkey * 3 % 400 + 1 AS h, p_size % 12 + 1 AS r FROM part),
l AS (SELECT *, (w + r - 1) // r AS lw, (h + r - 1) // r + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS lh FROM p)
SELECT p_partkey, (SELECT min(k) FROM range(1, 13) f(k) WHERE (w + k - 1) // k = lw AND (h + k - 1) // k = lh) AS factor FROM l""",
    "tile_reductions": """
WITH p AS (SELECT p_partkey, p_partkey * 37 % 30000 + 1 AS w, p_partkey * 53 % 30000 + 1 AS h, p_size % 16 + 1 AS z FROM part),
c AS (SELECT p_partkey, s, least(ceil(((w + s - 1) // s) / 512.0::DOUBLE), ceil(1000 * z / (s * 512.0::DOUBLE)) + 1) * least(ceil(((h + s - 1) // s) / 512.0::DOUBLE), ceil(800 * z / (s * 512.0::DOUBLE)) + 1) AS n
  FROM p, range(1, 257) r(s) WHERE s >= z)
SELECT p_partkey, coalesce(min(CASE WHEN n <= 24 THEN s END), 256)::BIGINT AS subsample FROM c GROUP BY p_partkey""",
    "stored_views": f"""
SELECT s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN 4779 ELSE s_suppkey % 4096 END)::INTEGER AS background,
  CASE WHEN s_suppkey % 8 IN (2, 4) THEN 'width' ELSE {list(ZOOMS)}[s_suppkey % 8 + 1] END AS zoom,
  CASE WHEN s_suppkey % 5 < 4 THEN ['color', 'bw', 'fore', 'back'][s_suppkey % 5 + 1] END AS mode, CASE WHEN s_suppkey % 3 < 2 THEN ['left', 'center', 'right'][s_nationkey % 3 + 1] END AS horizontal,
  coalesce(s_name, '') AS left, 'c' AS center, s_nationkey::VARCHAR AS foot, 2 AS n_chunks, 'ok' AS status FROM supplier""",
    "annotation_escapes": r"""
SELECT p_partkey, p_partkey % 3 = 0 AS legacy_escapes, coalesce(p_name, '') || CASE WHEN p_partkey % 3 = 0 THEN '\t"\101\\z' ELSE chr(9) || '"A\z' END AS a, CASE WHEN p_partkey % 3 = 0 THEN '\q' ELSE '1q' END AS b FROM part""",
    "metadata_attribution": """
WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS page FROM nation),
r AS (SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation))
SELECT r_regionkey::BIGINT AS r_regionkey, 'region' AS key, r_name AS value, NULL::BIGINT AS page FROM r UNION ALL SELECT r_regionkey, 'xmp', '<' || r_name || '>', NULL FROM r
UNION ALL SELECT r_regionkey, 'stray', 'kept', NULL FROM r UNION ALL SELECT n_regionkey, 'nation', n_name, page FROM n UNION ALL SELECT n_regionkey, 'twice', 'x', page FROM n, range(2)""",
    "damaged_spans": r"""
WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '?', 'g') AS t FROM documents),
d AS (SELECT doc_id, regexp_replace(t, '(?s).(.{0,6})', '�\1', 'g') AS t FROM p)
SELECT doc_id, length(t) > 0 AS has_replacements, t AS text, substr(t, (doc_id % 11 + 1)::INTEGER, 20) AS span, length(t) AS n_bytes FROM d""",
    "zone_descendants": f"""
SELECT p_partkey, length(name) AS n, length(name) AS steps, 2 * length(name) - 1 AS last_word FROM ({_NAMES}) WHERE length(name) > 0""",
    "zone_hits": f"""
WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, length(name) - 1 AS n FROM ({_NAMES})),
w AS (SELECT *, 1 + 2 * k AS a, CASE WHEN k + 1 < least(n, 9) THEN 3 + 2 * k ELSE 1 + 2 * k END AS next FROM p WHERE k < least(n, 9)),
v AS (SELECT *, CASE WHEN next > a THEN next ELSE a END AS b FROM w)
SELECT p_partkey, a, b, (a - 1) // 2 AS start, (b - 1) // 2 + 1 AS until FROM v""",
    "outline_answers": """
SELECT n_regionkey::BIGINT AS r_regionkey, '{"entries":[{"title":"all","href":"#1","parent":null,"subtreeEnd":' || count(*) + 1 || '},' ||
  string_agg('{"title":"' || n_name || '","href":"#' || n_nationkey || '","parent":0,"subtreeEnd":' || k + 1 || '}', ',' ORDER BY k) || ']}' AS json
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation) GROUP BY n_regionkey""",
    "text_answers": """
SELECT s_suppkey, '{"text":"' || coalesce(s_name, '') || CASE WHEN s_suppkey % 3 = 0 THEN '�","bytes":[' || list_aggregate(list_transform(string_split(coalesce(s_name, ''), ''), lambda c: ascii(c)), 'string_agg', ',') ||
  ',255],"hasReplacements":true' ELSE '","bytes":null,"hasReplacements":false' END || ',"zones":[]}' AS json FROM supplier""",
    "include_gaps": """
WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders)
SELECT o_custkey, page, CASE WHEN o_orderkey % 5 = 0 THEN 'o' || o_orderkey ELSE 's1' END AS id FROM p WHERE o_orderkey % 5 = 0 OR o_orderkey % 2 = 1""",
    "component_table": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) - 1 AS k, strlen(coalesce(text, '')) AS n FROM conversations)
SELECT conv_id, 0::BIGINT AS comp, 'n' AS id, 'n' AS name, 'n' AS title, 'shared' AS kind, 24::BIGINT AS size, true AS whole, 1::BIGINT AS n_chunks, 'ok' AS status FROM (SELECT DISTINCT conv_id FROM t)
UNION ALL SELECT conv_id, k + 1, 'p' || k, 'page-' || k, 'title ' || k, 'page', 38 + n + n % 2, true, 2, 'ok' FROM t""",
    "href_checks": """
SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'page' ELSE 'LimitExceeded' END AS kind, CASE c_custkey % 3 WHEN 1 THEN 0 END::BIGINT AS page FROM customer""",
    "shared_symbols": f"SELECT l_orderkey, count(DISTINCT (x, y)) AS ink FROM ({_SQUARES}) GROUP BY l_orderkey",
    "refined_symbols": "SELECT vec_id, len(list_filter(coalesce(embedding, []), lambda x: x > 0))::BIGINT AS ink FROM embeddings",
    "palette_render": f"SELECT l_orderkey, color, count(*) AS n FROM (SELECT l_orderkey, x, y, max(l_linenumber) % 4 AS color FROM ({_SQUARES}) GROUP BY ALL) GROUP BY ALL",
    "tiles_of_masks": f"""
SELECT e.vec_id, half, count(i.x) AS ink FROM embeddings e CROSS JOIN (VALUES ('left', 0), ('right', 4)) s(half, x0) LEFT JOIN ({_INKED}) i ON i.vec_id = e.vec_id AND i.x BETWEEN x0 AND x0 + 3 GROUP BY e.vec_id, half""",
    "rotated_masks": f"""
SELECT e.vec_id, CASE WHEN e.vec_id % 2 = 1 THEN e.h ELSE 8 END AS width, CASE WHEN e.vec_id % 2 = 1 THEN 8 ELSE e.h END AS height,
  coalesce(sum(CASE e.vec_id % 4 WHEN 0 THEN i.x WHEN 1 THEN i.y WHEN 2 THEN 7 - i.x ELSE e.h - 1 - i.y END), 0)::BIGINT AS xs,
  coalesce(sum(CASE e.vec_id % 4 WHEN 0 THEN i.y WHEN 1 THEN 7 - i.x WHEN 2 THEN e.h - 1 - i.y ELSE i.x END), 0)::BIGINT AS ys
FROM (SELECT vec_id, greatest(2, (len(coalesce(embedding, [])) + 15) // 16 * 2) AS h FROM embeddings) e LEFT JOIN ({_INKED}) i ON i.vec_id = e.vec_id GROUP BY e.vec_id, e.h""",
    "averaged_masks": f"""
WITH c AS (SELECT vec_id, unnest(range(greatest(2, (len(coalesce(embedding, [])) + 15) // 16 * 2) // 2 * 4)) AS cell FROM embeddings),
n AS (SELECT vec_id, y // 2 * 4 + x // 2 AS cell, count(*) AS n FROM ({_INKED}) GROUP BY ALL)
SELECT c.vec_id, c.cell, ((4 - coalesce(n, 0)) * 255 + 2) // 4 AS value FROM c LEFT JOIN n USING (vec_id, cell)""",
    "wavelet_waves": "SELECT p_partkey, (p_size % 23 + 20)::INTEGER AS width, (p_size % 29 + 20)::INTEGER AS height, true AS near, true AS mean_near FROM part",
    "stored_thumbnails": """
SELECT n_regionkey::BIGINT AS r_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS page, (n_nationkey % 4 + 6)::INTEGER AS width, (n_nationkey % 5 + 3)::INTEGER AS height,
  (9 * n_nationkey + 8)::INTEGER AS gray, 'ok' AS status FROM nation""",
}
