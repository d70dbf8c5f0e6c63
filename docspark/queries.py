"""The registered queries of the engine, and their DuckDB SQL.

Round-trip queries pack table rows as documents of the format and read them back: the engine sees the packed bytes alone. The others ask
native operators about the tables.
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
from docspark.operators import links, raster, zones
from docspark.plans.document_set import DocumentSet

FILES = "doc_id string, content binary"


def _whole(files: DataFrame) -> DocumentSet:
    """Packed documents that lean on no other files."""
    return DocumentSet(files, linked=False)


def _pack(rows: DataFrame, call, batch: int = 1024) -> DataFrame:
    """Files packed from rows, spread over the cores by their first column, as packing is work and small tables come in one part."""
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = "__key"
    keyed = rows.toDF(key, *[f"c{k}" for k in range(1, len(rows.columns))])
    return flat_map(keyed.repartition(n, key), FILES, call, batch)


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """df dealt anew if it is read in fewer parts than there are cores, as tables of few bytes a row are; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _key(name: str, type_: str = "bigint"):
    return F.col("doc_id").cast(type_).alias(name)


def _page(*chunks: bytes, **info) -> bytes:
    return pack.document(pack.form("DJVU", pack.info(**({"width": 100, "height": 100} | info)), *chunks))


# Text


def text_roundtrip(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    files = _pack(rows, lambda d, text: [(d, _page(pack.text(text.encode())))], 256)
    return _whole(files).text().select(_key("doc_id"), "text", "status")


def zone_words(spark, sf_dir):
    def call(d, text):
        lines, at = [], 0
        for line in text.split("\n"):
            words, x = [], at
            for w in line.split(" "):
                n = len(w.encode())
                if n:
                    words.append(ZoneTree("word", len(words), len(lines), 1, 1, x, n))
                x += n + 1
            if words:
                first, last = words[0], words[-1]
                lines.append(ZoneTree("line", 0, len(lines), len(words), 1, first.start, last.start + last.length - first.start, words))
            at += len(line.encode()) + 1
        data = text.encode()
        tree = ZoneTree("page", 0, 0, 100, 100, 0, len(data), lines)
        yield d, _page(pack.text(data, tree, 100))

    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    z = _whole(_pack(rows, call, 64)).zones()
    words = z.where("kind = 'word'").select("doc_id", "page", F.col("parent").alias("line"), "text_length")
    counted = words.groupBy("doc_id", "page", "line").agg(F.count("*").alias("n_words"), F.sum("text_length").alias("n_bytes"))
    lines = z.where("kind = 'line'").select("doc_id", "page", F.col("idx").alias("line"), F.col("y").cast("bigint").alias("line_no"), (F.col("subtree_end") - F.col("idx") - 1).cast("bigint").alias("n_below"))
    return lines.join(counted, ["doc_id", "page", "line"]).select(_key("doc_id"), "line_no", "n_words", "n_bytes", "n_below")


def utf8_repair(spark, sf_dir):
    """Texts with every 7th byte overwritten by 0xFF: repaired text and span lengths."""

    def call(d, text):
        raw = bytearray(text.encode())
        raw[::7] = b"\xff" * len(raw[::7])
        yield d, _page(pack.text(bytes(raw)))

    rows = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    t = _whole(_pack(rows, call, 256)).text()
    bad = F.length(F.col("text")) - F.length(F.translate("text", "�", ""))
    return t.select(_key("doc_id"), "has_replacements", bad.cast("bigint").alias("n_replaced"), F.length("bytes").cast("bigint").alias("n_bytes"))


# Pages and geometry


def page_info(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 5000 + 1), (F.col("o_custkey") % 4000 + 1), F.col("o_orderkey") % 7000, F.col("o_custkey") % 80, F.col("o_orderkey") % 8
    )

    def call(d, w, h, dpi, gamma, flags):
        info = w.to_bytes(2, "big") + h.to_bytes(2, "big") + bytes([26, 0]) + dpi.to_bytes(2, "little") + bytes([gamma, flags])
        yield d, pack.document(pack.form("DJVU", pack.chunk("INFO", info)))

    return _whole(_pack(rows, call)).pages().select(_key("o_orderkey"), "width", "height", "dpi", "rotation", "gamma_tenths", "status")


def pages_rollup(spark, sf_dir):
    p = page_info(spark, sf_dir)
    return p.rollup("rotation", "gamma_tenths").agg(F.count("*").alias("n_pages"), F.max("width").alias("max_width"))


def _requests(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000 + 1).cast("int").alias("w"), (F.col("l_suppkey") % 2000 + 1).cast("int").alias("h"), (F.col("l_orderkey") % 4).cast("int").alias("stored"),
        (F.col("l_orderkey") % 800 + 1).cast("int").alias("bw"), (F.col("l_linenumber") * 100 + 1).cast("int").alias("bh"), (F.col("l_linenumber") * 3).cast("int").alias("ss"), (F.col("l_linenumber") % 4).cast("int").alias("turn"),
    )


def geometry_fit(spark, sf_dir):
    r = _requests(spark, sf_dir)
    g = native.geometry(F.col("w"), F.col("h"), F.col("stored"), F.lit(1), F.col("bw"), F.col("bh"), F.col("turn"))
    return r.withColumn("g", g).select("l_orderkey", "l_linenumber", "g.page_width", "g.page_height", "g.rotation")


def geometry_subsample(spark, sf_dir):
    r = _requests(spark, sf_dir)
    none = F.lit(None).cast("int")
    g = native.geometry(F.col("w"), F.col("h"), F.col("stored"), F.col("ss"), none, none, F.col("turn"))
    return r.withColumn("g", g).select("l_orderkey", "l_linenumber", "g.page_width", "g.page_height", "g.base_width", "g.base_height", "g.padding_top")


def map_rects(spark, sf_dir):
    r = _requests(spark, sf_dir)
    m = F.array(F.lit(0.0), F.lit(-1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("w").cast("double"))
    b = native.map_rect(m, F.col("turn").cast("double"), F.col("stored").cast("double"), F.col("ss").cast("double"), F.col("bh").cast("double"))
    return r.withColumn("b", b).select("l_orderkey", "l_linenumber", "b.*")


def area_weights(spark, sf_dir):
    p = _spread(_t(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.col("p_size").alias("source"), (F.col("p_partkey") % 40 + 1).cast("int").alias("output"))
    p = p.withColumn("pixel", (F.col("p_partkey") % F.col("output")).cast("int")).withColumn("w", native.axis_weights(F.col("pixel"), F.col("source"), F.col("output")))
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    moment = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["weight"] * x["at"])
    return p.select("p_partkey", F.size("w").cast("bigint").alias("n"), total.alias("total"), moment.alias("moment"))


def gamma_lut(spark, sf_dir):
    g = _t(spark, sf_dir, "part").select(F.greatest(F.lit(3), "p_size").cast("int").alias("tenths")).distinct()
    rows = g.select("tenths", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("sample"))
    return rows.withColumn("value", native.gamma(F.col("sample"), F.col("tenths")))


def visible_tiles(spark, sf_dir):
    r = _requests(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("w").alias("page_width"), F.col("h").alias("page_height"), (F.col("bw") % 50 - 9).alias("vx"), (F.col("bh") % 5).alias("vy"), (F.col("ss") * 60).alias("vw"), F.lit(900).alias("vh"))
    return zones.visible_tiles(r).select("l_orderkey", "l_linenumber", F.col("tx").cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"))


# Containers


def chunk_inventory(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def call(d, turns):
        yield d, pack.bundle([Component(f"p{k}", "page", pack.form("DJVU", pack.info(100, 100), pack.text(t["text"].encode()))) for k, t in enumerate(turns)])

    t = _whole(_pack(turns, call, 256)).text().where("status = 'ok'")
    return t.groupBy(_key("conv_id")).agg(F.count("*").alias("n_pages"), F.max("page").cast("bigint").alias("last_page"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), F.max(F.length("text")).cast("bigint").alias("longest"))


def include_closure(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doc_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))

    def call(d, turns):
        shared = [Component(f"role-{r}", "shared", pack.form("DJVI", pack.chunk("ROLE", r.encode()))) for r in sorted({t["role"] for t in turns})]
        pages = [Component(f"p{k}", "page", pack.form("DJVU", pack.info(9, 9), pack.include(f"role-{t['role']}"), pack.chunk("SAID", t["text"].encode()))) for k, t in enumerate(turns)]
        yield d, pack.bundle(shared + pages)

    c = _whole(_pack(turns, call, 256)).page_chunks().where("chunk_id IN ('ROLE', 'SAID')")
    said = c.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.col("payload").cast("string").alias("s")))), lambda x: x["s"]), "|").alias("said"))
    return said.select(_key("conv_id"), F.col("page").cast("bigint").alias("page"), "said")


def missing_components(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), "o_orderkey", "o_orderstatus")
    lists = orders.groupBy("doc_id").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    page = pack.form("DJVU", pack.info(5, 5))

    def call(d, keys):
        yield d, pack.indirect([Component(f"o{k}", "page", page) for k in keys])[0]

    supplied = orders.where("o_orderstatus <> 'O'").select("doc_id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.lit(pack.document(page)).alias("content"))
    m = DocumentSet(_pack(lists, call, 256), supplied).missing("page")
    return m.select(_key("o_custkey"), F.col("page").cast("bigint").alias("page"), "id")


#: Entries and bytes of titles that one outline of a query holds at most, and children of an entry, whose number is one byte in the format.
OUTLINE_ENTRIES, OUTLINE_BYTES, MOST_CHILDREN = 4096, 1 << 20, 255


def _outlines(nations, most: int = OUTLINE_ENTRIES) -> list[list[tuple[str, str, int]]]:
    """Entries of as many outlines as the names of nations need: a nation stands there again for each further MOST_CHILDREN names."""
    out, size = [[]], 0
    for n in nations:
        for a in range(0, max(1, len(n["names"])), MOST_CHILDREN):
            names = n["names"][a : a + MOST_CHILDREN]
            more = sum(len(x.encode()) for x in (n["n_name"], *names))
            if out[-1] and (len(out[-1]) + 1 + len(names) > most or size + more > OUTLINE_BYTES):
                out.append([])
                size = 0
            size += more
            out[-1].append((n["n_name"], f"#{n['n_nationkey']}", len(names)))
            out[-1] += [(x, "", 0) for x in names]
    return out


def outline_tree(spark, sf_dir):
    """A region's nations with their suppliers below, in as many documents as they need; what one nation has in several is added up."""
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    most = n.groupBy("n_regionkey").count().agg(F.max("count")).first()[0] or 1
    part = F.coalesce(F.pmod(F.xxhash64("s_suppkey"), F.lit(-(-most // (OUTLINE_ENTRIES // 2)))), F.lit(0)).alias("part")
    below = n.groupBy("n_regionkey", part, "n_nationkey", "n_name").agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    below = below.withColumn("part", F.when(F.size("names") > 0, F.col("part")).otherwise(0))
    rows = below.groupBy(F.concat_ws("/", F.col("n_regionkey").cast("string"), F.col("part").cast("string")).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name", "names"))).alias("nations"))

    def call(d, nations):
        for k, entries in enumerate(_outlines(nations)):
            yield f"{d}/{k}", pack.bundle([Component("p", "page", pack.form("DJVU", pack.info(5, 5)))], pack.outline(entries))

    o = _whole(_pack(rows, call, 16)).outline().withColumn("n_below", (F.col("subtree_end") - F.col("idx") - 1).cast("bigint"))
    region = F.substring_index("doc_id", "/", 1).cast("bigint").alias("r_regionkey")
    top = o.where("parent IS NULL").groupBy(region, "href", "title").agg(F.sum("n_below").alias("n_below")).select("r_regionkey", "title", F.lit(None).cast("string").alias("parent_title"), "n_below")
    up = o.where("n_below > 0").select("doc_id", F.col("idx").alias("parent"), F.col("title").alias("parent_title"))
    return top.unionByName(o.where("parent IS NOT NULL").join(up, ["doc_id", "parent"]).select(region, "title", "parent_title", "n_below"))


# Annotations and metadata


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def metadata_scan(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.coalesce("p_name", F.lit("")), F.coalesce("p_brand", F.lit("")), F.coalesce("p_type", F.lit("")))

    def call(d, name, brand, type_):
        yield d, _page(pack.annotations(f"(metadata (name {_quoted(name)}) (brand {_quoted(brand)})) (metadata (type {_quoted(type_)}))".encode()))

    m = _whole(_pack(rows, call)).metadata()
    return m.select(_key("p_partkey"), F.col("seq").cast("bigint").alias("seq"), "key", "value", F.col("page").cast("bigint").alias("page"))


def metadata_last_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc_id"), "ts", "event_id", "event_type")
    lists = e.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("events")).select("doc_id", F.transform("events", lambda x: F.struct(x["event_type"].alias("k"), x["event_id"].cast("string").alias("v"))).alias("kv"))

    def call(d, kv):
        yield d, _page(pack.annotations("".join(f"(metadata ({x['k']} {_quoted(x['v'])}))" for x in kv).encode(), compressed=True))

    m = _whole(_pack(lists, call)).annotations().where("status = 'ok'").select("doc_id", F.posexplode("metadata").alias("seq", "m"))
    return m.groupBy(_key("user_id"), F.col("m.key").alias("key")).agg(native.last_valid(F.col("m.value"), F.col("seq")).alias("value"))


def area_bounds(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.col("s_nationkey"))

    def call(key, nation):
        shape = f'(maparea "#{nation}" "" (rect {key % 20} {nation} {key % 30 + 1} {nation + 2}) (hilite #00FF00))'
        yield str(key), _page(pack.annotations(shape.encode()), width=101, height=79, rotation=key % 4)

    a = _whole(_pack(rows, call)).areas()
    return a.select(_key("s_suppkey"), "href", "bounds.x", "bounds.y", "bounds.width", "bounds.height", F.col("style.highlight").alias("highlight"))


# Links and thumbnails


def link_resolve(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pages = n.select(F.lit("d").alias("doc_id"), F.col("n_nationkey").alias("page"), F.concat(F.lit("id"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("title"))
    c = _t(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    small = (F.col("c_custkey") % 30).cast("string")
    title = F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    hrefs = [F.lit(""), F.concat(F.lit("?page="), key), F.concat(F.lit("/c/"), key), F.lit("#"), F.concat(F.lit("#"), small), F.concat(F.lit("#+"), small), F.concat(F.lit("#-"), small), F.concat(F.lit("#"), title), F.concat(F.lit("#id"), small)]
    asked = c.select(F.lit("d").alias("doc_id"), "c_custkey", F.element_at(F.array(*hrefs), (F.floor(F.col("c_custkey") / 5) % 9 + 1).cast("int")).alias("href"), F.col("c_nationkey").alias("from_page"))
    return links.resolve_links(asked, pages).select("c_custkey", "href", F.col("link.kind").alias("kind"), F.col("link.page").cast("bigint").alias("page"))


def asof_thumbnail(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("comp"), F.when(F.col("event_type") == "purchase", "thumbnail").when(F.col("event_type") == "click", "page").otherwise("shared").alias("kind"))
    t = links.thumbnail_order(e)
    return t.select(F.col("doc_id").alias("user_id"), F.col("comp").alias("event_id"), "thumb", "ordinal")


# Rasters


def _bits(spark, sf_dir):
    """Vectors of any length as rows of eight bits, an even number of rows, two at least."""
    bits = F.transform(F.coalesce("embedding", F.array().cast("array<float>")), lambda x: F.when(x > 0, 1).otherwise(0))
    rows = F.greatest(F.lit(2), F.floor((F.size(bits) + 15) / 16).cast("int") * 2)
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string"), F.concat(bits, F.array_repeat(F.lit(0), rows * 8 - F.size(bits))))


def _ink(rasters: DataFrame, key: str):
    def call(doc_id, rgba):
        yield doc_id, None if rgba is None else int((np.frombuffer(rgba, np.uint8)[::4] == 0).sum())

    return flat_map(rasters.select("doc_id", "rgba"), "doc_id string, ink long", call).select(_key(key), "ink")


def mask_ink_mmr(spark, sf_dir):
    def call(d, bits):
        p = np.array(bits, np.uint8).reshape(-1, 8)
        yield d, _page(pack.chunk("Smmr", encode_mmr(p)), width=8, height=len(p))

    return _ink(_whole(_pack(_bits(spark, sf_dir), call)).render(), "vec_id")


def mask_ink_jb2(spark, sf_dir):
    def call(d, bits):
        p = np.array(bits, np.uint8).reshape(-1, 8)
        h = len(p) // 2
        yield d, _page(pack.chunk("Sjbz", encode_jb2(8, 2 * h, [(p[:h][::-1], 0, h), (p[h:][::-1], 0, 0)])), width=8, height=2 * h)

    return _ink(_whole(_pack(_bits(spark, sf_dir), call)).render(), "vec_id")


def bilevel_subsample(spark, sf_dir):
    def call(d, bits):
        p = np.array(bits, np.uint8).reshape(-1, 8)
        yield d, _page(pack.chunk("Smmr", encode_mmr(p)), width=8, height=len(p))

    files = _pack(_bits(spark, sf_dir), call)
    r = _whole(files).render(files.select("doc_id", F.lit(0).alias("page"), F.lit(3).alias("subsample")))

    def values(doc_id, rgba):
        gray = np.frombuffer(rgba, np.uint8)[::4]
        yield from ((doc_id, k, int(v)) for k, v in enumerate(gray))

    return flat_map(r.where("status = 'ok'").select("doc_id", "rgba"), "doc_id string, cell long, value long", values).select(_key("vec_id"), "cell", "value")


def box_subsample(spark, sf_dir):
    """The same reduction as a relation over pixels; cells without ink are white."""
    e = _bits(spark, sf_dir).toDF("id", "bits").select(F.col("id").cast("bigint").alias("vec_id"), "bits", F.floor(F.size("bits") / 8).alias("h"))
    s = e.select("vec_id", "h", F.posexplode("bits").alias("k", "value")).select("vec_id", "h", (F.col("k") % 8).alias("x"), F.floor(F.col("k") / 8).alias("y"), "value")
    out = None
    for h in sorted(r.h for r in e.select("h").distinct().collect()):  # a page size each, few of them
        part = raster.box_reduced(s.where(F.col("h") == h), ["vec_id"], 8, h, 3, True)
        out = part if out is None else out.unionByName(part)
    out = out if out is not None else raster.box_reduced(s, ["vec_id"], 8, 8, 3, True)
    return out.select("vec_id", (F.col("y") * 3 + F.col("x")).cast("bigint").alias("cell"), "value")


def union_mask(spark, sf_dir):
    blits = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.lit(0).alias("symbol"), (F.col("l_partkey") % 10 - 2).alias("left"), (F.col("l_suppkey") % 10 - 2).alias("bottom"))
    return raster.union_ink(_blits(spark, blits), ["l_orderkey"])


def _blits(spark, blits):
    square = spark.range(9).select(F.lit(0).alias("symbol"), (F.col("id") % 3).alias("px"), F.floor(F.col("id") / 3).alias("py"))
    return raster.blit_pixels(blits, F.broadcast(square), 9, 9, ["l_orderkey"])


def palette_last_wins(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    blits = li.select("l_orderkey", F.col("l_linenumber").alias("ord"), F.lit(0).alias("symbol"), (F.col("l_partkey") % 10 - 2).alias("left"), (F.col("l_suppkey") % 10 - 2).alias("bottom"))
    pixels = _blits(spark, blits).withColumn("color", F.col("ord") % 4)
    return raster.last_color(pixels, ["l_orderkey"], "color").groupBy("l_orderkey", F.col("color").cast("bigint").alias("color")).agg(F.count("*").alias("n"))


@lru_cache(4096)
def _constant(size: int) -> bytes:
    """A document of a constant picture; pictures repeat, and each is encoded once a worker."""
    gray = np.full((size % 9 + 1, size % 7 + 1), size * 5 % 256, np.uint8)
    return pack.document(pack.form("PM44", *(pack.chunk("PM44", c) for c in encode_iw44(gray, (100,)))))


def wavelet_constant(spark, sf_dir):
    """Constant gray pictures through the wavelet codec, entropy coding and colour included."""
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), F.col("p_size"))

    def call(d, size):
        yield d, _constant(size)

    r = _whole(_pack(rows, call, 256)).render()

    def gray(doc_id, width, height, rgba):
        v = np.frombuffer(rgba, np.uint8).reshape(-1, 4)
        yield doc_id, width, height, int(v[:, 0].min()), int(v[:, 2].max())

    return flat_map(r.where("status = 'ok'").select("doc_id", "width", "height", "rgba"), "doc_id string, width int, height int, low int, high int", gray).select(_key("p_partkey"), "width", "height", "low", "high")


QUERIES = {
    f.__name__: f
    for f in (
        text_roundtrip, zone_words, utf8_repair, page_info, pages_rollup, geometry_fit, geometry_subsample, map_rects, area_weights, gamma_lut, visible_tiles, chunk_inventory,
        include_closure, missing_components, outline_tree, metadata_scan, metadata_last_wins, area_bounds, link_resolve, asof_thumbnail, mask_ink_mmr, mask_ink_jb2, bilevel_subsample,
        box_subsample, union_mask, palette_last_wins, wavelet_constant,
    )
}

_INFO = """
SELECT o_orderkey, (o_orderkey % 5000 + 1)::INTEGER AS width, (o_custkey % 4000 + 1)::INTEGER AS height,
  CASE WHEN o_orderkey % 7000 BETWEEN 25 AND 6000 THEN (o_orderkey % 7000)::INTEGER ELSE 300 END AS dpi,
  CASE o_orderkey % 8 WHEN 6 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 ELSE 0 END AS rotation,
  greatest(3, least(50, o_custkey % 80))::INTEGER AS gamma_tenths, 'ok' AS status FROM orders"""
_REQUESTS = """
SELECT l_orderkey, l_linenumber, l_partkey % 3000 + 1 AS w, l_suppkey % 2000 + 1 AS h, l_orderkey % 800 + 1 AS bw, l_linenumber * 100 + 1 AS bh, l_linenumber * 3 AS ss,
  (l_orderkey % 4 + l_linenumber % 4) % 4 AS rot, l_linenumber % 4 AS turn, l_orderkey % 4 AS stored FROM lineitem"""
_TURNED = f"SELECT *, CASE WHEN rot % 2 = 1 THEN h ELSE w END AS rw, CASE WHEN rot % 2 = 1 THEN w ELSE h END AS rh FROM ({_REQUESTS})"
_CELLS = """
WITH v AS (SELECT vec_id, coalesce(embedding, []) AS e, greatest(2, (len(coalesce(embedding, [])) + 15) // 16 * 2) AS h FROM embeddings),
b AS (SELECT vec_id, e, unnest(range(8 * h)) AS k, (h + 2) // 3 * 3 - h AS pad FROM v),
p AS (SELECT vec_id, (k // 8 + pad) // 3 * 3 + k % 8 // 3 AS cell, CASE WHEN e[k + 1] > 0 THEN 1 ELSE 0 END AS ink FROM b),
c AS (SELECT vec_id, cell, sum(ink)::BIGINT AS n FROM p GROUP BY ALL)
SELECT vec_id, cell, CASE WHEN n = 0 THEN 255 WHEN n = 9 THEN 0 ELSE 255 - (n * 255 + 4) // 9 END::BIGINT AS value FROM c"""
_PIXELS = """
SELECT l_orderkey, l_linenumber, l_partkey % 10 - 2 + k % 3 AS x, 8 - (l_suppkey % 10 - 2) - k // 3 AS y FROM lineitem, range(9) r(k)
WHERE x BETWEEN 0 AND 8 AND y BETWEEN 0 AND 8"""

ORACLES = {
    "text_roundtrip": "SELECT doc_id, coalesce(text, '') AS text, 'ok' AS status FROM documents",
    "zone_words": """
WITH l AS (SELECT doc_id, unnest(list_zip(range(len(ls)), ls)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, z[1] AS pos, list_filter(string_split(z[2], ' '), lambda x: x <> '') AS ws FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: strlen(x)))::BIGINT AS n_bytes, len(ws)::BIGINT AS n_below
FROM w WHERE len(ws) > 0""",
    "page_info": _INFO,
    "pages_rollup": f"SELECT rotation, gamma_tenths, count(*) AS n_pages, max(width) AS max_width FROM ({_INFO}) GROUP BY ROLLUP (rotation, gamma_tenths)",
    "geometry_fit": f"""
SELECT l_orderkey, l_linenumber, (CASE WHEN bw * rh <= bh * rw THEN bw ELSE greatest(1, rw * bh // rh) END)::BIGINT AS page_width,
  (CASE WHEN bw * rh <= bh * rw THEN greatest(1, rh * bw // rw) ELSE bh END)::BIGINT AS page_height, rot::INTEGER AS rotation FROM ({_TURNED})""",
    "geometry_subsample": f"""
SELECT l_orderkey, l_linenumber, pw AS page_width, ph AS page_height, CASE WHEN rot % 2 = 1 THEN ph ELSE pw END AS base_width, CASE WHEN rot % 2 = 1 THEN pw ELSE ph END AS base_height,
  CASE WHEN rot % 2 = 1 THEN pw ELSE ph END * ss - h AS padding_top FROM (SELECT *, ((rw + ss - 1) // ss)::BIGINT AS pw, ((rh + ss - 1) // ss)::BIGINT AS ph FROM ({_TURNED}))""",
    "map_rects": f"SELECT l_orderkey, l_linenumber, stored::DOUBLE AS x, (w - turn - ss)::DOUBLE AS y, bh::DOUBLE AS width, ss::DOUBLE AS height FROM ({_REQUESTS})",
    "area_weights": """
WITH p AS (SELECT p_partkey, p_size::BIGINT AS s, p_partkey % 40 + 1 AS o, p_partkey % (p_partkey % 40 + 1) AS i FROM part),
shrunk AS (SELECT *, unnest(range(i * s // o, ((i + 1) * s + o - 1) // o)) AS k FROM p WHERE o <= s),
grown AS (SELECT *, (2 * i + 1) * s - o AS c FROM p WHERE o > s),
fractions AS (SELECT *, ((c % (2 * o)) + 2 * o) % (2 * o) AS f FROM grown),
g AS (SELECT *, (c - f) // (2 * o) AS low, f * 65536 // (2 * o) AS last FROM fractions),
w AS (
  SELECT p_partkey, k AS spot, least((i + 1) * s, (k + 1) * o) - greatest(i * s, k * o) AS weight FROM shrunk
  UNION ALL SELECT p_partkey, greatest(0, least(s - 1, low)), 65536 - last FROM g UNION ALL SELECT p_partkey, greatest(0, least(s - 1, low + 1)), last FROM g)
SELECT p_partkey, count(*) AS n, sum(weight)::BIGINT AS total, sum(weight * spot)::BIGINT AS moment FROM w GROUP BY p_partkey""",
    "gamma_lut": """
SELECT tenths, k::INTEGER AS sample, CASE WHEN tenths = 22 THEN k ELSE floor(255.0::DOUBLE * pow(k / 255.0::DOUBLE, tenths / 22.0::DOUBLE) + 0.5)::BIGINT END AS value
FROM (SELECT DISTINCT greatest(3, p_size)::INTEGER AS tenths FROM part), range(256) r(k)""",
    "visible_tiles": f"""
WITH v AS (SELECT l_orderkey, l_linenumber, greatest(0, bw % 50 - 9) AS l, least(w, bw % 50 - 9 + ss * 60) AS r, bh % 5 AS t, least(h, bh % 5 + 900) AS b FROM ({_REQUESTS}))
SELECT l_orderkey, l_linenumber, tx, ty FROM (SELECT *, unnest(range(t // 512, (b + 511) // 512)) AS ty FROM (
  SELECT *, unnest(range(l // 512, (r + 511) // 512)) AS tx FROM v WHERE r > l AND b > t))""",
    "chunk_inventory": """
SELECT conv_id, count(*) AS n_pages, count(*) - 1 AS last_page, sum(length(coalesce(text, '')))::BIGINT AS n_chars, max(length(coalesce(text, ''))) AS longest FROM conversations GROUP BY conv_id""",
    "include_closure": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS page, coalesce(role, '') || '|' || coalesce(text, '') AS said FROM conversations",
    "missing_components": """
SELECT o_custkey, page, id FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, 'o' || o_orderkey AS id FROM orders) WHERE o_orderstatus = 'O'""",
    "outline_tree": """
SELECT n_regionkey::BIGINT AS r_regionkey, n_name AS title, NULL::VARCHAR AS parent_title, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_below FROM nation
UNION ALL SELECT n_regionkey, s_name, n_name, 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "metadata_scan": """
SELECT p_partkey, 0::BIGINT AS seq, 'name' AS key, coalesce(p_name, '') AS value, 0::BIGINT AS page FROM part UNION ALL SELECT p_partkey, 1, 'brand', coalesce(p_brand, ''), 0 FROM part
UNION ALL SELECT p_partkey, 2, 'type', coalesce(p_type, ''), 0 FROM part""",
    "metadata_last_wins": "SELECT user_id, event_type AS key, arg_max(event_id, (ts, event_id))::VARCHAR AS value FROM events GROUP BY ALL",
    "area_bounds": """
WITH a AS (SELECT s_suppkey, s_nationkey, s_suppkey % 20 AS x, s_nationkey AS y, s_suppkey % 30 + 1 AS w, s_nationkey + 2 AS h, s_suppkey % 4 AS r FROM supplier)
SELECT s_suppkey, '#' || s_nationkey AS href, (CASE r WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 101 - x - w ELSE 101 - y - h END)::DOUBLE AS x,
  (CASE r WHEN 0 THEN 79 - y - h WHEN 1 THEN x WHEN 2 THEN y ELSE 79 - x - w END)::DOUBLE AS y, (CASE WHEN r % 2 = 0 THEN w ELSE h END)::DOUBLE AS width,
  (CASE WHEN r % 2 = 0 THEN h ELSE w END)::DOUBLE AS height, 65280 AS highlight FROM a""",
    "link_resolve": """
WITH p AS (SELECT n_nationkey AS page, 'id' || n_nationkey AS id, n_name AS name, r_name AS title FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT c_custkey, c_nationkey AS origin, c_custkey // 5 % 9 AS form, c_custkey % 30 AS small,
  ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][c_custkey % 5 + 1] AS title FROM customer),
h AS (SELECT *, CASE form WHEN 0 THEN '' WHEN 1 THEN '?page=' || c_custkey WHEN 2 THEN '/c/' || c_custkey WHEN 3 THEN '#' WHEN 4 THEN '#' || small WHEN 5 THEN '#+' || small
  WHEN 6 THEN '#-' || small WHEN 7 THEN '#' || title ELSE '#id' || small END AS href FROM q),
t AS (SELECT c_custkey, arg_min(p.page, (p.page - origin + 25) % 25) AS page FROM h JOIN p ON h.title = p.title GROUP BY c_custkey),
r AS (SELECT h.*, CASE form WHEN 4 THEN CASE WHEN small BETWEEN 1 AND 25 THEN small - 1 END WHEN 5 THEN CASE WHEN origin + small < 25 THEN origin + small END
  WHEN 6 THEN CASE WHEN small <= origin THEN origin - small END WHEN 7 THEN t.page WHEN 8 THEN CASE WHEN small < 25 THEN small END END AS found FROM h LEFT JOIN t USING (c_custkey))
SELECT c_custkey, href, CASE WHEN form = 0 THEN 'none' WHEN form = 1 THEN 'options' WHEN form = 2 THEN 'url' WHEN found IS NOT NULL THEN 'page' ELSE 'unresolved' END AS kind, found::BIGINT AS page FROM r""",
    "asof_thumbnail": """
WITH e AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS thumb FROM events),
o AS (SELECT *, count(CASE WHEN event_type = 'click' THEN 1 END) OVER (PARTITION BY user_id, thumb ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ordinal FROM e)
SELECT user_id, event_id, thumb, ordinal FROM o WHERE event_type = 'click'""",
    "mask_ink_mmr": "SELECT vec_id, len(list_filter(coalesce(embedding, []), lambda x: x > 0))::BIGINT AS ink FROM embeddings",
    "mask_ink_jb2": "SELECT vec_id, len(list_filter(coalesce(embedding, []), lambda x: x > 0))::BIGINT AS ink FROM embeddings",
    "bilevel_subsample": _CELLS,
    "box_subsample": _CELLS,
    "union_mask": f"SELECT l_orderkey, count(DISTINCT (x, y)) AS ink FROM ({_PIXELS}) GROUP BY l_orderkey",
    "palette_last_wins": f"SELECT l_orderkey, color, count(*) AS n FROM (SELECT l_orderkey, x, y, max(l_linenumber) % 4 AS color FROM ({_PIXELS}) GROUP BY ALL) GROUP BY ALL",
    "wavelet_constant": "SELECT p_partkey, (p_size % 7 + 1)::INTEGER AS width, (p_size % 9 + 1)::INTEGER AS height, (p_size * 5 % 256)::INTEGER AS low, (p_size * 5 % 256)::INTEGER AS high FROM part",
}
