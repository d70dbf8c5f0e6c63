"""DocumentSet: every question about a document, asked of a collection and answered as DataFrames.

Tables are built lazily from two scans of the files; statuses carry what is wrong with a document, page or request. All tables are keyed
by doc_id, pages by (doc_id, page), so a large document spreads over many tasks once its directory is parsed.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import native
from docspark.functions.arrow import flat_map, guarded
from docspark.functions.render import Part, render_requests
from docspark.kernels.annot import decode_annotations
from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Limits, exceeded
from docspark.kernels.iff import Info
from docspark.kernels.outline import decode_outline
from docspark.kernels.text import decode_text, is_utf8, selectable
from docspark.operators import includes, links, metadata
from docspark.sources import documents

ZONE = "struct<idx:int,kind:string,parent:int,x:int,y:int,width:int,height:int,text_start:long,text_length:long,subtree_end:int,depth:int>"
POINT = "struct<x:double,y:double>"
RECT = "struct<x:double,y:double,width:double,height:double>"
STYLE = (
    "struct<border:struct<kind:string,color:int,width:int>,always_visible:boolean,highlight:int,opacity:int,arrow:boolean,line_width:int,"
    "line_color:int,background:int,text_color:int,pushpin:boolean>"
)
AREA = f"struct<expression:int,href:string,target:string,comment:string,shape:string,bounds:{RECT},points:array<{POINT}>,style:{STYLE}>"
SIDES = "struct<left:string,center:string,right:string>"
ANNOTATIONS = (
    "doc_id string, page int, source string, bytes binary, has_replacements boolean, legacy_escapes boolean, chunks array<struct<component:int,start:long,length:long>>, "
    "expressions array<struct<start:long,length:long>>, view struct<background:int,zoom:string,mode:string,alignment:struct<horizontal:string,vertical:string>>, "
    f"areas array<{AREA}>, metadata array<struct<key:string,value:string,expression:int>>, xmp string, header {SIDES}, footer {SIDES}, status string"
)
REQUEST = "struct<request_id:string,subsample:int,box_width:int,box_height:int,rotation:int,x:int,y:int,width:int,height:int>"
RASTERS = (
    "doc_id string, page int, request_id string, x int, y int, width int, height int, page_width int, page_height int, "
    "matrix array<double>, inverse array<double>, rgba binary, status string"
)
ROLES = ("INFO", "INCL", "Djbz", "Sjbz", "Smmr", "BG44", "FG44", "BGjp", "FGjp", "FGbz", "PM44", "BM44", "TH44")


def read_documents(spark: SparkSession, path: str, glob: str = "*", limits: Limits = LIMITS, ranges: bool = False) -> DocumentSet:
    """The documents under a path. With ``ranges`` files are opened by the tasks, which read only what a question needs, however large a file is."""
    if ranges:
        limits = replace(limits, input_bytes=max(limits.input_bytes, 1 << 62))
    return DocumentSet(documents.read_files(spark, path, glob, ranges), limits=limits)


class Wanted:
    """Chunk ids that a question needs, as a test of a string and of a column."""

    def __init__(self, *ids: str, starts: tuple[str, ...] = ()):
        self.ids, self.starts = frozenset(ids), starts

    def __call__(self, id_: str) -> bool:
        return id_ in self.ids or bool(self.starts) and id_.startswith(self.starts)

    def column(self, c: Column) -> Column:
        out = c.isin(*self.ids) if self.ids else F.lit(False)
        for s in self.starts:
            out = out | c.startswith(s)
        return out


class DocumentSet:
    """A collection of documents.

    linked says whether some documents lean on other files, if that is known. files: (doc_id, content), or paths in place of contents, which are then
    read by ranges. supplied: (doc_id, name, content) of component files of indirect documents and stand-alone pages; without it
    the siblings of an indirect index by path are taken from ``files`` themselves.
    """

    def __init__(self, files: DataFrame, supplied: DataFrame | None = None, limits: Limits = LIMITS, linked: bool | None = None):
        self.files, self.limits = files.select("doc_id", "content"), limits
        self._supplied, self._linked_known = supplied, linked
        self._kept = False

    @cached_property
    def _any_linked(self) -> bool:
        """Whether some document leans on other files: known from the caller, or looked up once in the heads of the files."""
        if self._linked_known is None:
            self._linked_known = not self._leaning.limit(1).isEmpty()
        return self._linked_known

    @cached_property
    def _by_ranges(self) -> bool:
        return self.files.schema["content"].dataType.simpleString() == "string"

    @cached_property
    def _leaning(self) -> DataFrame:
        """The files that lean on others: by a native test of their heads, or if paths stand for contents by their headers."""
        if self._by_ranges:
            return self.files.join(documents.leaning_files(self.files, self.limits), "doc_id", "left_semi")
        return self.files.where(documents.leans_on_others(F.col("content")))

    @cached_property
    def _alone(self) -> DataFrame:
        if self._by_ranges:
            return self.files.join(documents.leaning_files(self.files, self.limits), "doc_id", "left_anti")
        return self.files.where(~documents.leans_on_others(F.col("content")))

    @cached_property
    def _linked(self) -> DocumentSet:
        """The documents that lean on other files; only these take the relational way to their pages."""
        some = DocumentSet(self._leaning, self._supplied, self.limits)
        if self._supplied is None:
            some.__dict__["supplied"] = self.supplied
        return some

    def _page_rows(self, wanted) -> DataFrame:
        """One row a page with its information and its expanded chunks of the wanted ids."""
        if not self._any_linked:
            return documents.whole_pages(self.files, wanted, self.limits)
        return documents.whole_pages(self._alone, wanted, self.limits).unionByName(self._linked._joined_pages(wanted))

    def _joined_pages(self, wanted) -> DataFrame:
        """The same by joins: components may be files of their own."""
        hashes = self._loaded.where("loaded AND kind <> 'page'").select("doc_id", "comp", F.sha2(F.to_json(F.transform("chunks", lambda c: F.struct(c["chunk_id"], F.base64(c["payload"])))), 256).alias("form_hash"))
        kept = self._expanded.where(wanted.column(F.col("chunk_id")))
        rows = kept.join(self._edges.select("doc_id", F.col("src").alias("comp"), "ord", "dst"), ["doc_id", "comp", "ord"], "left").join(hashes, ["doc_id", "comp"], "left")
        parts = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("place", "comp", "ord", "chunk_id", "payload", "dst", "form_hash"))).alias("parts"))
        p = self._page_info.join(self._page_status.select("doc_id", "page", "expanded"), ["doc_id", "page"]).join(parts, ["doc_id", "page"], "left")
        return p.withColumn("parts", F.coalesce("parts", F.array().cast(f"array<{documents.PART}>")))

    @cached_property
    def containers(self) -> DataFrame:
        """Directories only, no payloads: kept, as most tables of linked documents read them more than once."""
        return documents.containers(self.files, self.limits).persist()

    @cached_property
    def forms(self) -> DataFrame:
        return documents.forms(self.files, self.limits)

    def _forms(self, wanted: Wanted | None) -> DataFrame:
        """The forms with payloads of wanted chunks only, unless all are kept anyway."""
        return self.forms if wanted is None or self._kept else documents.forms(self.files, self.limits, wanted)

    @cached_property
    def supplied(self) -> DataFrame:
        return self._supplied_forms(None)

    def _supplied_forms(self, wanted_chunks: Wanted | None) -> DataFrame:
        """(doc_id, name, form, length, chunks): component files by the document they are for."""
        if "supplied" in self.__dict__:
            return self.supplied
        if self._supplied is not None:
            named = self._supplied.withColumn("key", F.to_json(F.array("doc_id", "name")))
            found = documents.forms(named.select(F.col("key").alias("doc_id"), "content"), self.limits, wanted_chunks).where("offset = 4 AND status = 'ok'")
            of = F.from_json("doc_id", "array<string>")
            return found.select(of[0].alias("doc_id"), of[1].alias("name"), "form", "length", "chunks")
        wanted = self.containers.where("indirect").select(F.col("doc_id").alias("of"), F.explode("entries").alias("e")).select("of", F.col("e.name").alias("name"))
        # Only plain names of files beside the index; nothing that leads elsewhere.
        plain = ~F.col("name").rlike(r"[/\\:\x00]") & ~F.col("name").isin("", ".", "..")
        wanted = wanted.where(plain).withColumn("doc_id", F.concat(F.regexp_replace("of", r"[^/]*\z", ""), "name")).distinct()
        roots = self._forms(wanted_chunks).where("offset = 4 AND status = 'ok'")
        return roots.join(wanted, "doc_id").select(F.col("of").alias("doc_id"), "name", "form", "length", "chunks")

    @cached_property
    def _entries(self) -> DataFrame:
        good = self.containers.where("status = 'ok'").select("doc_id", "form_type", "indirect", F.explode("entries").alias("e"))
        return good.select("doc_id", "form_type", "indirect", "e.*")

    @cached_property
    def _loaded(self) -> DataFrame:
        return self._loaded_with(None)

    @cached_property
    def _headers(self) -> DataFrame:
        """Components without payloads, for questions about what is there."""
        return self._loaded_with(Wanted())

    def _loaded_with(self, wanted: Wanted | None) -> DataFrame:
        """Components with their chunks, payloads of the wanted ones only; form is null where they aren't loaded."""
        inside = self._entries.where("offset IS NOT NULL").join(self._forms(wanted).select("doc_id", "offset", "form", F.col("length").alias("found"), "chunks", F.col("status").alias("form_status")), ["doc_id", "offset"], "left")
        outside = self._entries.where("offset IS NULL").join(
            self._supplied_forms(wanted).select("doc_id", "name", "form", F.col("length").alias("found"), "chunks", F.lit("ok").alias("form_status")), ["doc_id", "name"], "left"
        )
        rows = inside.select(outside.columns).unionByName(outside)
        needed = F.when(F.col("form_type").isin("PM44", "BM44", "THUM"), F.col("form")).otherwise(F.when(F.col("kind") == "page", "DJVU").when(F.col("kind") == "thumbnail", "THUM").otherwise("DJVI"))
        wrong = F.col("form").isNotNull() & ((F.col("form") != needed) | ((F.col("size") != 0) & (F.col("size") != F.col("found"))))
        status = F.when(F.col("form_status").isNull(), "MissingComponent").when(F.col("form_status") != "ok", F.col("form_status")).when(wrong, "InvalidData").otherwise("ok")
        return rows.withColumn("status", status).withColumn("loaded", F.col("status") == "ok").withColumn("chunks", F.when(F.col("loaded"), F.col("chunks")))

    def components(self) -> DataFrame:
        size = F.when(F.col("size") != 0, F.col("size")).otherwise(F.coalesce("found", F.lit(0)))
        return self._headers.select("doc_id", "comp", "id", "name", "title", "kind", size.alias("size"), F.col("offset").alias("range_offset"), F.when(F.col("offset").isNotNull(), F.col("found")).alias("range_length"), "loaded", "status")

    def documents(self) -> DataFrame:
        counts = self._page_list.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
        c = self.containers.select("doc_id", F.col("doc_id").alias("path"), "size", "form_type", "indirect", "status", "error")
        return c.join(counts, "doc_id", "left").withColumn("page_count", F.when(F.col("status") == "ok", F.coalesce("page_count", F.lit(0))))

    @cached_property
    def _chunks(self) -> DataFrame:
        return self._chunks_of(self._loaded)

    def _chunks_of(self, loaded: DataFrame) -> DataFrame:
        return loaded.where("loaded").select("doc_id", "comp", "kind", F.explode("chunks").alias("c")).select("doc_id", "comp", "kind", "c.*")

    def chunks(self) -> DataFrame:
        return self._chunks.drop("kind")

    @cached_property
    def _edges(self) -> DataFrame:
        plain = self._chunks_of(self._loaded_with(Wanted("INCL"))).where("chunk_id = 'INCL'").join(self._entries.select("doc_id", "form_type").distinct(), "doc_id").where(~F.col("form_type").isin("PM44", "BM44"))
        return includes.edges(plain, self._entries)

    def includes(self) -> DataFrame:
        return self._edges.select("doc_id", "src", "ord", "dst")

    @cached_property
    def _page_list(self) -> DataFrame:
        """(doc_id, page, comp, form_type, image): pages in directory order; of a thumbnail file every image is a page."""
        order = Window.partitionBy("doc_id").orderBy("comp")
        entries = self._entries.where("kind = 'page'")
        pages = entries.select("doc_id", (F.row_number().over(order) - 1).alias("page"), "comp", "form_type", F.lit(None).cast("int").alias("image"), "id", "name", "title")
        images = self._headers.where("form_type = 'THUM'").select("doc_id", "comp", "form_type", F.posexplode(F.filter("chunks", lambda c: c["chunk_id"] == "TH44")).alias("page", "c"))
        return pages.unionByName(images.select("doc_id", "page", "comp", "form_type", F.col("c.ord").alias("image"), *[F.lit("").alias(n) for n in ("id", "name", "title")]))

    @cached_property
    def _page_info(self) -> DataFrame:
        """(doc_id, page, comp, form_type, image, info, status)."""
        heads = self._loaded_with(Wanted("INFO", "PM44", "BM44", "TH44"))
        p = self._page_list.join(heads.select("doc_id", "comp", "chunks", F.col("status").alias("comp_status")), ["doc_id", "comp"], "left")
        named = F.filter("chunks", lambda c: c["chunk_id"] == "INFO")
        first = F.filter("chunks", lambda c: c["chunk_id"] == F.col("form_type"))
        image = F.filter("chunks", lambda c: c["ord"] == F.col("image"))
        wave = F.col("form_type").isin("PM44", "BM44")
        head = F.when(wave, F.get(first, F.lit(0))).when(F.col("form_type") == "THUM", F.get(image, F.lit(0))).when(F.size(named) == 1, F.get(named, F.lit(0)))
        data = head["payload"]
        info = F.when(wave, native.wavelet_info(data, 100)).when(F.col("form_type") == "THUM", native.wavelet_info(data, 300)).otherwise(native.info(data))
        p = p.withColumn("info", info)
        pixels = F.col("info.width").cast("long") * F.col("info.height")
        status = F.when(F.col("comp_status") != "ok", F.col("comp_status")).when(F.col("info").isNull(), "InvalidData").when(pixels > self.limits.page_pixels, "LimitExceeded").otherwise("ok")
        return p.select("doc_id", "page", "comp", "form_type", "image", "info", status.alias("status"))

    def pages(self) -> DataFrame:
        return self._page_rows(Wanted()).select("doc_id", "page", "comp", "info.*", "status")

    @cached_property
    def _expansion(self) -> DataFrame:
        pages = self._page_list.select("doc_id", F.col("comp").alias("root")).distinct()
        return includes.expansion(self._headers.select("doc_id", "comp", "kind", "loaded"), self._edges, pages, self.limits)

    @cached_property
    def _page_status(self) -> DataFrame:
        """(doc_id, page, comp, expanded): status of each page's expansion."""
        bad = self._expansion.where("status <> 'ok'").select("doc_id", F.col("root").alias("comp"), "status")
        stray = self._expansion.where("status = 'ok' AND comp <> root").join(self._chunks_of(self._headers).where("chunk_id = 'INFO'").select("doc_id", "comp").distinct(), ["doc_id", "comp"])
        stray = stray.select("doc_id", F.col("root").alias("comp"), F.lit("InvalidData").alias("status"))
        worst = bad.unionByName(stray).groupBy("doc_id", "comp").agg(F.min("status").alias("expanded"))
        return self._page_list.select("doc_id", "page", "comp").join(worst, ["doc_id", "comp"], "left").withColumn("expanded", F.coalesce("expanded", F.lit("ok")))

    @cached_property
    def _expanded(self) -> DataFrame:
        good = self._page_status.where("expanded = 'ok'").select("doc_id", "page", F.col("comp").alias("root"))
        visits = self._expansion.where("status = 'ok'").select("doc_id", "root", "comp", "path")
        j = good.join(visits, ["doc_id", "root"]).join(self._chunks, ["doc_id", "comp"]).join(self._page_list.select("doc_id", "page", "image"), ["doc_id", "page"])
        return j.where("image IS NULL OR ord = image").withColumn("place", F.concat("path", F.array("ord"))).drop("image")

    def page_chunks(self) -> DataFrame:
        """(doc_id, page, seq, comp, chunk_id, payload): chunks of a page with includes expanded in place, unknown ones included."""
        rows = self._page_rows(Wanted(starts=("",))).where("expanded = 'ok'")
        kept = F.filter("parts", lambda p: (p["chunk_id"] != "INCL") | F.col("form_type").isin("PM44", "BM44"))
        return rows.select("doc_id", "page", F.posexplode(kept).alias("seq", "p")).select("doc_id", "page", "seq", "p.comp", "p.chunk_id", "p.payload")

    def missing(self, scope: str = "includes") -> DataFrame:
        """(doc_id, page, comp, id): the next component a page needs for a scope (page, includes, thumbnail) and that isn't loaded."""
        ids = self._entries.select("doc_id", "comp", "id")
        if scope == "page":
            lack = self._page_list.select("doc_id", "page", "comp").join(self._headers.where("NOT loaded").select("doc_id", "comp"), ["doc_id", "comp"], "left_semi")
        elif scope == "includes":
            lack = includes.missing(self._expansion, self._entries).withColumnRenamed("root", "of").drop("id")
            lack = self._page_list.select("doc_id", "page", F.col("comp").alias("of")).join(lack, ["doc_id", "of"]).select("doc_id", "page", "comp")
        elif scope == "thumbnail":
            lack = self.thumbnail_sources().where("status = 'MissingComponent'").select("doc_id", "page", "comp")
        else:
            raise ValueError(scope)
        return lack.join(ids, ["doc_id", "comp"]).select("doc_id", "page", "comp", "id")

    def _text_chunks(self) -> DataFrame:
        """(doc_id, page, chunk_id, payload, height, status) of pages with a text chunk, or whose expansion fails."""
        rows = self._page_rows(Wanted("TXTa", "TXTz"))
        n, part = F.size("parts"), F.get(F.col("parts"), F.lit(0))
        status = F.when(F.col("expanded") != "ok", F.col("expanded")).when(n > 1, "InvalidData").otherwise(F.col("status"))
        return rows.where((n > 0) | (F.col("expanded") != "ok")).select("doc_id", "page", part["chunk_id"].alias("chunk_id"), part["payload"].alias("payload"), F.col("info.height").alias("height"), status.alias("status"))

    def text(self) -> DataFrame:
        """(doc_id, page, bytes, text, has_replacements, zones, status): no row where a page has no text chunk."""
        limits = self.limits

        def call(doc_id, page, chunk_id, payload, height, status):
            zones, data = [], None
            if status == "ok":
                got, status, _ = guarded(decode_text, payload, chunk_id == "TXTz", height, limits)
                if got is not None:
                    data = got[0]
                    zones = [(k, *z) for k, z in enumerate(got[1])]
            yield doc_id, page, data, None if data is None else not is_utf8(data), zones, status

        schema = f"doc_id string, page int, bytes binary, has_replacements boolean, zones array<{ZONE}>, status string"
        out = flat_map(self._text_chunks(), schema, call)
        return out.select("doc_id", "page", "bytes", native.repaired(F.col("bytes")).alias("text"), "has_replacements", "zones", "status")

    def zones(self) -> DataFrame:
        """One row a zone of the pages whose text can be read, in preorder."""
        limits = self.limits

        def call(doc_id, page, chunk_id, payload, height, status):
            if status == "ok":
                got, _, _ = guarded(decode_text, payload, chunk_id == "TXTz", height, limits)
                if got is not None:
                    yield from ((doc_id, page, k, *z) for k, z in enumerate(got[1]))

        fields = ZONE.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
        return flat_map(self._text_chunks(), f"doc_id string, page int, {fields}", call, 8192)

    def page_zones(self, selectable_only: bool = False) -> DataFrame:
        """(doc_id, page, zones): the same zones as an array in preorder a page, for questions that stay inside a page; or the selectable ones alone."""
        limits = self.limits

        def call(doc_id, page, chunk_id, payload, height, status):
            if status == "ok":
                got, _, _ = guarded(decode_text, payload, chunk_id == "TXTz", height, limits)
                if got is not None:
                    found = got[1]
                    yield doc_id, page, [(k, *found[k]) for k in (selectable(found) if selectable_only else range(len(found)))]

        return flat_map(self._text_chunks(), f"doc_id string, page int, zones array<{ZONE}>", call)

    def outline(self) -> DataFrame:
        """(doc_id, idx, title, href, parent, subtree_end, status): one row with a status where the outline is damaged."""
        root = self._forms(Wanted("NAVM")).join(self.containers.where("status = 'ok'").select("doc_id", "form_type"), "doc_id").where("form = form_type").where("offset <= 4")
        navm = F.filter("chunks", lambda c: c["chunk_id"] == "NAVM")
        few = root.select("doc_id", F.transform(navm, lambda c: c["payload"]).alias("payloads")).where(F.size("payloads") > 0)
        limits = self.limits

        def call(doc_id, payloads):
            got, status, _ = guarded(decode_outline, payloads[0], limits) if len(payloads) == 1 else (None, "InvalidData", None)
            if got is None:
                yield doc_id, None, None, None, None, None, status
            else:
                yield from ((doc_id, k, *e, status) for k, e in enumerate(got))

        return flat_map(few, "doc_id string, idx int, title string, href string, parent int, subtree_end int, status string", call)

    @cached_property
    def _plain_annotations(self) -> DataFrame:
        return metadata.plain_annotations(self._chunks, self.limits)

    def annotations(self) -> DataFrame:
        """One row for each page with annotation chunks, parsed after they are put on end."""
        rows = self._page_rows(Wanted("ANTa", "ANTz")).where("size(parts) > 0")
        limits = self.limits

        def plain(parts):
            at, out, chunks = 0, [], []
            for p in parts:
                left = limits.annotation_bytes - at
                data = p["payload"]
                if p["chunk_id"] == "ANTz" and data:
                    data = bzz_decode(data, min(left, limits.bzz_bytes), limits)
                if len(data) > left:
                    raise exceeded("annotations")
                chunks.append((p["comp"], at, len(data)))
                out.append(data)
                at += len(data)
            return b"".join(out), chunks

        def call(doc_id, page, parts, info, status):
            chunks, got = [], None
            if status == "ok":
                got, status, _ = guarded(plain, parts)
                if got is not None:
                    data, chunks = got
                    got, status, _ = guarded(decode_annotations, data, Info(**info), limits)
            if got is None:
                yield doc_id, page, None, None, None, None, chunks, [], None, [], [], None, None, None, status
                return
            yield (
                doc_id, page, got["source"], got["bytes"], got["has_replacements"], got["legacy_escapes"], chunks, got["expressions"], got["view"], got["areas"],
                got["metadata"], got["xmp"], got["header"], got["footer"], status,
            )

        return flat_map(rows.select("doc_id", "page", "parts", "info", "status"), ANNOTATIONS, call)

    def areas(self) -> DataFrame:
        return self.annotations().where("status = 'ok'").select("doc_id", "page", F.explode("areas").alias("a")).select("doc_id", "page", "a.*")

    @cached_property
    def _records(self) -> DataFrame:
        if not self._any_linked:
            return documents.whole_records(self.files, self.limits)
        return documents.whole_records(self._alone, self.limits).unionByName(self._linked._joined_records.select("doc_id", "root", "seq", "xmp", "key", "value", "page", "status"))

    @cached_property
    def _joined_records(self) -> DataFrame:
        parts = self._headers.select("doc_id", "comp", "kind", "loaded")
        starts = metadata.roots(parts, self._edges)
        whole = includes.expansion(parts, self._edges, starts, self.limits)
        pages = self._page_list.where("image IS NULL").select("doc_id", "comp", "page")
        return metadata.records(metadata.streams(self._plain_annotations, whole), pages, self.limits)

    def metadata(self) -> DataFrame:
        """(doc_id, seq, key, value, page): entries in the order of roots and streams; page is null for shared ones."""
        order = Window.partitionBy("doc_id").orderBy("root", "k")
        rows = self._records.where("NOT xmp").withColumnRenamed("seq", "k")
        return rows.withColumn("seq", F.row_number().over(order) - 1).select("doc_id", "seq", "key", "value", "page")

    def xmp(self) -> DataFrame:
        order = Window.partitionBy("doc_id").orderBy("root", "k")
        rows = self._records.where("xmp").withColumnRenamed("seq", "k")
        return rows.withColumn("seq", F.row_number().over(order) - 1).select("doc_id", "seq", "value", "page")

    def metadata_status(self) -> DataFrame:
        """(doc_id, status): documents whose annotation streams can't be read."""
        broken = self._records.where("status <> 'ok'").select("doc_id", "status")
        if self._any_linked:
            broken = broken.unionByName(self._linked._plain_annotations.where("status <> 'ok'").select("doc_id", "status"))
        return broken.groupBy("doc_id").agg(F.min("status").alias("status"))

    def resolve_links(self, found: DataFrame) -> DataFrame:
        """found (doc_id, href, from_page) with link struct<kind,page>."""
        return links.resolve_links(found, self._page_list.select("doc_id", "page", "id", "name", "title"))

    def geometry(self, requests: DataFrame) -> DataFrame:
        """requests (doc_id, page and any of subsample, box_width, box_height, rotation, x, y, width, height) with g, t and status.

        g has the output's dimensions, t the affine maps from and to source pixels; both are null where the status isn't ok.
        """
        given = lambda n, default=None: F.coalesce(F.col(n).cast("int"), F.lit(default).cast("int")) if n in requests.columns else F.lit(default).cast("int")
        ss, bw, bh, turn = given("subsample", 1), given("box_width"), given("box_height"), given("rotation", 0)
        region = [given(n) for n in ("x", "y", "width", "height")]
        p = self._page_rows(Wanted()).select("doc_id", "page", F.col("info").alias("__i"), F.col("status").alias("__s"))
        rows = requests.join(p, ["doc_id", "page"], "left")
        # Out-of-range numbers are replaced before they divide; their rows end as InvalidArgument.
        safe = lambda c: F.when(c >= 1, c).otherwise(1)
        box = lambda c: F.when(c.isNotNull(), safe(c))
        g = native.geometry(F.col("__i.width"), F.col("__i.height"), F.col("__i.rotation"), safe(ss), box(bw), box(bh), turn)
        rows = rows.withColumn("__g", F.when(F.col("__s") == "ok", g))
        valid = native.request_is_valid(F.col("__g"), ss, bw, bh, *region)
        status = F.when(F.col("__s") != "ok", F.col("__s")).when(F.col("__s").isNull() | ~valid, "InvalidArgument").otherwise("ok")
        rows = rows.withColumn("status", status)
        zero = F.lit(0)
        t = native.transform(F.col("__g"), F.col("__i.width"), F.col("__i.height"), safe(ss), bw.isNotNull(), F.coalesce(region[0], zero), F.coalesce(region[1], zero))
        fine = F.col("status") == "ok"
        return rows.withColumn("g", F.when(fine, F.col("__g"))).withColumn("t", F.when(fine, t)).drop("__i", "__s", "__g")

    def _layers(self) -> DataFrame:
        """(doc_id, page, form_type, info, parts, status): what rendering a page needs."""
        status = F.when(F.col("status") == "ok", F.col("expanded")).otherwise(F.col("status"))
        return self._page_rows(Wanted(*ROLES, starts=("BG", "FG"))).select("doc_id", "page", "form_type", "info", "parts", status.alias("status"))

    def render(self, requests: DataFrame | None = None) -> DataFrame:
        """Rasters of requests (doc_id, page and any of request_id, subsample, box_width, box_height, rotation, x, y, width, height).

        Without requests every page is rendered whole. A page's layers are decoded once for all its requests.
        """
        fields = ["request_id", "subsample", "box_width", "box_height", "rotation", "x", "y", "width", "height"]
        kinds = dict.fromkeys(fields, "int") | {"request_id": "string"}
        field = lambda f: (F.col(f).cast(kinds[f]) if requests is not None and f in requests.columns else F.lit(None).cast(kinds[f])).alias(f)
        request = F.struct(*map(field, fields))
        if requests is None:
            rows = self._layers().withColumn("requests", F.array(request))
        else:
            per_page = requests.groupBy("doc_id", "page").agg(F.collect_list(request).alias("requests"))
            rows = per_page.join(self._layers(), ["doc_id", "page"], "left")
        limits = self.limits

        def call(doc_id, page, requests, form, info, status, parts):
            if status != "ok":
                for r in requests:
                    yield doc_id, page, r["request_id"], None, None, None, None, None, None, None, None, None, status or "InvalidArgument"
                return
            found = [Part(p["comp"], p["chunk_id"], p["payload"], p["dst"], p["form_hash"]) for p in parts or ()]
            for r, t, rgba, state in render_requests(Info(**info), form if form != "DJVM" else "DJVU", found, requests, limits):
                at = (t.x, t.y, t.width, t.height, t.page_width, t.page_height, list(t.matrix), list(t.inverse)) if t is not None else (None,) * 8
                yield doc_id, page, r["request_id"], *at, rgba, state

        return flat_map(rows.select("doc_id", "page", "requests", "form_type", "info", "status", "parts"), RASTERS, call)

    def thumbnail_sources(self) -> DataFrame:
        """(doc_id, page, comp, ord, status): first chunk of each stored thumbnail; only the nearest thumbnail component counts, then the page itself."""
        near = links.thumbnail_order(self._entries.select("doc_id", "comp", "kind"))
        state = self._headers.select("doc_id", "comp", "loaded", "form", F.transform(F.filter("chunks", lambda c: c["chunk_id"] == "TH44"), lambda c: c["ord"]).alias("images"))
        as_thumb = state.select("doc_id", F.col("comp").alias("thumb"), F.col("loaded").alias("t_loaded"), F.col("images").alias("t_images"))
        pages = self._page_list.where("image IS NULL").select("doc_id", "page", "comp")
        j = pages.join(near, ["doc_id", "comp"]).join(as_thumb, ["doc_id", "thumb"], "left").join(state, ["doc_id", "comp"], "left")
        stored = F.get(F.col("t_images"), F.col("ordinal").cast("int"))
        local = F.when(F.col("form") == "DJVU", F.get(F.col("images"), F.lit(0)))
        waits = F.col("thumb").isNotNull() & ~F.col("t_loaded")
        out = j.select(
            "doc_id", "page", F.when(waits | stored.isNotNull(), F.col("thumb")).otherwise(F.col("comp")).alias("at"), F.when(~waits | F.col("thumb").isNull(), F.coalesce(stored, local)).alias("ord"),
            F.when(waits | (stored.isNull() & ~F.col("loaded")), "MissingComponent").otherwise("ok").alias("status"),
        ).where("ord IS NOT NULL OR status <> 'ok'")
        own = self._page_list.where("image IS NOT NULL").select("doc_id", "page", F.col("comp").alias("at"), F.col("image").alias("ord"), F.lit("ok").alias("status"))
        return out.unionByName(own).withColumnRenamed("at", "comp")

    def thumbnails(self) -> DataFrame:
        """(doc_id, page, width, height, rgba, status) of stored thumbnails, at their own size, without page gamma or rotation."""
        src = self.thumbnail_sources()
        # Chunks of a page are parts of one image, those of a thumbnail component images of their own.
        parts = self._chunks.where("chunk_id = 'TH44'").select("doc_id", "comp", "kind", F.col("ord").alias("o"), "payload")
        j = src.where("status = 'ok'").join(parts, ["doc_id", "comp"]).where("o = ord OR (kind = 'page' AND o > ord)")
        rows = j.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("o", "payload"))).alias("parts"))
        limits = self.limits

        def call(doc_id, page, parts):
            from docspark.kernels.iw44 import parse_header

            head, status, _ = guarded(parse_header, parts[0]["payload"])
            if head is None:
                yield doc_id, page, None, None, None, status
                return
            found = [Part(0, "TH44", p["payload"], None, None) for p in parts]
            for _, t, rgba, state in render_requests(Info(head.width, head.height, 300, 0), "THUM", found, [{}], limits, thumbnail=True):
                yield doc_id, page, t and t.width, t and t.height, rgba, state

        out = flat_map(rows, "doc_id string, page int, width int, height int, rgba binary, status string", call)
        lost = src.where("status <> 'ok'").select("doc_id", "page", F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("binary").alias("rgba"), "status")
        return out.unionByName(lost)

    def persist(self) -> DocumentSet:
        """Keep the parsed forms; later tables read them instead of the files."""
        self.containers.persist()
        self.forms = self.forms.persist()
        self._kept = True
        return self

    def unpersist(self) -> None:
        """Release what is kept; the directories are, once a question needed them, even outside ``with``."""
        if "containers" in self.__dict__:
            self.containers.unpersist()
        if self._kept:
            self.forms.unpersist()
        if "_linked" in self.__dict__:
            self._linked.unpersist()
        self._kept = False

    def __enter__(self) -> DocumentSet:
        return self.persist()

    def __exit__(self, *_) -> None:
        self.unpersist()


def zone_text(data: Column, start: Column, length: Column) -> Column:
    return native.span_text(data, start, length)
