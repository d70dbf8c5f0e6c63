"""Registration of codecs and parsers as SQL functions; a damaged input gives null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docspark.encode.pack import ppm
from docspark.kernels import iff, jb2
from docspark.kernels.annot import decode_annotations, legacy_strings, metadata_fields, parse
from docspark.kernels.bzz import bzz_decode
from docspark.functions.render import options_of
from docspark.kernels.core import LIMITS, Bad
from docspark.kernels.geometry import axis_window, transform
from docspark.kernels.iw44 import decode_iw44, parse_header
from docspark.kernels.jpeg import decode_jpeg
from docspark.kernels.mmr import decode_mmr
from docspark.kernels.outline import decode_outline
from docspark.kernels.palette import parse_palette
from docspark.kernels.text import decode_text

IMAGE = "struct<width:int,height:int,rgb:binary>"
MASK = "struct<width:int,height:int,mask:binary>"


def _image(rgb: np.ndarray) -> tuple:
    return rgb.shape[1], rgb.shape[0], np.ascontiguousarray(rgb).tobytes()


def _mask(ink: np.ndarray) -> tuple:
    """Packed bits, top row first, lowest bit first, rows without padding."""
    return ink.shape[1], ink.shape[0], np.packbits(ink.ravel(), bitorder="little").tobytes()


def _jb2(data: bytes) -> tuple:
    image = jb2.decode_jb2(data)
    return _mask(jb2.rasterize(image, image.width, image.height)[0])


def _annotations(data: bytes) -> dict:
    out = decode_annotations(data, iff.Info(1, 1, 300, 0))
    return {"metadata": out["metadata"], "xmp": out["xmp"], "n_areas": len(out["areas"]), "legacy_escapes": out["legacy_escapes"]}


#: name: (result type, function of one binary value).
SCALARS = {
    "bzz_decode": ("binary", lambda d: bzz_decode(d, LIMITS.bzz_bytes)),
    "info_parse": ("struct<width:int,height:int,dpi:int,rotation:int,gamma_tenths:int,version:int>", lambda d: tuple(iff.parse_info(d))),
    "text_decode": ("binary", lambda d: decode_text(d, False, 0)[0]),
    "annotations_decode": ("struct<metadata:array<struct<key:string,value:string,expression:int>>,xmp:string,n_areas:int,legacy_escapes:boolean>", _annotations),
    "mmr_decode": (MASK, lambda d: _mask(decode_mmr(d))),
    "jb2_decode": (MASK, _jb2),
    "fgbz_parse": ("struct<colors:array<int>,indices:array<int>>", lambda d: _palette(d)),
    "iw44_header": ("struct<width:int,height:int,color:boolean,half_chroma:boolean,delay:int,size:int>", lambda d: tuple(parse_header(d))),
    "iw44_decode": (IMAGE, lambda d: _image(decode_iw44([d]))),
    "jpeg_decode": (IMAGE, lambda d: _image(decode_jpeg(d))),
    "thumbnail_decode": (IMAGE, lambda d: _image(decode_iw44([d]))),
}
GEOMETRY = "struct<page_width:int,page_height:int,rotation:int,matrix:array<double>,inverse:array<double>>"
RASTER = "struct<width:int,height:int,rgba:binary,status:string>"


def _geometry_of(width, height, stored, subsample, box_width, box_height, turn) -> tuple | None:
    box = None if pd.isna(box_width) else (int(box_width), int(box_height))
    try:
        t = transform(iff.Info(int(width), int(height), 300, int(stored)), options_of({"subsample": int(subsample), "box_width": box and box[0], "box_height": box and box[1], "rotation": int(turn)}))
    except (Bad, TypeError, ValueError):
        return None
    return t.page_width, t.page_height, t.rotation, list(t.matrix), list(t.inverse)


def _render_page(content: bytes, page: int, subsample: int) -> tuple:
    """A page of a file that leans on no others."""
    from docspark.functions.render import Part, render_requests
    from docspark.plans.document_set import ROLES, Wanted
    from docspark.sources.documents import _pages_of, directory_of

    try:
        root = iff.root(content)
        _, entries = directory_of(root, LIMITS)
    except Bad as e:
        return None, None, None, e.code
    for number, _, form, _, info, status, expanded, parts in _pages_of(root, entries, Wanted(*ROLES, starts=("BG", "FG")), LIMITS):
        if number == page:
            if status != "ok" or expanded != "ok":
                return None, None, None, status if status != "ok" else expanded
            found = [Part(comp, id_, data, target, digest) for _, comp, _, id_, data, target, digest in parts]
            for _, t, rgba, state in render_requests(iff.Info(*info), form if form != "DJVM" else "DJVU", found, [{"subsample": subsample}]):
                return t and t.width, t and t.height, rgba, state
    return None, None, None, "InvalidArgument"


def _palette(data: bytes) -> dict:
    colors, index = parse_palette(data, None)
    return {"colors": [int(r) << 16 | int(g) << 8 | int(b) for r, g, b in colors], "indices": [int(k) for k in index]}


def _scalar(type_: str, call):
    from pyspark.sql.types import StructType, _parse_datatype_string

    def one(d):
        try:
            return None if d is None else call(bytes(d))
        except Bad:
            return None

    def plain(data: pd.Series) -> pd.Series:
        return pd.Series([one(d) for d in data], dtype=object)

    type_of = _parse_datatype_string(type_)
    if not isinstance(type_of, StructType):
        return F.pandas_udf(plain, type_of)
    names = type_of.names

    def table(data: pd.Series) -> pd.DataFrame:
        rows = [(None,) * len(names) if r is None else tuple(r[n] for n in names) if isinstance(r, dict) else r for r in map(one, data)]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return F.pandas_udf(table, type_of)


@F.udtf(returnType="ord int, chunk_id string, offset long, length long, payload binary")
class IffChunks:
    """Chunks of a file's root FORM."""

    def eval(self, content: bytes):
        try:
            yield from ((k, c.id, c.offset, len(c.data), c.data) for k, c in enumerate(iff.root(bytes(content)).children()))
        except Bad:
            return


@F.udtf(returnType="comp int, id string, name string, title string, kind string, size long, offset long")
class DirmEntries:
    def eval(self, payload: bytes):
        try:
            for k, e in enumerate(iff.parse_directory(bytes(payload))[1]):
                yield k, e.id.decode("utf-8", "replace"), e.name.decode("utf-8", "replace"), e.title.decode("utf-8", "replace"), e.kind, e.size, e.offset
        except Bad:
            return


@F.udtf(returnType="idx int, kind string, parent int, x int, y int, width int, height int, text_start long, text_length long, subtree_end int, depth int")
class TextZones:
    def eval(self, payload: bytes, page_height: int):
        try:
            yield from ((k, *z) for k, z in enumerate(decode_text(bytes(payload), False, page_height)[1]))
        except Bad:
            return


@F.udtf(returnType="idx int, title string, href string, parent int, subtree_end int")
class OutlineEntries:
    def eval(self, payload: bytes):
        try:
            yield from ((k, *e) for k, e in enumerate(decode_outline(bytes(payload))))
        except Bad:
            return


@F.udtf(returnType="xmp boolean, key string, value string, start long, finish long")
class MetadataFields:
    def eval(self, data: bytes):
        try:
            yield from (tuple(f) for f in metadata_fields(bytes(data)))
        except Bad:
            return


@F.udtf(returnType="idx int, depth int, kind string, value string, start long, finish long")
class SexprNodes:
    def eval(self, data: bytes):
        data = bytes(data)
        try:
            stack = [(0, n) for n in reversed(parse(data, legacy_strings(data))[0])]
        except Bad:
            return
        k = 0
        while stack:
            depth, n = stack.pop()
            yield k, depth, n.kind, n.value, n.start, n.end
            k += 1
            stack += [(depth + 1, c) for c in reversed(n.items)]


@F.udtf(returnType="blit int, symbol int, left int, bottom int, width int, height int")
class Jb2Blits:
    def eval(self, data: bytes):
        try:
            image = jb2.decode_jb2(bytes(data))
        except Bad:
            return
        yield from ((k, s, x, y, image.symbols[s].width, image.symbols[s].height) for k, (s, x, y) in enumerate(image.blits))


@F.udtf(returnType="at long, weight long")
class AxisWeights:
    def eval(self, pixel: int, source: int, output: int):
        first, weights, _ = axis_window(pixel, source, output)
        yield from ((max(0, min(source - 1, first + k)), w) for k, w in enumerate(weights))


TABLES = {
    "iff_chunks": IffChunks, "dirm_entries": DirmEntries, "text_zones": TextZones, "outline_entries": OutlineEntries, "metadata_fields": MetadataFields,
    "sexpr_nodes": SexprNodes, "jb2_blits": Jb2Blits, "axis_weights": AxisWeights,
}


def register(spark: SparkSession) -> None:
    """All functions by name, for spark.sql."""
    for name, (type_, call) in SCALARS.items():
        spark.udf.register(name, _scalar(type_, call))
    for name, table in TABLES.items():
        spark.udtf.register(name, table)

    @F.pandas_udf("binary")
    def ppm_encode(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else ppm(int(w), int(h), bytes(p)) for w, h, p in zip(width, height, rgba, strict=True)], dtype=object)

    @F.pandas_udf(GEOMETRY)
    def geometry_of(width: pd.Series, height: pd.Series, stored: pd.Series, subsample: pd.Series, box_width: pd.Series, box_height: pd.Series, turn: pd.Series) -> pd.DataFrame:
        rows = [_geometry_of(*r) or (None,) * 5 for r in zip(width, height, stored, subsample, box_width, box_height, turn, strict=True)]
        return pd.DataFrame(rows, columns=["page_width", "page_height", "rotation", "matrix", "inverse"], dtype=object)

    @F.pandas_udf(RASTER)
    def render_page(content: pd.Series, page: pd.Series, subsample: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 4 if c is None else _render_page(bytes(c), int(p), int(s)) for c, p, s in zip(content, page, subsample, strict=True)]
        return pd.DataFrame(rows, columns=["width", "height", "rgba", "status"], dtype=object)

    @F.pandas_udf("binary")
    def union_mask(mask: pd.Series) -> bytes:
        """Packed masks of one size, as jb2_decode and mmr_decode give them, laid over each other."""
        rows = [np.frombuffer(bytes(m), np.uint8) for m in mask if m is not None]
        return np.bitwise_or.reduce(rows).tobytes() if rows else None

    spark.udf.register("ppm_encode", ppm_encode)
    for name, call in (("geometry_of", geometry_of), ("render_page", render_page), ("union_mask", union_mask)):
        spark.udf.register(name, call)
    kind = "CASE WHEN href IS NULL OR href = '' THEN 'none' WHEN startswith(href, '?') THEN 'options' WHEN NOT startswith(href, '#') THEN 'url' ELSE 'page' END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION link_kind(href STRING) RETURNS STRING RETURN {kind}")
