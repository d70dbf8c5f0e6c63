"""JSON and picture output of documents' answers."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.encode.pack import ppm

#: Nulls are written: absent and empty differ.
NULLS = {"ignoreNullFields": "false"}


def _numbers(data: Column) -> Column:
    """Bytes as an array of numbers, for text that JSON can't give back."""
    at = F.sequence(F.lit(1), F.length(data))
    return F.when(F.length(data) > 0, F.transform(at, lambda k: F.conv(F.hex(F.substr(data, k, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def text_json(text: DataFrame) -> DataFrame:
    """(doc_id, page, json) of a text table; source bytes are there only where the shown text had to be repaired."""
    zone = lambda z: F.struct(z["kind"].alias("type"), z["parent"], z["x"], z["y"], z["width"], z["height"], z["text_start"].alias("start"), z["text_length"].alias("length"), z["subtree_end"].alias("subtreeEnd"))
    body = F.struct("text", F.when(F.col("has_replacements"), _numbers(F.col("bytes"))).alias("bytes"), F.col("has_replacements").alias("hasReplacements"), F.transform("zones", zone).alias("zones"))
    return text.where("status = 'ok'").select("doc_id", "page", F.to_json(body, NULLS).alias("json"))


def annotations_json(annotations: DataFrame) -> DataFrame:
    """(doc_id, page, json) with the field names of the wire format."""

    def style(s: Column) -> Column:
        names = {"border": "border", "always_visible": "alwaysVisible", "highlight": "highlight", "opacity": "opacity", "arrow": "arrow", "line_width": "lineWidth", "line_color": "lineColor", "background": "background", "text_color": "textColor", "pushpin": "pushpin"}
        return F.struct(*[s[a].alias(b) for a, b in names.items()])

    area = lambda a: F.struct(*[a[n].alias(n) for n in ("expression", "href", "target", "comment", "shape", "bounds", "points")], style(a["style"]).alias("style"))
    exact = F.encode("source", "UTF-8") == F.col("bytes")
    body = F.struct(
        "source", F.when(~exact, _numbers(F.col("bytes"))).alias("bytes"), F.col("has_replacements").alias("hasReplacements"), F.col("legacy_escapes").alias("legacyEscapes"), "chunks", "expressions",
        "view", F.transform("areas", area).alias("areas"), "metadata", "xmp", "header", "footer",
    )
    return annotations.where("status = 'ok'").select("doc_id", "page", F.to_json(body, NULLS).alias("json"))


def outline_json(outline: DataFrame) -> DataFrame:
    """(doc_id, json): entries in preorder."""
    entry = F.struct("idx", "title", "href", "parent", F.col("subtree_end").alias("subtreeEnd"))
    entries = F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(e["title"], e["href"], e["parent"], e["subtreeEnd"]))
    return outline.where("status = 'ok'").groupBy("doc_id").agg(F.to_json(F.struct(entries.alias("entries")), NULLS).alias("json"))


def metadata_json(metadata: DataFrame, xmp: DataFrame) -> DataFrame:
    """(doc_id, json): metadata entries and XMP packets in order."""
    m = metadata.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "key", "value", "page"))), lambda e: F.struct(e["key"], e["value"], e["page"])).alias("metadata"))
    x = xmp.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value", "page"))), lambda e: F.struct(e["value"], e["page"])).alias("xmp"))
    j = m.join(x, "doc_id", "full")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    body = F.struct(empty("metadata", "array<struct<key:string,value:string,page:int>>").alias("metadata"), empty("xmp", "array<struct<value:string,page:int>>").alias("xmp"))
    return j.select("doc_id", F.to_json(body, NULLS).alias("json"))


def write_ppm(rasters: DataFrame, folder: str) -> None:
    """A picture file for each raster, on a disk that all executors share; alpha is left out. Written under a temporary name, then renamed.

    A name has the document's base name, a digest of its whole doc_id (as others may have the same base name), page and request.
    """

    def write(rows) -> None:
        for r in rows:
            if r.status != "ok":
                continue
            name = "-".join(x for x in (r.doc_id.rsplit("/", 1)[-1], hashlib.sha256(r.doc_id.encode()).hexdigest()[:12], str(r.page), r.request_id) if x)
            path = os.path.join(folder, name + ".ppm")
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(ppm(r.width, r.height, bytes(r.rgba)))
            os.replace(f"{path}.{os.getpid()}", path)

    rasters.select("doc_id", "page", "request_id", "width", "height", "rgba", "status").foreachPartition(write)
