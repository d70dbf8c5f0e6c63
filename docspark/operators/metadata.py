"""Document-wide metadata: annotation streams of all roots, entries attributed to pages, physical entries once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.arrow import flat_map
from docspark.kernels.annot import metadata_fields
from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Bad, Limits

FIELD = "struct<xmp:boolean,key:string,value:string,start:long,end:long>"


def plain_annotations(chunks: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc_id, comp, ord, data, status): annotation chunks uncompressed; an empty compressed chunk stays empty."""

    def call(doc_id, comp, ord_, chunk_id, payload):
        try:
            data = bzz_decode(payload, min(limits.annotation_bytes, limits.bzz_bytes), limits) if chunk_id == "ANTz" and payload else payload
            yield doc_id, comp, ord_, data, "ok"
        except Bad as e:
            yield doc_id, comp, ord_, None, e.code

    few = chunks.where("chunk_id IN ('ANTa', 'ANTz')").select("doc_id", "comp", "ord", "chunk_id", "payload")
    return flat_map(few, "doc_id string, comp int, ord int, data binary, status string", call)


def streams(annotations: DataFrame, expansions: DataFrame) -> DataFrame:
    """(doc_id, root, fragments, data): for each root its annotation chunks in the order of expansion, and their bytes on end.

    A fragment is (at, length, comp, own): its place in the stream, and its place among its component's own annotation bytes.
    """
    before = Window.partitionBy("doc_id", "comp").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = annotations.where("status = 'ok'").withColumn("own", F.coalesce(F.sum(F.length("data")).over(before), F.lit(0)))
    j = expansions.where("status = 'ok'").join(placed.drop("status"), ["doc_id", "comp"])
    j = j.withColumn("place", F.concat("path", F.array("ord")))
    parts = j.groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("place", "comp", "own", "data"))).alias("parts"))
    lengths = F.transform("parts", lambda p: F.length(p["data"]).cast("long"))
    at = lambda k: F.aggregate(F.slice(lengths, 1, k), F.lit(0).cast("long"), lambda a, b: a + b)
    fragments = F.transform("parts", lambda p, k: F.struct(at(k).alias("at"), F.length(p["data"]).cast("long").alias("length"), p["comp"].alias("comp"), p["own"].cast("long").alias("own")))
    whole = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["data"]))
    return parts.select("doc_id", "root", fragments.alias("fragments"), whole.alias("data"))


def roots(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, root): every page, and every other component but thumbnails that nothing includes."""
    named = edges.select("doc_id", F.col("dst").alias("comp")).distinct()
    loose = components.where("kind NOT IN ('page', 'thumbnail') AND loaded").join(named, ["doc_id", "comp"], "left_anti")
    return components.where("kind = 'page'").select("doc_id", F.col("comp").alias("root")).unionByName(loose.select("doc_id", F.col("comp").alias("root")))


def records(streams_: DataFrame, pages: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc_id, root, seq, xmp, key, value, page, status): entries and packets of all streams, each physical one once.

    An entry belongs to the first page-owned fragment it overlaps; pages is (doc_id, comp, page). Streams of one contributor say the same
    wherever they are included, so each is parsed once.
    """
    one = F.array_distinct(F.transform("fragments", lambda f: f["comp"]))
    same = F.when(F.size(one) == 1, one[0])
    order = Window.partitionBy("doc_id", "sole").orderBy("root")
    with_sole = streams_.where(F.size("fragments") > 0).withColumn("sole", same)
    few = with_sole.withColumn("k", F.row_number().over(order)).where("sole IS NULL OR k = 1")

    def call(doc_id, root, fragments, data):
        try:
            yield doc_id, root, fragments, [tuple(f) for f in metadata_fields(data, limits)], "ok"
        except Bad as e:
            yield doc_id, root, fragments, [], e.code

    schema = f"doc_id string, root int, fragments array<struct<at:long,length:long,comp:int,own:long>>, fields array<{FIELD}>, status string"
    parsed = flat_map(few.select("doc_id", "root", "fragments", "data"), schema, call)
    owned = pages.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("comp", "page"))).alias("owners"))
    rows = parsed.join(owned, "doc_id", "left").select("doc_id", "root", "fragments", "owners", "status", F.posexplode_outer("fields").alias("seq", "f"))
    touched = F.filter("fragments", lambda g: (g["at"] < F.col("f.end")) & (g["at"] + g["length"] > F.col("f.start")))
    page = F.get(F.filter(F.transform(touched, lambda g: F.try_element_at(F.col("owners"), g["comp"])), lambda p: p.isNotNull()), F.lit(0))
    first = touched[0]
    rows = rows.select(
        "doc_id", "root", "seq", "status", F.col("f.xmp").alias("xmp"), F.col("f.key").alias("key"), F.col("f.value").alias("value"), page.alias("page"),
        first["comp"].alias("comp"), (first["own"] + F.col("f.start") - first["at"]).alias("start"),
    )
    once = Window.partitionBy("doc_id", "xmp", "key", "value", "comp", "start", "page").orderBy("root", "seq")
    return rows.withColumn("k", F.when(F.col("xmp").isNull(), 1).otherwise(F.row_number().over(once))).where("k = 1").drop("k", "comp", "start")
