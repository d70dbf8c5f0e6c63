"""Links between pages: id, relative number, title, absolute number, unique name, in this order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.kernels.core import LIMITS, Limits

NUMBER = r"\A[0-9]+\z"


def resolve_links(links: DataFrame, pages: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """links (doc_id, href, from_page) with link struct<kind,page>.

    pages: (doc_id, page, id, name, title). kind is none, page, url, options or unresolved; InvalidArgument for a from_page that isn't there or
    an href that isn't valid UTF-8 (also a binary column), LimitExceeded for one that is longer than an input may be.
    """
    raw = F.col("href").cast("binary")
    long, valid = F.length(raw) > limits.input_bytes, F.coalesce(F.is_valid_utf8(F.col("href").cast("string")), F.lit(True))
    given = F.when(~long & valid, F.col("href").cast("string"))
    rows = links.withColumn("__href", given).withColumn("__long", F.coalesce(long, F.lit(False))).withColumn("__valid", valid)
    rows = rows.withColumn("__target", F.when(F.col("__href").startswith("#"), F.expr("substr(__href, 2)")))
    counts = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("__n"))
    ids = pages.select("doc_id", F.col("id").alias("__target"), F.col("page").alias("__by_id"))
    names = pages.groupBy("doc_id", F.col("name").alias("__target")).agg(F.when(F.count("*") == 1, F.first("page")).alias("__by_name"))
    rows = rows.join(counts, "doc_id", "left").join(ids, ["doc_id", "__target"], "left").join(names, ["doc_id", "__target"], "left")
    # The nearest title at or after the origin, going round.
    titles = pages.select("doc_id", F.col("title").alias("__target"), F.col("page").alias("__titled"))
    origin = F.coalesce(F.col("from_page"), F.lit(0))
    # Links to one target from one page have one answer.
    asked = rows.where("__target IS NOT NULL").select("doc_id", "__target", origin.alias("__origin"), "__n").distinct()
    near = asked.join(titles, ["doc_id", "__target"]).groupBy("doc_id", "__target", "__origin")
    near = near.agg(F.min_by("__titled", F.pmod(F.col("__titled") - F.col("__origin"), F.col("__n"))).alias("__by_title"))
    rows = rows.withColumn("__origin", origin).join(near, ["doc_id", "__target", "__origin"], "left")
    target, n = F.col("__target"), F.col("__n")
    sign, digits = F.substring(target, 1, 1), F.expr("substr(__target, 2)")
    relative = sign.isin("+", "-") & digits.rlike(NUMBER)
    distance = digits.try_cast("long")
    moved = F.when(sign == "-", F.col("from_page") - distance).otherwise(F.col("from_page") + distance)
    by_relative = F.when(distance.isNotNull() & (distance <= 2**31) & moved.between(0, n - 1), moved.cast("int"))
    number = F.when(target.rlike(NUMBER), target.try_cast("long"))
    by_number = F.when(number.between(1, n), (number - 1).cast("int"))
    page = F.coalesce("__by_id", F.when(relative, by_relative).otherwise(F.coalesce("__by_title", by_number, "__by_name")))
    href = F.col("__href")
    kind = (
        F.when(F.col("from_page").isNotNull() & ~F.col("from_page").between(0, F.coalesce(n, F.lit(0)) - 1), "InvalidArgument")
        .when(F.col("__long"), "LimitExceeded").when(~F.col("__valid"), "InvalidArgument")
        .when(href.isNull() | (href == ""), "none").when(href.startswith("?"), "options").when(~href.startswith("#"), "url")
        .when(target == "", "unresolved").when(page.isNotNull(), "page").otherwise("unresolved")
    )
    link = F.struct(kind.alias("kind"), F.when(kind == "page", page).alias("page"))
    return rows.withColumn("link", link).select(*links.columns, "link")


def thumbnail_order(components: DataFrame) -> DataFrame:
    """For each page (doc_id, comp) the nearest thumbnail component before it, and how many pages stand between: an as-of join by window."""
    before = Window.partitionBy("doc_id").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    is_thumb = F.col("kind") == "thumbnail"
    seen = components.withColumn("thumb", F.last(F.when(is_thumb, F.col("comp")), ignorenulls=True).over(before))
    run = Window.partitionBy("doc_id", "thumb").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    ordinal = F.count(F.when(F.col("kind") == "page", 1)).over(run)
    return seen.withColumn("ordinal", ordinal).where("kind = 'page'").select("doc_id", "comp", "thumb", "ordinal")
