"""Small rasters as relations: a row a pixel. Page-sized rasters are composed by the renderer; these answer questions about few pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blit_pixels(blits: DataFrame, symbol_pixels: DataFrame, page_width: int, page_height: int, keys: list[str]) -> DataFrame:
    """keys, ord, x, y of every inked pixel of blits (keys, ord, symbol, left, bottom) that lies on the page; y counts from the top.

    Blits are dealt by their keys before they become pixels, many times as many rows, so what is asked of one raster shuffles no pixels.
    """
    j = blits.repartition(*keys).join(symbol_pixels, "symbol").select(*keys, "ord", (F.col("left") + F.col("px")).alias("x"), (F.lit(page_height - 1) - F.col("bottom") - F.col("py")).alias("y"))
    return j.where(F.col("x").between(0, page_width - 1) & F.col("y").between(0, page_height - 1))


def union_ink(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ink: pixels with ink; overlaps count once."""
    return pixels.groupBy(*keys, "x", "y").agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count("*").alias("ink"))


def last_color(pixels: DataFrame, keys: list[str], color: str) -> DataFrame:
    """keys, x, y, color: of overlapping blits the later one's colour stays."""
    return pixels.groupBy(*keys, "x", "y").agg(F.max_by(color, "ord").alias(color))


def box_reduced(samples: DataFrame, keys: list[str], width: int, height: int, by: int, bilevel: bool) -> DataFrame:
    """keys, x, y, value: means of by x by samples (x, y, value, y from the top); the grid is padded at the top and right.

    Bilevel pages (value 1 for ink) round the ink and invert it; colour samples repeat the page's edge in the padding.
    """
    top = -(-height // by) * by - height
    area = by * by
    if bilevel:
        cells = samples.withColumn("x", F.floor(F.col("x") / by)).withColumn("y", F.floor((F.col("y") + top) / by))
        out = cells.groupBy(*keys, "x", "y").agg(F.sum("value").cast("long").alias("n"))
        gray = F.lit(255) - F.expr(f"(n * 255 + {area // 2}) div {area}")
        return out.select(*keys, "x", "y", F.when(F.col("n") == 0, 255).when(F.col("n") == area, 0).otherwise(gray).cast("long").alias("value"))
    right = -(-width // by) * by - width
    copies = F.lit(1) + F.when(F.col("x") == width - 1, right).otherwise(0)
    rows = F.lit(1) + F.when(F.col("y") == 0, top).otherwise(0)
    weighted = samples.withColumn("w", copies * rows)
    cells = weighted.withColumn("x", F.floor(F.col("x") / by)).withColumn("y", F.floor((F.col("y") + top) / by))
    return cells.groupBy(*keys, "x", "y").agg(F.sum(F.col("value") * F.col("w")).cast("long").alias("n")).select(*keys, "x", "y", F.expr(f"(n + {area // 2}) div {area}").alias("value"))
