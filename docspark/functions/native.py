"""Expressions that need no Python: bytes, page information, text repair, geometry, weights, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uint(data: Column, at: int, n: int = 1) -> Column:
    """Big-endian number of n bytes of a binary column from a 0-based place; null beyond its end."""
    part = F.substring(data, at + 1, n)
    return F.when(F.length(data) >= at + n, F.conv(F.hex(part), 16, 10).cast("long"))


def uint_le(data: Column, at: int) -> Column:
    return uint(data, at) + uint(data, at + 1) * 256


def info(data: Column) -> Column:
    """struct<width,height,dpi,rotation,gamma_tenths,version> of an INFO payload; null where it is damaged."""
    width, height = uint(data, 0, 2), uint(data, 2, 2)
    dpi = F.when(F.length(data) >= 8, uint_le(data, 6)).otherwise(300)
    flag = uint(data, 9).bitwiseAND(7)
    high = F.when((F.length(data) >= 6) & (uint(data, 5) != 255), uint(data, 5)).otherwise(0)
    out = F.struct(
        width.cast("int").alias("width"), height.cast("int").alias("height"), F.when(dpi.between(25, 6000), dpi).otherwise(300).cast("int").alias("dpi"),
        F.when(flag == 6, 1).when(flag == 2, 2).when(flag == 5, 3).otherwise(0).alias("rotation"),
        F.when(F.length(data) >= 9, F.greatest(F.lit(3), F.least(F.lit(50), uint(data, 8)))).otherwise(22).cast("int").alias("gamma_tenths"),
        (high * 256 + uint(data, 4)).cast("int").alias("version"),
    )
    return F.when((F.length(data) >= 5) & (width > 0) & (height > 0), out)


def wavelet_info(data: Column, dpi: int) -> Column:
    """The same of the first chunk of a stand-alone wavelet image or thumbnail."""
    major, minor, width, height = uint(data, 2), uint(data, 3), uint(data, 4, 2), uint(data, 6, 2)
    fine = (uint(data, 0) == 0) & (major.bitwiseAND(127) == 1) & (minor <= 2) & (width > 0) & (height > 0)
    out = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), F.lit(dpi).alias("dpi"), F.lit(0).alias("rotation"), F.lit(22).alias("gamma_tenths"), F.lit(0).alias("version"))
    return F.when(fine, out)


def repaired(data: Column) -> Column:
    """Text of bytes with each damaged sequence as U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def span_text(data: Column, start: Column, length: Column) -> Column:
    """Text of a byte span, repaired on its own."""
    return repaired(F.substring(data, start.cast("int") + 1, length.cast("int")))


def trimmed_id(data: Column) -> Column:
    """Component id of an INCL payload without trailing NUL, CR and LF."""
    return F.rtrim(data.cast("string"), F.lit("\0\r\n"))


def fit(width: Column, height: Column, box_width: Column, box_height: Column) -> Column:
    """struct<width,height>: largest size of the shape inside a box, at least 1, by exact products."""
    long = lambda c: c.cast("long")
    wide = long(box_width) * long(height) <= long(box_height) * long(width)
    one = F.lit(1).cast("long")
    w = F.when(wide, long(box_width)).otherwise(F.greatest(one, _div(long(width) * long(box_height), long(height))))
    h = F.when(wide, F.greatest(one, _div(long(height) * long(box_width), long(width)))).otherwise(long(box_height))
    return F.struct(w.alias("width"), h.alias("height"))


def _div(a: Column, b: Column) -> Column:
    """Floor of a quotient of longs that are not negative, exactly."""
    return F.call_function("div", a, b)


def geometry(width: Column, height: Column, stored: Column, subsample: Column, box_width: Column, box_height: Column, turn: Column) -> Column:
    """struct<page_width,page_height,rotation,base_width,base_height,padding_top> of a request; box columns are null without a box."""
    rotation = F.pmod(stored + turn, F.lit(4))
    odd = rotation % 2 == 1
    w, h = F.when(odd, height).otherwise(width), F.when(odd, width).otherwise(height)
    sized = box_width.isNotNull()
    box = fit(w, h, box_width, box_height)
    pw = F.when(sized, box["width"]).otherwise(_div(w.cast("long") + subsample - 1, subsample.cast("long")))
    ph = F.when(sized, box["height"]).otherwise(_div(h.cast("long") + subsample - 1, subsample.cast("long")))
    base_h = F.when(odd, pw).otherwise(ph)
    return F.struct(
        pw.alias("page_width"), ph.alias("page_height"), rotation.cast("int").alias("rotation"), F.when(odd, ph).otherwise(pw).alias("base_width"),
        base_h.alias("base_height"), F.when(sized, F.lit(0).cast("long")).otherwise(base_h * subsample - height).alias("padding_top"),
    )


def transform(g: Column, width: Column, height: Column, subsample: Column, sized: Column, x: Column, y: Column) -> Column:
    """struct<matrix,inverse>: affine maps [a, b, c, d, e, f] between source pixels and an output whose corner is (x, y)."""
    real = lambda c: c.cast("double")
    bw, bh, zero = real(g["base_width"]), real(g["base_height"]), F.lit(0.0)
    sx = F.when(sized, bw / width).otherwise(F.lit(1.0) / subsample)
    sy = F.when(sized, bh / height).otherwise(sx)
    p = real(g["padding_top"]) * sy
    row = lambda *parts: F.array(*parts)
    turn = g["rotation"]
    base = (
        F.when(turn == 0, row(sx, zero, zero, sy, zero, p)).when(turn == 1, row(zero, -sx, sy, zero, p, bw))
        .when(turn == 2, row(-sx, zero, zero, -sy, bw, bh - p)).otherwise(row(zero, sx, -sy, zero, bh - p, zero))
    )

    def both(m):
        a, b, c, d, e, f = m[0], m[1], m[2], m[3], m[4] - x, m[5] - y
        det = a * d - b * c
        return F.struct(F.array(a, b, c, d, e, f).alias("matrix"), F.array(d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det).alias("inverse"))

    return F.transform(F.array(base), both)[0]


def request_is_valid(g: Column, subsample: Column, box_width: Column, box_height: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a request's reduction, box and output rectangle are in range; region columns are null for the whole page."""
    box = box_width.isNull() | ((subsample == 1) & (box_width > 0) & (box_height > 0))
    region = x.isNull() | ((x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= g["page_width"]) & (y + height <= g["page_height"]))
    return F.coalesce(subsample.between(1, 256) & box & region, F.lit(False))


def map_rect(m: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct<x,y,width,height>: box of a rectangle under an affine map given as array [a, b, c, d, e, f]."""
    xs = [m[0] * p + m[2] * q + m[4] for p in (x, x + w) for q in (y, y + h)]
    ys = [m[1] * p + m[3] * q + m[5] for p in (x, x + w) for q in (y, y + h)]
    x0, y0 = F.least(*xs), F.least(*ys)
    return F.struct(x0.alias("x"), y0.alias("y"), (F.greatest(*xs) - x0).alias("width"), (F.greatest(*ys) - y0).alias("height"))


def axis_weights(pixel: Column, source: Column, output: Column) -> Column:
    """array<struct<at,weight>>: samples of an output pixel along one axis; exact areas when shrinking, of 65536 when enlarging."""
    p, s, o = (c.cast("long") for c in (pixel, source, output))
    left, right = p * s, (p + 1) * s
    first, end = _div(left, o), _div(right + o - 1, o)
    shrink = F.transform(F.sequence(first, end - 1), lambda k: F.struct(k.alias("at"), (F.least(right, (k + 1) * o) - F.greatest(left, k * o)).alias("weight")))
    centre, whole = (2 * p + 1) * s - o, 2 * o
    part = F.pmod(centre, whole)
    low = _div(centre - part, whole)
    last = _div(part * 65536, whole)
    clamp = lambda k: F.greatest(F.lit(0).cast("long"), F.least(s - 1, k))
    grow = F.array(F.struct(clamp(low).alias("at"), (65536 - last).alias("weight")), F.struct(clamp(low + 1).alias("at"), last.alias("weight")))
    return F.when(o <= s, shrink).otherwise(grow)


def gamma(sample: Column, tenths: Column) -> Column:
    """A sample as a display of gamma 2.2 shows it."""
    return F.when(tenths == 22, sample.cast("long")).otherwise(F.floor(F.lit(255.0) * F.pow(sample / F.lit(255.0), tenths / F.lit(22.0)) + 0.5).cast("long"))


def layer_reduction(width: Column, height: Column, layer_width: Column, layer_height: Column) -> Column:
    """The smallest factor from 1 to 12 that leads from page to layer; null if there is none."""
    fits = lambda r: (F.ceil(width / r) == layer_width) & (F.ceil(height / r) == layer_height)
    return F.array_min(F.filter(F.sequence(F.lit(1), F.lit(12)), fits))


def subsample_for(width: Column, height: Column, zoom: Column, view_width: Column, view_height: Column, device_ratio: Column, tile: int = 512, most: int = 24) -> Column:
    """Whole reduction for a zoom: enough pixels for the display, and at most ``most`` tiles in view."""
    first = F.greatest(F.lit(1), F.least(F.lit(256), F.floor(1 / (zoom * F.least(F.lit(2.0), device_ratio))))).cast("int")
    count = lambda size, view, s: F.least(F.ceil(F.ceil(size / s) / tile), F.ceil(view / (zoom * s * tile)) + 1)
    fits = lambda s: count(width, view_width, s) * count(height, view_height, s) <= most
    # Counts fall as the reduction grows, so the first that fits is found by halving the range, at most 256 long, eight times.
    half = lambda r: _div(r["low"] + r["high"], F.lit(2)).cast("int")
    step = lambda r, _: F.transform(F.array(half(r)), lambda s: F.when(fits(s), F.struct(r["low"].alias("low"), s.alias("high"))).otherwise(F.struct(F.least(s + 1, r["high"]).alias("low"), r["high"].alias("high"))))[0]
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.struct(first.alias("low"), F.lit(256).alias("high")), step, lambda r: r["high"])


def last_valid(value: Column, order: Column) -> Column:
    """Aggregate: of the values that are not null the one that comes last."""
    return F.max_by(value, F.when(value.isNotNull(), order))
