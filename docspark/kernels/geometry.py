"""Output geometry of pages in exact integers, and the affine maps between source and output."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from docspark.kernels.core import argument
from docspark.kernels.iff import Info


class Options(NamedTuple):
    """A render request: whole reduction or a box to fit, extra counter-clockwise quarter turns, an output rectangle."""

    subsample: int = 1
    size: tuple[int, int] | None = None
    rotation: int = 0
    region: tuple[int, int, int, int] | None = None


class Transform(NamedTuple):
    """matrix (a, b, c, d, e, f) maps (x, y) to (a x + c y + e, b x + d y + f); base is the output before rotation."""

    x: int
    y: int
    width: int
    height: int
    page_width: int
    page_height: int
    rotation: int
    matrix: tuple[float, ...]
    inverse: tuple[float, ...]
    subsample: int
    base_width: int
    base_height: int
    padding_top: int

    def map(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.matrix
        return a * x + c * y + e, b * x + d * y + f

    def unmap(self, x: float, y: float) -> tuple[float, float]:
        a, b, c, d, e, f = self.inverse
        return a * x + c * y + e, b * x + d * y + f


def fitted(width: int, height: int, box: tuple[int, int]) -> tuple[int, int]:
    """Largest size of the same shape inside the box, by exact products; at least 1."""
    bw, bh = box
    if bw * height <= bh * width:
        return bw, max(1, height * bw // width)
    return max(1, width * bh // height), bh


def transform(info: Info, options: Options = Options()) -> Transform:  # noqa: B008
    ss = options.subsample
    if not 1 <= ss <= 256:
        raise argument("subsample")
    turn = (info.rotation + options.rotation) & 3
    w, h = (info.height, info.width) if turn & 1 else (info.width, info.height)
    if options.size is not None:
        if ss != 1 or min(options.size) < 1:
            raise argument("size")
        pw, ph = fitted(w, h, options.size)
    else:
        pw, ph = -(-w // ss), -(-h // ss)
    x, y, rw, rh = options.region or (0, 0, pw, ph)
    if min(x, y) < 0 or min(rw, rh) < 1 or x + rw > pw or y + rh > ph:
        raise argument("region")
    bw, bh = (ph, pw) if turn & 1 else (pw, ph)
    if options.size is not None:
        padding, sx, sy = 0, bw / info.width, bh / info.height
    else:
        padding, sx = bh * ss - info.height, 1.0 / ss
        sy = sx
    p = padding * sy
    m = [
        (sx, 0.0, 0.0, sy, 0.0, p), (0.0, -sx, sy, 0.0, p, float(bw)),
        (-sx, 0.0, 0.0, -sy, float(bw), bh - p), (0.0, sx, -sy, 0.0, bh - p, 0.0),
    ][turn]
    a, b, c, d, e, f = m[0], m[1], m[2], m[3], m[4] - x, m[5] - y
    det = a * d - b * c
    back = d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det
    return Transform(x, y, rw, rh, pw, ph, turn, (a, b, c, d, e, f), back, ss, bw, bh, padding)


def axis_window(pixel: int, source: int, output: int) -> tuple[int, list[int], int]:
    """(first sample, weights, their total) of an output pixel along one axis: exact areas when shrinking, 1/65536 when enlarging."""
    if output <= source:
        left, right = pixel * source, (pixel + 1) * source
        first, end = left // output, -(-right // output)
        return first, [min(right, (k + 1) * output) - max(left, k * output) for k in range(first, end)], source
    centre, whole = (2 * pixel + 1) * source - output, 2 * output
    last = centre % whole * 65536 // whole
    return centre // whole, [65536 - last, last], 65536


def axis_matrix(source: int, output: int) -> tuple[np.ndarray, int]:
    """(weights as an output x source matrix of integers, total), samples clamped at the edges."""
    out = np.zeros((output, source), np.int64)
    total = 0
    for k in range(output):
        first, weights, total = axis_window(k, source, output)
        np.add.at(out[k], np.clip(np.arange(first, first + len(weights)), 0, source - 1), weights)
    return out, total
