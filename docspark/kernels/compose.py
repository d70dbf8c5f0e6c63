"""Composition of a page's mask and layers into pixels, in exact integers."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from docspark.kernels.geometry import Options, axis_matrix, transform
from docspark.kernels.iff import Info
from docspark.kernels.palette import gamma_table, reduction


class Layer(NamedTuple):
    """RGB samples, top row first. cell: the layer is a reduced grid whose samples cover whole cells of that side; 0 to interpolate."""

    rgb: np.ndarray
    cell: int = 0


class Page(NamedTuple):
    """mask: 1 for ink, or None. palette: (RGB colours, colour index of each pixel)."""

    info: Info
    mask: np.ndarray | None = None
    background: Layer | None = None
    foreground: Layer | None = None
    palette: tuple[np.ndarray, np.ndarray] | None = None


def _axis(size: int, n: int, r: int, flip: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first sample, second sample, weight of the second in 2r) of each page coordinate; flipped axes count from the far end."""
    p = np.arange(size, dtype=np.int64)
    if flip:
        p = size - 1 - p
    at = 2 * p + 1 - r
    first, part = at // (2 * r), at % (2 * r)
    a, b = np.clip(first, 0, n - 1), np.clip(first + 1, 0, n - 1)
    return (n - 1 - a, n - 1 - b, part) if flip else (a, b, part)


def sample_layer(layer: Layer, info: Info, gamma: np.ndarray) -> np.ndarray:
    """A layer's colour at every page pixel: gamma first, then interpolation between sample centres from the bottom left."""
    rgb = gamma[layer.rgb]
    h, w = rgb.shape[:2]
    if layer.cell:
        x = np.clip(np.arange(info.width) // layer.cell, 0, w - 1)
        y = h - 1 - np.clip((info.height - 1 - np.arange(info.height)) // layer.cell, 0, h - 1)
        return rgb[y][:, x]
    r = reduction(info.width, info.height, w, h)
    if r == 1:
        return rgb
    x0, x1, fx = _axis(info.width, w, r, False)
    y0, y1, fy = _axis(info.height, h, r, True)
    d = 2 * r
    fx, fy = fx[None, :, None], fy[:, None, None]
    wide = rgb.astype(np.int64)
    rows = wide[:, x0] * (d - fx) + wide[:, x1] * fx
    return ((rows[y0] * (d - fy) + rows[y1] * fy + d * d // 2) // (d * d)).astype(np.uint8)


def compose(page: Page, options: Options = Options()) -> tuple[np.ndarray, object]:  # noqa: B008
    """(RGBA pixels of the request, its Transform)."""
    info = page.info
    t = transform(info, options)
    gamma = gamma_table(info.gamma_tenths)
    ink = page.mask if page.mask is not None else np.zeros((info.height, info.width), np.uint8)
    ss = t.subsample
    if page.background is None and page.foreground is None and page.palette is None and options.size is None:
        base = _bilevel(ink, gamma, t, ss)
    else:
        under = sample_layer(page.background, info, gamma) if page.background is not None else np.full((info.height, info.width, 3), 255, np.uint8)
        if page.palette is not None:
            over = gamma[page.palette[0]][page.palette[1]]
        elif page.foreground is not None:
            over = sample_layer(page.foreground, info, gamma)
        else:
            over = np.zeros(3, np.uint8)
        full = np.where(ink[:, :, None] > 0, over, under)
        base = _fitted(full, t) if options.size is not None else _reduced(full, under, t, ss)
    out = np.rot90(base, t.rotation)[t.y : t.y + t.height, t.x : t.x + t.width]
    alpha = np.full((*out.shape[:2], 1), 255, np.uint8)
    return np.concatenate([out, alpha], 2), t


def _padded(a: np.ndarray, edge: np.ndarray, t, ss: int) -> np.ndarray:
    """The reduction's whole grid: rows above the page and columns to its right repeat ``edge``, the nearest page pixels."""
    top, right = t.padding_top, t.base_width * ss - a.shape[1]
    if top:
        a = np.concatenate([np.repeat(edge[:1], top, 0), a])
        edge = np.concatenate([np.repeat(edge[:1], top, 0), edge])
    if right:
        a = np.concatenate([a, np.repeat(edge[:, -1:], right, 1)], 1)
    return a


def _reduced(full: np.ndarray, under: np.ndarray, t, ss: int) -> np.ndarray:
    """Mean of ss x ss pixels; outside the page there is background but no ink."""
    if ss == 1:
        return full
    grid = _padded(full, under, t, ss).astype(np.int64)
    total = grid.reshape(t.base_height, ss, t.base_width, ss, -1).sum((1, 3))
    return ((total + ss * ss // 2) // (ss * ss)).astype(np.uint8)


def _bilevel(ink: np.ndarray, gamma: np.ndarray, t, ss: int) -> np.ndarray:
    """Black on white, where reduction rounds the ink and then inverts it."""
    grid = _padded(ink, np.zeros_like(ink), t, ss).astype(np.int64)
    count = grid.reshape(t.base_height, ss, t.base_width, ss).sum((1, 3))
    area = ss * ss
    gray = 255 - (count * 255 + area // 2) // area
    gray = np.where(count == 0, 255, np.where(count == area, 0, gray)).astype(np.uint8)
    return np.repeat(gray[:, :, None], 3, 2)


def _fitted(full: np.ndarray, t) -> np.ndarray:
    """Area average, or bilinear where enlarged. The sums stay far below 2^53, so products in floats are exact."""
    wx, tx = axis_matrix(full.shape[1], t.base_width)
    wy, ty = axis_matrix(full.shape[0], t.base_height)
    out = np.empty((t.base_height, t.base_width, 3), np.uint8)
    total = tx * ty
    for c in range(3):
        sums = (wy.astype(np.float64) @ full[:, :, c].astype(np.float64) @ wx.T.astype(np.float64)).astype(np.int64)
        out[:, :, c] = (sums + total // 2) // total
    return out


def preview_reduction(info: Info, options: Options, layer_width: int, layer_height: int) -> int:
    """Reduced grid of a wavelet layer that a fitted render uses: 1, 2 or 4, the coarsest that still has enough samples."""
    if options.size is None:
        return 1
    t = transform(info, options)
    natural, r = reduction(info.width, info.height, layer_width, layer_height), 1
    while r < 4 and t.base_width * natural * r * 2 <= info.width and t.base_height * natural * r * 2 <= info.height:
        r *= 2
    return r
