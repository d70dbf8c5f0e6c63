"""Foreground palettes, layer reductions and gamma."""

from __future__ import annotations

import numpy as np

from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Limits, Reader, exceeded, invalid, unsupported

#: Largest whole reduction of a colour layer, and display gamma in tenths. Fixed values of the format.
MAX_REDUCTION, DISPLAY_GAMMA = 12, 22


def parse_palette(data: bytes, blits: int | None, limits: Limits = LIMITS) -> tuple[np.ndarray, np.ndarray]:
    """(RGB colours, colour index of each blit; none if the chunk assigns none). blits is None where no symbol mask exists."""
    r = Reader(data)
    head = r.uint(1)
    if head & 0x7F:
        raise unsupported("palette version")
    n = r.uint(2)
    if not n:
        raise invalid("empty palette")
    colors = np.frombuffer(r.take(3 * n), np.uint8).reshape(n, 3)[:, ::-1]
    none = np.zeros(0, np.uint16)
    if not head & 0x80:
        if r.left:
            raise invalid("palette goes on")
        return colors, none
    count = r.uint(3)
    if count > limits.blits:
        raise exceeded("palette indices")
    if blits is not None and count != blits:
        raise invalid("palette indices")
    if not count and not r.left:
        return colors, none
    raw = bzz_decode(data[r.at :], min(limits.bzz_bytes, 2 * count), limits)
    if len(raw) != 2 * count:
        raise invalid("palette indices")
    index = np.frombuffer(raw, ">u2").astype(np.uint16)
    if count and index.max() >= n:
        raise invalid("palette index")
    return colors, index


def reduction(width: int, height: int, layer_width: int, layer_height: int) -> int:
    """The smallest whole factor that leads from the page to the layer in both directions."""
    for r in range(1, MAX_REDUCTION + 1):
        if -(-width // r) == layer_width and -(-height // r) == layer_height:
            return r
    raise invalid("layer size")


def gamma_table(tenths: int) -> np.ndarray:
    """Samples as the display shows them."""
    if tenths == DISPLAY_GAMMA:
        return np.arange(256, dtype=np.uint8)
    return np.floor(255.0 * (np.arange(256) / 255.0) ** (tenths / DISPLAY_GAMMA) + 0.5).astype(np.uint8)
