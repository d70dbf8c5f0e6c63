"""IW44 wavelet images: progressive decoder with reduced grids, and an encoder.

A plane is cut into blocks of 32 x 32 coefficients, 64 buckets of 16, in ten bands from coarse to fine. Each slice codes one band of
every plane with a step that halves from pass to pass. Entropy decoding is bit-serial Python; everything after it is NumPy.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from docspark.kernels.core import LIMITS, Limits, Reader, argument, exceeded, invalid, unsupported
from docspark.kernels.zp import Decoder, Encoder

# Fixed values of the format: first steps of the coefficient groups, and first bucket and number of buckets of each band.
STEPS = (0x4000, 0x8000, 0x8000, 0x10000, 0x10000, 0x10000, 0x20000, 0x20000, 0x20000, 0x40000, 0x40000, 0x40000, 0x80000, 0x40000, 0x40000, 0x80000)
BANDS = ((0, 1), (1, 1), (2, 1), (3, 1), (4, 4), (8, 4), (12, 4), (16, 16), (32, 16), (48, 16))
REDUCTIONS = (1, 2, 4, 8, 16, 32)


def _places() -> tuple[np.ndarray, np.ndarray]:
    """(row, column) in a block of each coefficient: the bits of its number, lowest first, go to column and row in turn."""
    n = np.arange(1024)
    x = sum((n >> 2 * k & 1) << 4 - k for k in range(5))
    y = sum((n >> 2 * k + 1 & 1) << 4 - k for k in range(5))
    return y, x


ROWS, COLUMNS = _places()


class Header(NamedTuple):
    width: int
    height: int
    color: bool
    half_chroma: bool
    delay: int
    size: int


def parse_header(data: bytes) -> Header:
    """Header of the first chunk of an image."""
    r = Reader(data)
    if r.uint(1):
        raise invalid("first serial")
    r.take(1)
    major, minor = r.uint(1), r.uint(1)
    if major & 0x7F != 1 or minor > 2:
        raise unsupported("wavelet version")
    width, height = r.uint(2), r.uint(2)
    if not width or not height:
        raise invalid("wavelet size")
    chroma = r.uint(1) if minor >= 2 else 0x80
    return Header(width, height, not major & 0x80, not chroma & 0x80, chroma & 0x7F, r.at)


class _Plane:
    """Coefficients of one plane: for each block a bucket number to 16 values, present only where some value was coded."""

    def __init__(self, blocks: int):
        self.blocks: list[dict[int, list[int]]] = [{} for _ in range(blocks)]
        self.steps, self.band = list(STEPS), 0
        self.root, self.bucket, self.start, self.mantissa = [0], [[0] * 8 for _ in BANDS], [0] * 16, [0]

    def step_list(self) -> list[int]:
        """Steps of the 16 coefficients of a bucket of the band."""
        if self.band:
            return [self.steps[self.band + 6]] * 16
        return [self.steps[k if k < 4 else k // 4 + 3] for k in range(16)]

    def empty(self, steps: list[int]) -> bool:
        return not any(0 < s < 0x8000 for s in steps)

    def finish(self) -> None:
        for k in range(7) if not self.band else (self.band + 6,):
            self.steps[k] >>= 1
        self.band = (self.band + 1) % 10

    def block(self, number: int, steps: list[int], usable: list[int], coder) -> None:
        """Code one block's band; ``usable`` are the coefficients of a bucket whose step is in range. coder.bit(states, k, want) and coder.even(want) read a bit, or write the wanted one, and return it."""
        first, count = BANDS[self.band]
        values = self.blocks[number]
        active, waiting = [], []
        for b in range(first, first + count):
            v = values.get(b)
            if v is None:
                active.append(())
                waiting.append(usable)
            else:
                active.append([k for k in usable if v[k]])
                waiting.append([k for k in usable if not v[k]])
        any_active, any_waiting = any(active), any(waiting)
        new: list[tuple[int, bool]] = []
        target = coder.target(number)
        grows = [any(abs(t[k]) >= steps[k] for k in w) if (t := target(first + b)) else False for b, w in enumerate(waiting)] if coder.writes else [False] * count
        if count < 16 or any_active or any_waiting and coder.bit(self.root, 0, any(grows)):
            for b, w in enumerate(waiting):
                if not w:
                    continue
                context = 0
                if self.band:
                    parent = (first + b) * 4
                    above = values.get(parent // 16)
                    if above:
                        context = min(3, sum(1 for v in above[parent % 16 : parent % 16 + 4] if v))
                if coder.bit(self.bucket[self.band], context | 4 * any_active, grows[b]):
                    new.append((b, bool(active[b])))
            for b, had in new:
                t = target(first + b)
                left = len(waiting[b])
                for k in waiting[b]:
                    if coder.bit(self.start, min(left, 7) | 8 * had, bool(t) and abs(t[k]) >= steps[k]):
                        half = steps[k] >> 1
                        v = steps[k] + half - (half >> 2)
                        if v > 0x7FFF:
                            raise invalid("coefficient")
                        values.setdefault(first + b, [0] * 16)[k] = -v if coder.even(bool(t) and t[k] < 0) else v
                        left = 0
                    elif left:
                        left -= 1
        for b, ks in enumerate(active):
            if not ks:
                continue
            v, t = values[first + b], target(first + b)
            for k in ks:
                size, s = abs(v[k]), steps[k]
                if size <= 3 * s:
                    size += s >> 2
                    up = coder.bit(self.mantissa, 0, bool(t) and abs(t[k]) >= size)
                else:
                    up = coder.even(bool(t) and abs(t[k]) >= size)
                size += (s >> 1) - (0 if up else s)
                if not -0x8000 <= size <= 0x7FFF:
                    raise invalid("coefficient")
                v[k] = -size if v[k] < 0 else size

    def dense(self, reduction: int, across: int, down: int) -> np.ndarray | None:
        """int16 grid, bottom row first, of the coefficients that belong to a reduced grid; None if all are zero."""
        if not any(self.blocks):
            return None
        side = 32 // reduction
        used = side * side
        flat = np.zeros((len(self.blocks), 1024), np.int16)
        for n, block in enumerate(self.blocks):
            for b, v in block.items():
                flat[n, 16 * b : 16 * b + 16] = v
        out = np.zeros((len(self.blocks), side, side), np.int16)
        out[:, ROWS[:used] // reduction, COLUMNS[:used] // reduction] = flat[:, :used]
        return out.reshape(down, across, side, side).transpose(0, 2, 1, 3).reshape(down * side, across * side)


class _Read:
    writes = False

    def __init__(self, zp: Decoder | None):
        self.zp = zp

    def bit(self, states, k, want):
        return self.zp.bit(states, k)

    def even(self, want):
        return self.zp.wavelet()

    def target(self, number):
        return lambda b: None


class _Write:
    writes = True

    def __init__(self, zp: Encoder, blocks: list[dict[int, list[int]]]):
        self.zp, self.blocks = zp, blocks

    def bit(self, states, k, want):
        self.zp.bit(states, k, int(want))
        return want

    def even(self, want):
        self.zp.wavelet(int(want))
        return want

    def target(self, number):
        return self.blocks[number].get


class Coefficients(NamedTuple):
    """Decoded planes, from which any grid can be reconstructed."""

    header: Header
    planes: list


def decode_coefficients(chunks: list[bytes], limits: Limits = LIMITS) -> Coefficients:
    """Entropy-decode the progressive chunks of an image."""
    if not chunks:
        raise argument("no chunks")
    if len(chunks) > limits.iw_chunks:
        raise exceeded("wavelet chunks")
    header = parse_header(chunks[0])
    across, down = -(-header.width // 32), -(-header.height // 32)
    if across * down * 1024 > limits.page_pixels:
        raise exceeded("wavelet pixels")
    planes = [_Plane(across * down) for _ in range(3 if header.color else 1)]
    slices = 0
    for serial, chunk in enumerate(chunks):
        r = Reader(chunk)
        if r.uint(1) != serial:
            raise invalid("serial")
        n = r.uint(1)
        if n > limits.iw_slices - slices:
            raise exceeded("slices")
        coder = _Read(Decoder(chunk[header.size if serial == 0 else r.at :]) if n else None)
        for _ in range(n):
            _slice(planes if slices >= header.delay else planes[:1], [coder] * 3)
            slices += 1
    return Coefficients(header, planes)


def _slice(planes: list[_Plane], coders) -> None:
    for plane, coder in zip(planes, coders, strict=False):
        steps = plane.step_list()
        if not plane.empty(steps):
            usable = [k for k in range(16) if 0 < steps[k] < 0x8000]
            for n in range(len(plane.blocks)):
                plane.block(n, steps, usable, coder)
        plane.finish()


def _row(a: np.ndarray, k: int) -> np.ndarray:
    return a[k].astype(np.int32) if 0 <= k < len(a) else np.zeros(a.shape[1], np.int32)


def _wrap(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int16)


def _even(a: np.ndarray, sign: int) -> None:
    """Lifting of even rows from the odd ones around them; rows outside count as zero."""
    n = len(a)
    odd = np.zeros((n // 2 + 4, a.shape[1]), np.int32)
    odd[2 : 2 + n // 2] = a[1::2]
    m = -(-n // 2)
    update = 9 * (odd[1 : 1 + m] + odd[2 : 2 + m]) - odd[:m] - odd[3 : 3 + m] + 16 >> 5
    a[::2] = _wrap(a[::2] - sign * update)


def _even_across(a: np.ndarray, sign: int) -> None:
    """As _even, but with the look-ahead rule of rows: what lies beyond the edge keeps its last value in the first three pairs."""
    n = len(a)
    near = [_row(a, k) for k in (-3, -1, 1, 3)]
    changed = []
    for p in range(0, n, 2):
        if p:
            ahead = _row(a, p + 3) if p + 3 < n else near[3] if p < 6 else _row(a, n)
            near = [*near[1:], ahead]
        changed.append(_wrap(a[p] - sign * (9 * (near[1] + near[2]) - near[0] - near[3] + 16 >> 5)))
    for k, row in enumerate(changed):
        a[2 * k] = row


def _odd(a: np.ndarray, sign: int) -> None:
    """Lifting of odd rows from the even ones: four taps inside, the mean of two near an edge, a copy at it."""
    n = len(a)
    for p in range(1, min(n, 3), 2):
        a[p] = _wrap(a[p] + sign * _edge(a, p))
    m = len(range(3, n - 3, 2))
    if m:
        e = a[::2].astype(np.int32)
        update = 9 * (e[1 : 1 + m] + e[2 : 2 + m]) - e[:m] - e[3 : 3 + m] + 8 >> 4
        a[3 : 3 + 2 * m : 2] = _wrap(a[3 : 3 + 2 * m : 2] + sign * update)
    for p in range(max(3, 3 + 2 * m), n, 2):
        a[p] = _wrap(a[p] + sign * _edge(a, p))


def _edge(a: np.ndarray, p: int) -> np.ndarray:
    return _row(a, p - 1) + _row(a, p + 1) + 1 >> 1 if p + 1 < len(a) else _row(a, p - 1)


def _synthesize(grid: np.ndarray, first: int, last: int) -> None:
    """Undo the lifting from scale ``first`` down to ``last``, in place."""
    scale = first
    while scale >= last:
        part = grid[::scale, ::scale]
        _even(part, 1)
        _odd(part, 1)
        _even_across(part.T, 1)
        _odd(part.T, 1)
        scale >>= 1


def _analyze(grid: np.ndarray, first: int, last: int) -> None:
    scale = last
    while scale <= first:
        part = grid[::scale, ::scale]
        _odd(part.T, -1)
        _even_across(part.T, -1)
        _odd(part, -1)
        _even(part, -1)
        scale <<= 1


def reconstruct(c: Coefficients, reduction: int = 1) -> np.ndarray:
    """RGB, top row first, on the grid of every ``reduction``-th sample from the bottom left."""
    if reduction not in REDUCTIONS:
        raise argument("reduction")
    h = c.header
    across, down = -(-h.width // 32), -(-h.height // 32)
    width, height = -(-h.width // reduction), -(-h.height // reduction)
    samples = []
    for k, plane in enumerate(c.planes):
        grid = plane.dense(reduction, across, down)
        if grid is None:
            samples.append(np.zeros((height, width), np.int32))
            continue
        grid = np.ascontiguousarray(grid[:height, :width])
        half = k > 0 and h.half_chroma and reduction == 1
        if 16 // reduction:
            _synthesize(grid, 16 // reduction, 2 if half else 1)
        if half:
            grid = grid[np.arange(height) & ~1][:, np.arange(width) & ~1]
        samples.append(np.clip(grid.astype(np.int32) + 32 >> 6, -128, 127)[::-1])
    if not h.color:
        return np.repeat(np.clip(127 - samples[0], 0, 255).astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = samples
    red = cr + (cr >> 1)
    base = y + 128 - (cb >> 2)
    return np.clip(np.stack([y + 128 + red, base - (red >> 1), base + 2 * cb], 2), 0, 255).astype(np.uint8)


def decode_iw44(chunks: list[bytes], reduction: int = 1, limits: Limits = LIMITS) -> np.ndarray:
    return reconstruct(decode_coefficients(chunks, limits), reduction)


def encode_iw44(pixels: np.ndarray, slices: tuple[int, ...] = (100,), half_chroma: bool = False, delay: int = 0) -> list[bytes]:
    """Progressive chunks, one for each number of slices, of gray (2-D) or RGB (3-D) pixels, top row first."""
    color = pixels.ndim == 3
    height, width = pixels.shape[:2]
    p = pixels.astype(np.int32)
    if color:
        r, g, b = p[..., 0], p[..., 1], p[..., 2]
        # Inverse of the decoder's r = y + 1.5 cr, b = y + 1.75 cb, g = y - cb / 4 - 0.75 cr.
        y = (7 * r + 14 * g + 2 * b) / 23
        planes = [np.rint(v).astype(np.int32) for v in (y - 128, (b - y) * 4 / 7, (r - y) * 2 / 3)]
    else:
        planes = [127 - p]
    across, down = -(-width // 32), -(-height // 32)
    coded, wanted = [], []
    for k, plane in enumerate(planes):
        grid = np.zeros((32 * down, 32 * across), np.int16)
        part = np.ascontiguousarray((np.clip(plane, -128, 127)[::-1] * 64).astype(np.int16))
        if k and half_chroma:
            part = part[np.arange(height) & ~1][:, np.arange(width) & ~1]
        _analyze(part, 16, 2 if k and half_chroma else 1)
        if k and half_chroma:
            part[1::2] = 0
            part[:, 1::2] = 0
        grid[:height, :width] = part
        blocks = grid.reshape(down, 32, across, 32).transpose(0, 2, 1, 3).reshape(-1, 32, 32)[:, ROWS, COLUMNS]
        wanted.append([{j: v for j, v in enumerate(b.reshape(64, 16).tolist()) if any(v)} for b in blocks])
        coded.append(_Plane(across * down))
    out, done = [], 0
    for serial, n in enumerate(slices):
        zp = Encoder()
        coders = [_Write(zp, w) for w in wanted]
        for _ in range(n):
            _slice(coded if done >= delay else coded[:1], coders)
            done += 1
        head = bytes([serial, n])
        if not serial:
            head += bytes([1 if color else 0x81, 2]) + width.to_bytes(2, "big") + height.to_bytes(2, "big") + bytes([(0 if half_chroma else 0x80) | delay])
        out.append(head + zp.finish())
    return out
