"""JPEG layers: baseline, extended and progressive Huffman images of 8 bits with one, three or four components.

Coefficients are read bit-serially; dequantisation, inverse transform, upsampling and colour are NumPy. Results stay within a few levels
of other decoders, as the standard allows.
"""

from __future__ import annotations

import numpy as np

from docspark.kernels.core import LIMITS, Limits, exceeded, invalid, unsupported


def _zigzag() -> list[int]:
    """Row-major place of each coefficient: along anti-diagonals, turning at the edges."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return [8 * r + c for r, c in cells]


ZIGZAG = _zigzag()
_k = np.arange(8)
_COSINE = np.sqrt(np.where(_k == 0, 1 / 8, 2 / 8))[:, None] * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


class _Entropy:
    """Bits of a scan; stops at markers."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.word = self.kept = 0

    def _more(self) -> None:
        if self.at >= len(self.data):
            raise invalid("scan ended")
        b = self.data[self.at]
        if b == 0xFF:
            if self.at + 1 >= len(self.data) or self.data[self.at + 1]:
                raise invalid("marker inside a scan")
            self.at += 1
        self.at += 1
        self.word = (self.word << 8 | b) & 0xFFFFFFFFFF
        self.kept += 8

    def bits(self, n: int) -> int:
        while self.kept < n:
            self._more()
        self.kept -= n
        return self.word >> self.kept & (1 << n) - 1

    def code(self, table: dict[tuple[int, int], int]) -> int:
        word = 0
        for size in range(1, 17):
            word = word << 1 | self.bits(1)
            found = table.get((size, word))
            if found is not None:
                return found
        raise invalid("code")

    def value(self, size: int) -> int:
        """A number of so many bits, negative ones being those below half of the range."""
        if not size:
            return 0
        v = self.bits(size)
        return v if v >> size - 1 else v - (1 << size) + 1

    def align(self) -> None:
        if self.kept > 7:
            raise invalid("scan goes on")
        rest = self.bits(self.kept)
        self.kept = 0
        del rest


class _Component:
    def __init__(self, id_: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table = id_, h, v, table
        self.coded = False
        #: Point of each coefficient's last scan; -1 before the first.
        self.level = [-1] * 64


class _Image:
    def __init__(self, data: bytes, limits: Limits):
        if data[:2] != b"\xff\xd8":
            raise invalid("no image")
        self.data, self.limits = data, limits
        self.quant: dict[int, np.ndarray] = {}
        self.dc: dict[int, dict] = {}
        self.ac: dict[int, dict] = {}
        self.components: list[_Component] = []
        self.restart = self.scans = self.blocks = self.markers = 0
        self.adobe, self.jfif, self.progressive = None, False, False
        at = 2
        while True:
            marker, at = self.marker(at)
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at : at + 2], "big")
            if size < 2 or at + size > len(data):
                raise invalid("segment")
            body = data[at + 2 : at + size]
            at += size
            if marker in (0xC0, 0xC1, 0xC2):
                self.frame(marker, body)
            elif 0xC0 <= marker <= 0xCF and marker != 0xC4 or marker in (0xDE, 0xDF):
                raise unsupported("JPEG process")
            elif marker == 0xDB:
                self.quantization(body)
            elif marker == 0xC4:
                self.huffman(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xE0 and body[:5] == b"JFIF\0":
                self.jfif = True
            elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif marker == 0xDA:
                at = self.scan(body, at)
            elif not (0xE0 <= marker <= 0xEF or marker in (0xFE, 0xDC)):
                raise invalid("marker")
        if not self.components or not all(c.coded for c in self.components):
            raise invalid("no pixels")

    def marker(self, at: int) -> tuple[int, int]:
        """Next marker; junk between segments is passed over."""
        while True:
            at = self.data.find(0xFF, at)
            if at < 0:
                raise invalid("image ended")
            while at < len(self.data) and self.data[at] == 0xFF:
                at += 1
            if at >= len(self.data):
                raise invalid("image ended")
            self.markers += 1
            if self.markers > self.limits.chunks:
                raise exceeded("markers")
            if self.data[at]:
                return self.data[at], at + 1

    def frame(self, marker: int, body: bytes) -> None:
        if self.components:
            raise invalid("second frame")
        if len(body) < 6:
            raise invalid("frame")
        if body[0] != 8 or body[5] not in (1, 3, 4):
            raise unsupported("JPEG frame")
        self.height, self.width, n = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
        if not self.height:
            raise unsupported("JPEG height")
        if not self.width or len(body) != 6 + 3 * n:
            raise invalid("frame")
        if self.width * self.height > self.limits.page_pixels:
            raise exceeded("JPEG pixels")
        self.progressive = marker == 0xC2
        for k in range(n):
            id_, hv, table = body[6 + 3 * k : 9 + 3 * k]
            if any(c.id == id_ for c in self.components) or not (1 <= hv >> 4 <= 4 and 1 <= hv & 15 <= 4) or table > 3:
                raise invalid("component")
            self.components.append(_Component(id_, hv >> 4, hv & 15, table))
        self.hmax, self.vmax = max(c.h for c in self.components), max(c.v for c in self.components)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        for c in self.components:
            if self.hmax % c.h or self.vmax % c.v:
                raise unsupported("sampling")
            c.width, c.height = -(-self.width * c.h // self.hmax), -(-self.height * c.v // self.vmax)
            c.stride = self.across * c.h
            c.data = [None] * (c.stride * self.down * c.v)

    def quantization(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, k = body[at] >> 4, body[at] & 15
            raw = body[at + 1 : at + 1 + 64 * (1 + wide)]
            if wide > 1 or k > 3 or len(raw) != 64 * (1 + wide):
                raise invalid("quantisation")
            table = np.frombuffer(raw, ">u2" if wide else np.uint8).astype(np.int32)
            if not table.all():
                raise invalid("quantisation")
            self.quant[k] = table
            at += 1 + len(raw)

    def huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            kind, k = body[at] >> 4, body[at] & 15
            counts = body[at + 1 : at + 17]
            values = body[at + 17 : at + 17 + sum(counts)]
            if kind > 1 or k > 3 or len(counts) < 16 or len(values) != sum(counts):
                raise invalid("codes")
            table, code, n = {}, 0, 0
            for size, count in enumerate(counts, 1):
                for _ in range(count):
                    if code >= 1 << size:
                        raise invalid("codes")
                    table[size, code] = values[n]
                    code, n = code + 1, n + 1
                code <<= 1
            (self.ac if kind else self.dc)[k] = table
            at += 17 + len(values)

    def scan(self, body: bytes, at: int) -> int:
        self.scans += 1
        if self.scans > self.limits.jpeg_scans:
            raise exceeded("scans")
        n = body[0] if body else 0
        if not 1 <= n <= 4 or len(body) != 4 + 2 * n:
            raise invalid("scan")
        parts = []
        for k in range(n):
            c = next((c for c in self.components if c.id == body[1 + 2 * k]), None)
            if c is None or any(p[0] is c for p in parts) or c.table not in self.quant:
                raise invalid("scan component")
            parts.append((c, body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15))
        first, last, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
        if self.progressive:
            if not (first <= last <= 63 and (n == 1 or not first) and (not high or low + 1 == high) and (first or not last)):
                raise invalid("scan range")
        else:
            first, last, high, low = 0, 63, 0, 0
        for c, dc, ac in parts:
            if not self.progressive and c.coded or first and c.level[0] < 0:
                raise invalid("scan order")
            if first == 0 and not high and dc not in self.dc or last and ac not in self.ac:
                raise invalid("scan codes")
            for k in range(first, last + 1):
                if self.progressive and c.level[k] != (high or -1):
                    raise invalid("scan order")
                c.level[k] = low
            if c.level[0] >= 0 and not hasattr(c, "quant"):
                c.quant = self.quant[c.table]
        e = _Entropy(self.data, at)
        predicted = [0] * n
        run = [0]
        if n == 1:
            c = parts[0][0]
            wide, high_blocks = -(-c.width // 8), -(-c.height // 8)
            units = ([(0, y * c.stride + x)] for y in range(high_blocks) for x in range(wide))
            total = wide * high_blocks
        else:
            units = (
                [(k, (y * c.v + v) * c.stride + x * c.h + h) for k, (c, _, _) in enumerate(parts) for v in range(c.v) for h in range(c.h)]
                for y in range(self.down) for x in range(self.across)
            )
            total = self.across * self.down
        expected = 0
        for done, unit in enumerate(units, 1):
            for k, place in unit:
                self.blocks += 1
                if self.blocks > self.limits.jpeg_blocks:
                    raise exceeded("JPEG blocks")
                c, dc, ac = parts[k]
                block = c.data[place]
                if block is None:
                    block = c.data[place] = [0] * 64
                self.block(e, block, predicted, k, self.dc.get(dc), self.ac.get(ac), first, last, high, low, run)
            if self.restart and done % self.restart == 0 and done < total:
                e.align()
                if run[0]:
                    raise invalid("restart")
                marker, e.at = self.marker(e.at)
                if marker != 0xD0 + expected:
                    raise invalid("restart")
                expected = (expected + 1) % 8
                predicted = [0] * n
        if run[0]:
            raise invalid("scan ended inside a run")
        e.align()
        for c, _, _ in parts:
            c.coded = True
        # A last restart marker may stand before the next segment.
        marker, behind = self.marker(e.at)
        if 0xD0 <= marker <= 0xD7:
            if not self.restart or marker != 0xD0 + expected:
                raise invalid("restart")
            return behind
        return e.at

    def block(self, e, block, predicted, k, dc, ac, first, last, high, low, run) -> None:
        """Read one block's share of a scan; coefficients are kept in zigzag order."""
        if first == 0:
            if high:
                block[0] |= e.bits(1) << low
            else:
                size = e.code(dc)
                if size > 15:
                    raise invalid("DC")
                predicted[k] += e.value(size)
                block[0] = predicted[k] << low
            first = 1
        if last == 0:
            return
        if high:
            self.refine(e, block, ac, first, last, low, run)
            return
        if run[0]:
            run[0] -= 1
            return
        at = first
        while at <= last:
            code = e.code(ac)
            skip, size = code >> 4, code & 15
            if size:
                at += skip
                if at > last:
                    raise invalid("AC")
                block[at] = e.value(size) << low
                at += 1
            elif skip == 15:
                at += 16
            else:
                if skip and not self.progressive:
                    raise invalid("AC")
                run[0] = (1 << skip) + (e.bits(skip) if skip else 0) - 1
                return

    def refine(self, e, block, ac, first, last, low, run) -> None:
        one = 1 << low

        def touch(at: int) -> None:
            if e.bits(1) and not abs(block[at]) & one:
                block[at] += one if block[at] > 0 else -one

        at = first
        if not run[0]:
            while at <= last:
                code = e.code(ac)
                skip, size = code >> 4, code & 15
                new = 0
                if size:
                    if size != 1:
                        raise invalid("AC")
                    new = one if e.bits(1) else -one
                elif skip < 15:
                    run[0] = (1 << skip) + (e.bits(skip) if skip else 0)
                    break
                while at <= last:
                    if block[at]:
                        touch(at)
                    elif skip:
                        skip -= 1
                    else:
                        if new:
                            block[at] = new
                        at += 1
                        break
                    at += 1
                else:
                    if new:
                        raise invalid("AC")
        if run[0]:
            for k in range(at, last + 1):
                if block[k]:
                    touch(k)
            run[0] -= 1

    def plane(self, c: _Component) -> np.ndarray:
        """Samples of a component at its own resolution."""
        zero = [0] * 64
        flat = np.array([b or zero for b in c.data], np.int64) * c.quant
        square = np.zeros((len(flat), 64))
        square[:, ZIGZAG] = flat
        pixels = _COSINE.T @ square.reshape(-1, 8, 8) @ _COSINE
        rows = len(flat) // c.stride
        pixels = pixels.reshape(rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * rows, 8 * c.stride)
        return np.clip(np.floor(pixels + 128.5), 0, 255)[: c.height, : c.width]

    def full(self, c: _Component) -> np.ndarray:
        p = self.plane(c)
        p = _wider(p, self.vmax // c.v)
        p = _wider(p.T, self.hmax // c.h).T
        return np.floor(p + 0.5)[: self.height, : self.width]

    def rgb(self) -> np.ndarray:
        planes = [self.full(c) for c in self.components]
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
        letters = bytes(c.id for c in self.components) == b"RGB"
        direct = letters or self.adobe == 0 and not self.jfif
        if len(planes) == 3:
            out = np.stack(planes, 2) if direct else _rgb(*planes)
            return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)
        inks = 255 - _rgb(*planes[:3]) if self.adobe == 2 else np.stack(planes[:3], 2)
        black = planes[3][:, :, None]
        return np.clip(np.floor(np.clip(inks, 0, 255) * black / 255 + 0.5), 0, 255).astype(np.uint8)


def _rgb(y, cb, cr) -> np.ndarray:
    cb, cr = cb - 128, cr - 128
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)


def _wider(p: np.ndarray, factor: int) -> np.ndarray:
    """Rows repeated, or for a factor of two a quarter of the nearer neighbour mixed in."""
    if factor == 1:
        return p
    if factor != 2 or len(p) < 2:
        return np.repeat(p, factor, 0)
    above, below = np.concatenate([p[:1], p[:-1]]), np.concatenate([p[1:], p[-1:]])
    return np.stack([3 * p + above, 3 * p + below], 1).reshape(2 * len(p), *p.shape[1:]) / 4


def decode_jpeg(data: bytes, limits: Limits = LIMITS) -> np.ndarray:
    """RGB pixels, top row first."""
    if len(data) > limits.input_bytes:
        raise exceeded("JPEG")
    try:
        return _Image(data, limits).rgb()
    except (IndexError, KeyError) as e:
        raise invalid("JPEG") from e
