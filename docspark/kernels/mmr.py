"""MMR masks: ITU-T T.6 two-dimensional run coding with stripes and the uncompressed extension. Decoder and encoder."""

from __future__ import annotations

import bisect

import numpy as np

from docspark.kernels.core import LIMITS, Limits, exceeded, invalid, unsupported

# Fixed values of T.4 and T.6: codes of runs 0 to 63, then of 64, 128, ... 1728, then those of 1792, 1856, ... 2560 for both colours.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
)
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 "
    "0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
)
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
PASS, HORIZONTAL, EXTEND = "0001", "001", "0000001"
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
END = "000000000001" * 2


def _runs(codes: str) -> dict[int, str]:
    sizes = [*range(64), *range(64, 1792, 64), *range(1792, 2561, 64)]
    return dict(zip(sizes, (codes + " " + LONG).split(), strict=True))


RUNS = (_runs(WHITE), _runs(BLACK))
_MODES = {PASS: "pass", HORIZONTAL: "horizontal", EXTEND: "extend"} | {c: d for d, c in VERTICAL.items()}


def _table(codes: dict[str, object]) -> dict[tuple[int, int], object]:
    return {(len(c), int(c, 2)): v for c, v in codes.items()}


_MODE_TABLE = _table(_MODES)
_RUN_TABLES = tuple(_table({c: n for n, c in runs.items()}) for runs in RUNS)


class _Window:
    """Bits of the data, kept as a short number that is refilled."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.left, self.value, self.kept = 8 * len(data), 0, 0

    def read(self, n: int) -> int:
        if n > self.left:
            raise invalid("codes ended")
        while self.kept < n:
            part = self.data[self.at : self.at + 64]
            self.value = (self.value & (1 << self.kept) - 1) << 8 * len(part) | int.from_bytes(part, "big")
            self.kept += 8 * len(part)
            self.at += len(part)
        self.left -= n
        self.kept -= n
        return self.value >> self.kept & (1 << n) - 1

    def code(self, table: dict) -> object:
        word = 0
        for size in range(1, 14):
            word = word << 1 | self.read(1)
            found = table.get((size, word))
            if found is not None:
                return found
        raise invalid("code")


def decode_mmr(data: bytes, limits: Limits = LIMITS) -> np.ndarray:
    """Mask pixels, top row first, 1 for ink."""
    if len(data) > limits.input_bytes:
        raise exceeded("mask")
    if len(data) < 8 or data[:3] != b"MMR":
        raise invalid("mask header")
    if data[3] & 0xFC:
        raise unsupported("mask flags")
    width, height = int.from_bytes(data[4:6], "big"), int.from_bytes(data[6:8], "big")
    if not width or not height:
        raise invalid("mask size")
    if width * height > limits.page_pixels:
        raise exceeded("mask pixels")
    striped, at = bool(data[3] & 2), 8
    step = height
    if striped:
        if len(data) < 10:
            raise invalid("stripe height")
        step, at = int.from_bytes(data[8:10], "big"), 10
        if not step:
            raise invalid("stripe height")
    out = np.zeros((height, width), np.uint8)
    records = [0]
    for top in range(0, height, step):
        size = len(data) - at
        if striped:
            if size < 4:
                raise invalid("stripe")
            size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not size or size > len(data) - at:
            raise invalid("stripe")
        _stripe(_Window(data[at : at + size]), out[top : top + step], width, records, limits)
        at += size
    if at != len(data):
        raise invalid("mask goes on")
    return out ^ np.uint8(data[3] & 1)


def _stripe(bits: _Window, out: np.ndarray, width: int, records: list[int], limits: Limits) -> None:
    """Rows of a stripe as colour changes; the row above the first is white."""
    above: list[int] = []
    changes: list[int] = []
    row, x, pen, begin = 0, 0, 0, True

    def record():
        if records[0] >= limits.records:
            raise exceeded("records")
        records[0] += 1

    def paint(end: int, color: int) -> None:
        nonlocal x
        if end > width or row >= len(out):
            raise invalid("run")
        if end > x:
            if color != len(changes) % 2:
                changes.append(x)
            x = end

    def new_row() -> None:
        nonlocal above, changes, row, x, pen, begin
        edges = [*changes, width]
        for a, b in zip(edges[::2], edges[1::2], strict=False):
            out[row, a:b] = 1
        above, changes = changes, []
        row, x, pen, begin = row + 1, 0, 0, True

    def reference() -> tuple[int, int]:
        k = bisect.bisect_left(above, x) if begin else bisect.bisect_right(above, x)
        k += k % 2 != pen
        return (above[k] if k < len(above) else width), (above[k + 1] if k + 1 < len(above) else width)

    while True:
        if x == width:
            new_row()
        if row == len(out):
            break
        record()
        mode = bits.code(_MODE_TABLE)
        if mode == "horizontal":
            begin_x = x
            begin = False
            for part in range(2):
                total = 0
                while True:
                    record()
                    run = bits.code(_RUN_TABLES[pen])
                    total += run
                    if total > width - x:
                        raise invalid("run")
                    if run < 64:
                        break
                if part and x + total == begin_x:
                    raise invalid("empty runs")
                paint(x + total, pen)
                pen ^= 1
        elif mode == "extend":
            if bits.read(3) != 7:
                raise unsupported("extension")
            begin = False
            while True:
                record()
                zeros = 0
                while not bits.read(1):
                    zeros += 1
                    if zeros > 10:
                        raise invalid("literal")
                leave = zeros >= 6
                after = bits.read(1) if leave else 0
                for color in [0] * (zeros - 6 if leave else min(zeros, 5)) + ([1] if zeros < 5 else []):
                    paint(x + 1, color)
                    if x == width:
                        new_row()
                begin = x == 0
                if leave:
                    pen = after
                    break
        else:
            b1, b2 = reference()
            end = b2 if mode == "pass" else b1 + mode
            if not x <= end <= width:
                raise invalid("reference")
            paint(end, pen)
            if mode != "pass":
                pen ^= 1
            begin = False
    left = bits.left
    if left <= 7:
        padding = bits.read(left)
        if padding not in (0, (1 << left) - 1):
            raise invalid("padding")
    elif bits.read(24) != int(END, 2):
        raise invalid("no end")
    while bits.left:
        if bits.read(min(8, bits.left)):
            raise invalid("padding")


def encode_mmr(pixels: np.ndarray, invert: bool = False, stripe: int | None = None) -> bytes:
    """A mask chunk of 0/1 pixels, top row first."""
    height, width = pixels.shape
    head = b"MMR" + bytes([invert | (2 if stripe else 0)]) + width.to_bytes(2, "big") + height.to_bytes(2, "big")
    raw = np.asarray(pixels, np.uint8) ^ np.uint8(invert)
    if stripe is None:
        return head + _encode_stripe(raw)
    parts = [_encode_stripe(raw[k : k + stripe]) for k in range(0, height, stripe)]
    return head + stripe.to_bytes(2, "big") + b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def _run_code(run: int, color: int) -> str:
    out = ""
    while run >= 2560:
        out, run = out + RUNS[color][2560], run - 2560
    if run >= 64:
        out, run = out + RUNS[color][run // 64 * 64], run % 64
    return out + RUNS[color][run]


def _encode_stripe(rows: np.ndarray) -> bytes:
    width, out, above = rows.shape[1], [], []
    for row in rows:
        changes = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0)).tolist()
        x, pen, begin = 0, 0, True
        while x < width:
            k = bisect.bisect_left(changes, x) if begin else bisect.bisect_right(changes, x)
            k += k % 2 != pen
            a1, a2 = (changes[j] if j < len(changes) else width for j in (k, k + 1))
            k = bisect.bisect_left(above, x) if begin else bisect.bisect_right(above, x)
            k += k % 2 != pen
            b1, b2 = (above[j] if j < len(above) else width for j in (k, k + 1))
            if b2 < a1:
                out.append(PASS)
                x = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                x, pen = a1, pen ^ 1
            else:
                out.append(HORIZONTAL + _run_code(a1 - x, pen) + _run_code(a2 - a1, pen ^ 1))
                x = a2
            begin = False
        above = changes
    bits = "".join(out) + END
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")
