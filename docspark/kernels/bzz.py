"""BZZ: blocks of a Burrows-Wheeler transform, move-to-front ranks with frequencies, ZP coding. Decoder and encoder."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

from docspark.kernels.core import LIMITS, Limits, exceeded, invalid
from docspark.kernels.zp import Decoder, Encoder

#: Contexts of one stream; ranks 2 and up are coded in seven groups of 2, 4, ... 128 behind the first six.
CONTEXTS = 300
MARK = 256
_GROUPS = [(2**k + 4, k) for k in range(1, 8)]  # (first context, bits)


class _Ranks:
    """The move-to-front list with the four frequencies that keep common bytes in front."""

    def __init__(self, speed: int):
        self.order = list(range(256))
        self.frequency = [0, 0, 0, 0]
        self.add, self.speed = 4, speed

    def touch(self, rank: int) -> int:
        """Byte at a rank, which moves forward."""
        order, frequency = self.order, self.frequency
        byte = order[rank]
        self.add += self.add >> self.speed
        if self.add > 0x10000000:
            self.add >>= 24
            frequency[:] = [f >> 24 for f in frequency]
        mine = self.add + (frequency[rank] if rank < 4 else 0)
        to = min(rank, 4)
        # Beyond the first four every byte moves up to their edge; among them only past what is less frequent.
        if rank >= 4:
            del order[rank]
            order.insert(3, byte)
            to = 3
            frequency[3] = mine
        while to > 0 and mine >= frequency[to - 1]:
            order[to] = order[to - 1]
            frequency[to] = frequency[to - 1]
            to -= 1
        order[to] = byte
        frequency[to] = mine
        return byte


def _read_rank(zp: Decoder, contexts: list[int], last: int) -> int:
    group = last if last < 2 else 2
    if zp.bit(contexts, group):
        return 0
    if zp.bit(contexts, 3 + group):
        return 1
    for base, bits in _GROUPS:
        if zp.bit(contexts, base):
            n = 1
            for _ in range(bits):
                n = n << 1 | zp.bit(contexts, base + n)
            return n
    return MARK


def _write_rank(zp: Encoder, contexts: list[int], last: int, rank: int) -> None:
    group = last if last < 2 else 2
    zp.bit(contexts, group, int(rank == 0))
    if rank == 0:
        return
    zp.bit(contexts, 3 + group, int(rank == 1))
    if rank == 1:
        return
    for base, bits in _GROUPS:
        here = rank < 2 << bits
        zp.bit(contexts, base, int(here))
        if here:
            n = 1
            for k in range(bits - 1, -1, -1):
                b = rank >> k & 1
                zp.bit(contexts, base + n, b)
                n = n << 1 | b
            return


def _untransform(last: np.ndarray, mark: int) -> bytes:
    """The block whose sorted rotations end in ``last``; ``mark`` is the place of the end marker."""
    n = len(last)
    keys = last.astype(np.int16) + 1
    keys[mark] = 0
    place = np.empty(n, np.int64)
    place[np.argsort(keys, kind="stable")] = np.arange(n)
    step, out, at = place.tolist(), bytearray(n - 1), 0
    text = last.tolist()
    for k in range(n - 2, -1, -1):
        if at == mark:
            raise invalid("transform")
        out[k] = text[at]
        at = step[at]
    if at != mark:
        raise invalid("transform")
    return bytes(out)


#: Small streams, as those of directories and palettes, repeat from document to document: a worker keeps so many, of so many bytes at most on both sides.
KEPT, SMALL = 8192, 512
_kept: OrderedDict[tuple, bytes] = OrderedDict()


def _once(key: tuple, make) -> bytes:
    """What make() makes, or made before for an equal key."""
    out = _kept.get(key)
    if out is None:
        out = make()
        if len(out) <= SMALL:
            _kept[key] = out
            if len(_kept) > KEPT:
                _kept.popitem(last=False)
    else:
        _kept.move_to_end(key)
    return out


def bzz_decode(data: bytes, most: int, limits: Limits = LIMITS) -> bytes:
    """The bytes of a BZZ stream, ``most`` at most."""
    return _decode(data, most, limits) if len(data) > SMALL else _once((False, bytes(data), most, limits), lambda: _decode(data, most, limits))


def _decode(data: bytes, most: int, limits: Limits) -> bytes:
    if not data:
        raise invalid("empty stream")
    zp = Decoder(data)
    contexts = [0] * CONTEXTS
    out = bytearray()
    while size := zp.number(24):
        if size > limits.bzz_block or size - 1 > most - len(out):
            raise exceeded("decompressed bytes")
        speed = 0 if not zp.raw() else 1 + zp.raw()
        ranks, last, mark = _Ranks(speed), 3, None
        block = np.zeros(size, np.uint8)
        touch = ranks.touch
        for k in range(size):
            last = _read_rank(zp, contexts, last)
            if last == MARK:
                if mark is not None:
                    raise invalid("two markers")
                mark = k
            else:
                block[k] = touch(last)
        if not mark:
            raise invalid("no marker")
        out += _untransform(block, mark)
    return bytes(out)


def _transform(block: bytes) -> tuple[np.ndarray, int]:
    """Last column of the sorted suffixes of block and its end marker, and the marker's place."""
    n = len(block) + 1
    rank = np.concatenate((np.frombuffer(block, np.uint8).astype(np.int64) + 1, [0]))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 300) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            break
        width *= 2
    text = np.frombuffer(block + bytes(1), np.uint8)
    return text[order - 1], int(np.flatnonzero(order == 0)[0])


def bzz_encode(data: bytes, block: int = 1 << 20) -> bytes:
    """A BZZ stream of the bytes."""
    return _encode(data, block) if len(data) > SMALL else _once((True, bytes(data), block), lambda: _encode(data, block))


def _encode(data: bytes, block: int) -> bytes:
    zp = Encoder()
    contexts = [0] * CONTEXTS
    for start in range(0, len(data), block):
        last, mark = _transform(data[start : start + block])
        zp.number(len(last), 24)
        speed = 0 if len(last) < 100_000 else 1 if len(last) < 1_000_000 else 2
        zp.raw(int(speed > 0))
        if speed:
            zp.raw(speed - 1)
        ranks, previous = _Ranks(speed), 3
        for k, byte in enumerate(last.tolist()):
            rank = MARK if k == mark else ranks.order.index(byte)
            _write_rank(zp, contexts, previous, rank)
            previous = rank
            if rank != MARK:
                ranks.touch(rank)
    zp.number(0, 24)
    return zp.finish()
