"""Hidden text layers and their zone trees."""

from __future__ import annotations

from typing import NamedTuple

from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Limits, Reader, exceeded, invalid, unsupported

#: Kinds of zones by number, from 1. Fixed values of the format.
ZONE_KINDS = ("page", "column", "region", "paragraph", "line", "word", "character")
RECORD = 17
BIAS = 32768


class Zone(NamedTuple):
    """A zone in preorder; its subtree is [its index, subtree_end). Offsets are bytes, boxes top-left pixels."""

    kind: str
    parent: int | None
    x: int
    y: int
    width: int
    height: int
    start: int
    length: int
    subtree_end: int
    depth: int


def repair(data: bytes) -> str:
    """Text with each damaged sequence as U+FFFD; a byte order mark stays."""
    return data.decode("utf-8", "replace")


def is_utf8(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def at_boundary(data: bytes, at: int) -> bool:
    """Whether an offset doesn't split a valid character; damaged bytes may be split."""
    if at in (0, len(data)) or data[at] & 0xC0 != 0x80:
        return True
    for back in range(1, min(at, 3) + 1):
        if data[at - back] & 0xC0 == 0x80:
            continue
        for size in range(back + 1, 5):  # a valid character from there that reaches beyond the offset
            if is_utf8(data[at - back : at - back + size]) and len(data[at - back : at - back + size].decode()) == 1 and at - back + size <= len(data):
                return False
        return True
    return True


def selectable(zones: list[Zone]) -> list[int]:
    """Places of the outermost words, and of leaves that lie in no word, if they have text and an area."""
    out, until = [], 0
    for k, z in enumerate(zones):
        if k < until:
            continue
        if z.kind == "word":
            until = z.subtree_end
        elif z.subtree_end != k + 1:
            continue
        if z.length > 0 and z.width > 0 and z.height > 0:
            out.append(k)
    return out


def decode_text(payload: bytes, compressed: bool, page_height: int, limits: Limits = LIMITS) -> tuple[bytes, list[Zone]]:
    """(source bytes, zones) of a text chunk. The version and the tree may be missing."""
    most = RECORD * limits.text_zones + limits.text_bytes + 4
    if compressed:
        payload = bzz_decode(payload, min(most, limits.bzz_bytes), limits)
    elif len(payload) > most:
        raise exceeded("text chunk")
    r = Reader(payload)
    size = r.uint(3)
    if size > limits.text_bytes:
        raise exceeded("text")
    data = r.take(size)
    if not r.left:
        return data, []
    if r.uint(1) != 1:
        raise unsupported("text version")
    return data, _zones(r, data, page_height, limits) if r.left else []


def _zones(r: Reader, data: bytes, page_height: int, limits: Limits) -> list[Zone]:
    out: list[list] = []
    open_: list[list] = [[None, None, 1]]  # parent, sibling before, children to come
    while open_:
        level = open_[-1]
        if not level[2]:
            open_.pop()
            if level[0] is not None:
                out[level[0]][8] = len(out)
            continue
        if len(out) >= limits.text_zones:
            raise exceeded("zones")
        number = r.uint(1)
        if not 1 <= number <= len(ZONE_KINDS):
            raise invalid("zone kind")
        kind = ZONE_KINDS[number - 1]
        x, dy, width, height, start = (r.uint(2) - BIAS for _ in range(5))
        length, children = r.uint(3), r.uint(3)
        if width < 0 or height < 0:
            raise invalid("zone size")
        parent, before, _ = level
        if before is not None:
            # Siblings that stack go down from the box before, others to its right.
            _, _, bx, by, bw, bh, bstart, blength, _, _ = out[before]
            if kind in ("page", "paragraph", "line"):
                x, y = x + bx, by + bh + dy
            else:
                x, y = x + bx + bw, by + bh - dy - height
            start += bstart + blength
        elif parent is not None:
            x, y, start = x + out[parent][2], out[parent][3] + dy, start + out[parent][6]
        else:
            y = page_height - dy - height
        if not 0 <= start <= len(data) or length > len(data) - start:
            raise invalid("zone span")
        if not at_boundary(data, start) or not at_boundary(data, start + length):
            raise invalid("zone splits a character")
        if children > limits.text_zones - len(out) - 1:
            raise exceeded("zones")
        if children > r.left // RECORD:
            raise invalid("zone children")
        if not (-(2**31) <= x < 2**31 and -(2**31) <= y < 2**31):
            raise exceeded("zone place")
        me = len(out)
        out.append([kind, parent, x, y, width, height, start, length, me + 1, len(open_) - 1])
        level[1], level[2] = me, level[2] - 1
        if children:
            if len(open_) >= min(64, limits.text_depth):
                raise exceeded("zone depth")
            open_.append([me, None, children])
    if r.left:
        raise invalid("text chunk goes on")
    return [Zone(*z) for z in out]
