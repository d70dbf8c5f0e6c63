"""The outline: a preorder forest of titles and links."""

from __future__ import annotations

from typing import NamedTuple

from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Limits, Reader, exceeded, invalid
from docspark.kernels.text import is_utf8


class OutlineEntry(NamedTuple):
    title: str
    href: str
    parent: int | None
    subtree_end: int


def decode_outline(payload: bytes, limits: Limits = LIMITS) -> list[OutlineEntry]:
    r = Reader(bzz_decode(payload, min(limits.outline_bytes, limits.bzz_bytes), limits))
    count = r.uint(2)
    if count > limits.outline_entries:
        raise exceeded("outline entries")
    if count > r.left // 7:
        raise invalid("outline count")
    out: list[list] = []
    open_: list[list[int]] = []  # entry, children to come
    for k in range(count):
        while open_ and not open_[-1][1]:
            out[open_.pop()[0]][3] = k
        if len(open_) >= min(64, limits.outline_depth):
            raise exceeded("outline depth")
        children = r.uint(1)
        if children > count - k - 1:
            raise invalid("outline children")
        title, href = r.take(r.uint(3)), r.take(r.uint(3))
        if not is_utf8(title) or not is_utf8(href):
            raise invalid("outline text")
        out.append([title.decode(), href.decode(), open_[-1][0] if open_ else None, k + 1])
        if open_:
            open_[-1][1] -= 1
        if children:
            open_.append([k, children])
    while open_:
        entry, left = open_.pop()
        if left:
            raise invalid("outline ends early")
        out[entry][3] = count
    if r.left:
        raise invalid("outline goes on")
    return [OutlineEntry(*e) for e in out]
