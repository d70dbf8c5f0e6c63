"""Chunks, page information, text layers, outlines and directories as bytes."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from docspark.kernels.bzz import bzz_encode
from docspark.kernels.iff import KINDS, MAGIC
from docspark.kernels.text import BIAS, ZONE_KINDS

#: Quarter turns to INFO flag.
FLAGS = (1, 6, 2, 5)


def chunk(id_: str, data: bytes, pad: bool = True) -> bytes:
    return id_.encode("latin-1") + len(data).to_bytes(4, "big") + data + (b"\0" if pad and len(data) & 1 else b"")


def form(kind: str, *children: bytes) -> bytes:
    return chunk("FORM", kind.encode("latin-1") + b"".join(children))


def document(form_bytes: bytes) -> bytes:
    return MAGIC + form_bytes


def info(width: int, height: int, dpi: int = 300, gamma_tenths: int = 22, rotation: int = 0, version: int = 26) -> bytes:
    return chunk("INFO", width.to_bytes(2, "big") + height.to_bytes(2, "big") + bytes([version & 0xFF, version >> 8]) + dpi.to_bytes(2, "little") + bytes([gamma_tenths, FLAGS[rotation]]))


@dataclass
class ZoneTree:
    """A zone in absolute top-left pixels and byte offsets."""

    kind: str
    x: int
    y: int
    width: int
    height: int
    start: int
    length: int
    children: list[ZoneTree] = field(default_factory=list)


def text_payload(text: bytes, tree: ZoneTree | None = None, page_height: int = 0) -> bytes:
    out = bytearray(len(text).to_bytes(3, "big") + text)
    if tree is None:
        return bytes(out)
    out.append(1)

    def put(z: ZoneTree, parent: ZoneTree | None, before: ZoneTree | None) -> None:
        if before is not None and z.kind in ("page", "paragraph", "line"):
            dx, dy, start = z.x - before.x, z.y - before.y - before.height, z.start - before.start - before.length
        elif before is not None:
            dx, dy = z.x - before.x - before.width, before.y + before.height - z.y - z.height
            start = z.start - before.start - before.length
        elif parent is not None:
            dx, dy, start = z.x - parent.x, z.y - parent.y, z.start - parent.start
        else:
            dx, dy, start = z.x, page_height - z.y - z.height, z.start
        out.append(ZONE_KINDS.index(z.kind) + 1)
        for v in (dx, dy, z.width, z.height, start):
            out.extend((v + BIAS).to_bytes(2, "big"))
        out.extend(z.length.to_bytes(3, "big") + len(z.children).to_bytes(3, "big"))
        for k, child in enumerate(z.children):
            put(child, z, z.children[k - 1] if k else None)

    put(tree, None, None)
    return bytes(out)


def text(data: bytes, tree: ZoneTree | None = None, page_height: int = 0, compressed: bool = False) -> bytes:
    payload = text_payload(data, tree, page_height)
    return chunk("TXTz", bzz_encode(payload)) if compressed else chunk("TXTa", payload)


def annotations(source: bytes, compressed: bool = False) -> bytes:
    return chunk("ANTz", bzz_encode(source)) if compressed else chunk("ANTa", source)


def include(id_: str) -> bytes:
    return chunk("INCL", id_.encode())


def outline_payload(entries: list[tuple[str, str, int]]) -> bytes:
    """Preorder (title, href, number of children), uncompressed."""
    out = bytearray(len(entries).to_bytes(2, "big"))
    for title, href, children in entries:
        out.append(children)
        for s in (title.encode(), href.encode()):
            out += len(s).to_bytes(3, "big") + s
    return bytes(out)


def outline(entries: list[tuple[str, str, int]]) -> bytes:
    return chunk("NAVM", bzz_encode(outline_payload(entries)))


class Component(NamedTuple):
    id: str
    kind: str
    form: bytes
    name: str | None = None
    title: str | None = None


def _directory(components: list[Component], offsets: list[int] | None, version: int = 1, zero_sizes: bool = False) -> bytes:
    sizes = [0 if zero_sizes else len(c.form) for c in components]
    head = bytearray([(0x80 if offsets is not None else 0) | version])
    head += len(components).to_bytes(2, "big")
    body = bytearray()
    for k, size in enumerate(sizes):
        if offsets is not None:
            head += offsets[k].to_bytes(4, "big")
            if version == 0:
                head += size.to_bytes(3, "big")
        if version:
            body += size.to_bytes(3, "big")
    for c in components:
        body.append(KINDS.index(c.kind) | (0x80 if c.name is not None else 0) | (0x40 if c.title is not None else 0))
    for c in components:
        body += c.id.encode() + b"\0"
        for s in (c.name, c.title):
            if s is not None:
                body += s.encode() + b"\0"
    return chunk("DIRM", bytes(head) + bzz_encode(bytes(body)))


def _exact(form_bytes: bytes) -> bytes:
    """A FORM without its padding."""
    return form_bytes[: 8 + int.from_bytes(form_bytes[4:8], "big")]


def bundle(components: list[Component], navm: bytes = b"", version: int = 1, zero_sizes: bool = False) -> bytes:
    """A document of many components in one file, in directory order."""
    exact = [c._replace(form=_exact(c.form)) for c in components]
    size = len(_directory(exact, [0] * len(exact), version, zero_sizes))
    at, offsets, body = len(MAGIC) + 12 + size + len(navm), [], bytearray()
    for c in exact:
        offsets.append(at + len(body))
        body += c.form + (b"\0" if len(c.form) & 1 else b"")
    return document(form("DJVM", _directory(exact, offsets, version, zero_sizes), navm, bytes(body)))


def indirect(components: list[Component], navm: bytes = b"", version: int = 1) -> tuple[bytes, dict[str, bytes]]:
    """(index file, files by name) of a document whose components are files of their own."""
    exact = [c._replace(form=_exact(c.form)) for c in components]
    return document(form("DJVM", _directory(exact, None, version), navm)), {c.name or c.id: document(c.form) for c in exact}


def palette(colors: list[tuple[int, int, int]], indices: list[int] | None = None) -> bytes:
    out = bytearray([0 if indices is None else 0x80])
    out += len(colors).to_bytes(2, "big")
    for r, g, b in colors:
        out += bytes([b, g, r])
    if indices is not None:
        out += len(indices).to_bytes(3, "big") + bzz_encode(b"".join(k.to_bytes(2, "big") for k in indices))
    return chunk("FGbz", bytes(out))


def ppm(width: int, height: int, rgba: bytes) -> bytes:
    """Binary pixel map of RGBA pixels; alpha is left out."""
    import numpy as np

    rgb = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)[:, :, :3]
    return b"P6\n%d %d\n255\n" % (width, height) + rgb.tobytes()
