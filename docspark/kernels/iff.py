"""IFF chunks, page INFO and the document directory."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Limits, Reader, exceeded, invalid, unsupported

MAGIC = b"AT&T"
#: Component kinds by directory flag, and the FORM type each must have. Fixed values of the format.
KINDS = ("shared", "page", "thumbnail", "shared_annotations")
KIND_FORMS = {"shared": "DJVI", "page": "DJVU", "thumbnail": "THUM", "shared_annotations": "DJVI"}
WAVELET_FORMS = ("PM44", "BM44")
#: INFO flag to quarter turns. Fixed values of the format.
TURNS = {6: 1, 2: 2, 5: 3}


class Chunk(NamedTuple):
    id: str
    offset: int
    data: bytes

    @property
    def form(self) -> str | None:
        """Type of a FORM, else None."""
        if self.id != "FORM":
            return None
        if len(self.data) < 4:
            raise invalid("short FORM")
        return self.data[:4].decode("latin-1")

    def children(self) -> list[Chunk]:
        if self.form is None:
            raise invalid("not a FORM")
        return list(chunks(self.data[4:], self.offset + 12))


def chunks(data: bytes, base: int = 0) -> Iterator[Chunk]:
    """Chunks on end; an odd one is padded, except that the last may do without."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise invalid("short chunk header")
        head = bytes(data[at : at + 8])
        size = int.from_bytes(head[4:], "big")
        end = at + 8 + size
        if end > len(data):
            raise invalid("chunk overruns")
        yield Chunk(head[:4].decode("latin-1"), base + at, data[at + 8 : end])
        at = min(len(data), end + (size & 1))


def root(data: bytes, limits: Limits = LIMITS) -> Chunk:
    """The one FORM of a file; only stand-alone wavelet images may lack the magic."""
    if len(data) > limits.input_bytes:
        raise exceeded("input")
    if len(data) < 12:
        raise invalid("short file")
    start = len(MAGIC) if data.startswith(MAGIC) else 0
    found = list(chunks(data[start:], start))
    if len(found) != 1 or found[0].form is None:
        raise invalid("not one FORM")
    if not start and found[0].form not in WAVELET_FORMS:
        raise invalid("no magic")
    return found[0]


class Info(NamedTuple):
    width: int
    height: int
    dpi: int
    rotation: int
    gamma_tenths: int = 22
    version: int = 0


def parse_info(data: bytes) -> Info:
    if len(data) < 5:
        raise invalid("short INFO")
    width, height = int.from_bytes(data[:2], "big"), int.from_bytes(data[2:4], "big")
    if not width or not height:
        raise invalid("empty page")
    dpi = int.from_bytes(data[6:8], "little") if len(data) >= 8 else 300
    high = data[5] if len(data) >= 6 and data[5] != 0xFF else 0
    return Info(
        width, height, dpi if 25 <= dpi <= 6000 else 300, TURNS.get(data[9] & 7, 0) if len(data) >= 10 else 0,
        min(max(data[8], 3), 50) if len(data) >= 9 else 22, high << 8 | data[4],
    )


class Entry(NamedTuple):
    """A component of a directory. offset is None in an indirect document."""

    id: bytes
    name: bytes
    title: bytes
    kind: str
    size: int
    offset: int | None


def parse_directory(data: bytes, limits: Limits = LIMITS) -> tuple[bool, list[Entry]]:
    """(indirect, entries) of a DIRM payload."""
    r = Reader(data)
    head = r.uint(1)
    bundled, version = bool(head & 0x80), head & 0x7F
    if version > 1:
        raise unsupported("directory version")
    n = r.uint(2)
    if n > limits.components:
        raise exceeded("components")
    offsets: list[int | None] = []
    sizes = [0] * n
    for k in range(n):
        offsets.append(r.uint(4) if bundled else None)
        if bundled and version == 0:
            sizes[k] = r.uint(3)
    r = Reader(bzz_decode(data[r.at :], limits.bzz_bytes, limits))
    if version:
        sizes = [r.uint(3) for _ in range(n)]
    flags = r.take(n)
    out, seen = [], set()
    for offset, size, flag in zip(offsets, sizes, flags, strict=True):
        id_ = r.string()
        name = r.string() if flag & 0x80 else id_
        title = r.string() if flag & 0x40 else id_
        if not id_ or id_ in seen:
            raise invalid("component id")
        seen.add(id_)
        if flag & 0x3F >= len(KINDS):
            raise unsupported("component kind")
        out.append(Entry(id_, name, title, KINDS[flag & 0x3F], size, offset))
    if r.left:
        raise invalid("directory goes on")
    return not bundled, out
