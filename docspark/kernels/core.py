"""Errors, limits and the big-endian reader that all kernels use."""

from __future__ import annotations

from dataclasses import dataclass


class Bad(Exception):
    """A typed failure. Its code becomes the status of a row; it never fails a job."""

    def __init__(self, code: str, why: str = ""):
        super().__init__(f"{code}: {why}" if why else code)
        self.code = code
        self.why = why


def invalid(why: str = "") -> Bad:
    return Bad("InvalidData", why)


def unsupported(why: str = "") -> Bad:
    return Bad("Unsupported", why)


def exceeded(why: str = "") -> Bad:
    return Bad("LimitExceeded", why)


def argument(why: str = "") -> Bad:
    return Bad("InvalidArgument", why)


@dataclass(frozen=True)
class Limits:
    """Resource bounds of one document; passing one is an error, never a silent cut."""

    input_bytes: int = 128 << 20
    bzz_bytes: int = 16 << 20
    bzz_block: int = 4 << 20
    page_pixels: int = 64 << 20
    shape_pixels: int = 16 << 20
    shapes: int = 100_000
    blits: int = 1_000_000
    cells: int = 1_000_000
    records: int = 2_000_000
    components: int = 65_535
    chunks: int = 1_000_000
    include_depth: int = 64
    iw_slices: int = 512
    iw_chunks: int = 256
    jpeg_scans: int = 256
    jpeg_blocks: int = 16 << 20
    text_bytes: int = 4 << 20
    text_zones: int = 100_000
    text_depth: int = 64
    annotation_bytes: int = 4 << 20
    annotation_nodes: int = 100_000
    annotation_depth: int = 64
    outline_bytes: int = 4 << 20
    outline_entries: int = 65_535
    outline_depth: int = 64


LIMITS = Limits()


class Reader:
    """Cursor over bytes; running past the end is invalid data."""

    __slots__ = ("at", "data")

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        end = self.at + n
        if end > len(self.data):
            raise invalid("truncated")
        out = self.data[self.at : end]
        self.at = end
        return out

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def string(self) -> bytes:
        end = self.data.find(0, self.at)
        if end < 0:
            raise invalid("unterminated string")
        out = self.data[self.at : end]
        self.at = end + 1
        return out

    @property
    def left(self) -> int:
        return len(self.data) - self.at
