"""Files read by ranges: a path stands for the content, and only the bytes that a question needs are read.

Spark lists the files and deals several to a task; a task opens each by its path, on a local disk or through the file systems that pyarrow
knows (hdfs, s3, gs and others). A ``Span`` stands for a part of a file as bytes would, and slices of it read nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlsplit


class Span:
    """Bytes start..stop of an open file; read when they are made ``bytes``."""

    __slots__ = ("_file", "_start", "_stop")

    def __init__(self, file, start: int, stop: int):
        self._file, self._start, self._stop = file, start, stop

    def __len__(self) -> int:
        return self._stop - self._start

    def __getitem__(self, part: slice) -> Span:
        first, last, step = part.indices(len(self))
        if step != 1:
            raise ValueError("a span has no steps")
        return Span(self._file, self._start + first, self._start + max(first, last))

    def __bytes__(self) -> bytes:
        self._file.seek(self._start)
        return self._file.read(len(self))

    def decode(self, encoding: str = "utf-8") -> str:
        return bytes(self).decode(encoding)

    def startswith(self, head: bytes) -> bool:
        return bytes(self[: len(head)]) == head


def _open(path: str):
    """(file, its size): seekable, for reading."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        import os

        name = unquote(parts.path) if parts.scheme else path
        return open(name, "rb"), os.path.getsize(name)
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    file = system.open_input_file(name)
    return file, file.size()


@contextmanager
def content_of(content: bytes | str) -> Iterator[bytes | Span]:
    """The content itself, or for a path the span of its file."""
    if not isinstance(content, str):
        yield content
        return
    file, size = _open(content)
    with file:
        yield Span(file, 0, size)
