"""Files in the shared folder from Python tasks, by Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[5:]
    return fs.LocalFileSystem(), uri


class Reader:
    """Range reads of files, of which the last few stay open."""

    def __init__(self, keep: int = 8):
        self.keep, self.open = keep, {}

    def read(self, uri: str, start: int, size: int) -> bytes:
        if uri not in self.open:
            while len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open))).close()
            where, path = at(uri)
            self.open[uri] = where.open_input_file(path)
        return self.open[uri].read_at(size, start)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}
