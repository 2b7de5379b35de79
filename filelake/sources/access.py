"""Random reads of files, and new files, through ``pyarrow.fs``: the store must be one that it knows (file, hdfs, s3, gs)."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow.fs as pafs


@lru_cache(maxsize=64)
def _store(scheme: str, host: str) -> pafs.FileSystem:
    return pafs.LocalFileSystem() if scheme in ("", "file") else pafs.FileSystem.from_uri(f"{scheme}://{host}/")[0]


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path as Spark writes it, and the path in it."""
    scheme, host, path = re.fullmatch(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/]*))?(.*)", uri, re.S).groups(default="")
    return _store(scheme, host), path if scheme in ("", "file", "hdfs", "viewfs") else f"{host}{path}"


class Bytes:
    """Random reads of one file."""

    def __init__(self, path: str, size: int):
        store, at = located(path)
        self.file, self.size = store.open_input_file(at), size

    def read(self, start: int, stop: int) -> bytes:
        start, stop = max(start, 0), min(stop, self.size)
        return self.file.read_at(stop - start, start) if start < stop else b""

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
