"""Files of Python data sources, by path or by the address of a file system that the machine's libraries know."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as pafs


@contextmanager
def open_bytes(path: str):
    """A file to read at any place."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        yield f
