"""Files beside Spark's own readers: one way from the paths that Spark takes to Arrow's file systems."""

from __future__ import annotations

import os
import re

from pyarrow import fs

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
#: Names that Hadoop and Arrow have for the same kind of store.
_SAME = {"s3a": "s3", "s3n": "s3", "gs": "gcs"}


def absolute(path: str) -> str:
    """``path`` as a URI that means the same to the driver and every executor; relative paths are taken from the driver's folder."""
    found = _SCHEME.match(path)
    if not found:
        return "file://" + os.path.abspath(path)
    scheme, rest = found[1].lower(), path[found.end() :]
    if scheme == "file":
        return "file://" + os.path.abspath("/" + rest.lstrip("/"))
    return f"{_SAME.get(scheme, scheme)}:{rest}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and the path in it."""
    uri = absolute(path)
    if uri.startswith("file://"):  # not parsed as a URI: names may hold % and #
        return fs.LocalFileSystem(), uri[7:]
    return fs.FileSystem.from_uri(uri)
