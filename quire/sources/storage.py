"""Files that tasks write or read themselves, on any file system the cluster's paths name."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (local, hdfs, s3, gs) for use inside a task."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def publish(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a whole file, visible under its name only when it is complete; a
    task that runs twice publishes the same bytes twice."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(aside) as f:
        f.write(data)
    files.move(aside, path)
