"""Plain files in shared storage, from Python tasks: written whole or not at all."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import urlparse


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


@contextmanager
def create(uri: str):
    """A binary stream; the file appears under its name when the block ends without an error, so
    a task that runs twice leaves one file."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        try:
            with open(part, "wb") as f:
                yield f
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        yield f
    store.move(part, path)


def open_at(uri: str):
    """A binary file to read and seek in."""
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
