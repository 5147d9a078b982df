"""Files that executors write for one another, in the shared folder; any file system that Arrow opens by URI will do."""

from __future__ import annotations

import contextlib
import os
import posixpath
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs as pafs

from pyspark.sql import SparkSession

from .common import shared_dir


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a plain path; None for another scheme."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _remote(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder's URI below the shared one."""
    uri = posixpath.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    if path := local_path(uri):
        os.makedirs(path, exist_ok=True)
    else:
        system, at = _remote(uri)
        system.create_dir(at, recursive=True)
    return uri


@contextlib.contextmanager
def written(uri: str) -> Iterator:
    """A binary file to write; it appears under its name whole, when closed, so that a lost or repeated task leaves no part of one."""
    draft = f"{uri}.{uuid.uuid4().hex}.tmp"
    if path := local_path(draft):
        with open(path, "wb", buffering=1 << 20) as out:
            yield out
        os.replace(path, local_path(uri))
    else:
        system, at = _remote(draft)
        with system.open_output_stream(at) as out:
            yield out
        system.move(at, _remote(uri)[1])


def mapped(uri: str) -> pa.Buffer:
    """The file's bytes: memory-mapped if its file system allows that, else read."""
    if path := local_path(uri):
        if not os.path.getsize(path):
            return pa.py_buffer(b"")
        with pa.memory_map(path) as source:
            return source.read_buffer()
    system, at = _remote(uri)
    with system.open_input_file(at) as source:
        return source.read_buffer()


def opened(uri: str):
    """A seekable binary file."""
    if path := local_path(uri):
        return open(path, "rb", buffering=1 << 20)
    system, at = _remote(uri)
    return system.open_input_file(at)
