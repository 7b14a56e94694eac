"""Plain files in the shared folder, read and written by tasks.

Paths come with the scheme of the file system that Spark takes them from (see
``common.qualified``). A task writes under a name of its own and reports that name in a row; rows of
failed or repeated attempts never arrive, so their files are never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, ending: str) -> str:
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    return f"{folder}/part-{part:05d}-{uuid.uuid4().hex}.{ending}"


def create(uri: str):
    system, path = _place(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_stream(uri: str):
    system, path = _place(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)


def open_file(uri: str):
    system, path = _place(uri)
    return system.open_input_file(path)
