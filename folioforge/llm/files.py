"""Files that executors write to and read from the shared folder, with atomic commit."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of the shared folder (file, hdfs, s3 or gs)."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A file that appears under its name only when it is whole; a retried task replaces it by the same bytes."""
    system, path = resolve(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(temporary, compression=None) as out:
            yield out
    except BaseException:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)
        raise
    if system.get_file_info(path).type != fs.FileType.NotFound and system.type_name != "local":
        system.delete_file(path)
    system.move(temporary, path)


@contextmanager
def reading(uri: str):
    system, path = resolve(uri)
    with system.open_input_file(path) as file:
        yield file
