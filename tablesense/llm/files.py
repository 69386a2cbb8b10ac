"""Files in the shared folder, for Python code on executors: a path or any URI that pyarrow's file systems know."""

from __future__ import annotations

import os
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyarrow import fs


def local_path(uri: str) -> str | None:
    """The path, where ``uri`` is one of this machine's file system."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    local = local_path(uri)
    return (fs.LocalFileSystem(), local) if local is not None else fs.FileSystem.from_uri(uri)


def open_for_writing(uri: str):
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_for_reading(uri: str):
    system, path = _place(uri)
    return system.open_input_stream(path, compression=None)


def read_bytes(uri: str) -> bytes:
    with open_for_reading(uri) as f:
        return f.read()


def move(source: str, target: str) -> None:
    """Renames; an earlier file of that name, as of a task that ran twice, is replaced."""
    local = local_path(source)
    if local is not None:
        os.replace(local, local_path(target))
        return
    system, path = _place(source)
    _, to = _place(target)
    if system.get_file_info(to).type != fs.FileType.NotFound:
        system.delete_file(to)
    system.move(path, to)


def exists(uri: str) -> bool:
    local = local_path(uri)
    if local is not None:
        return Path(local).exists()
    system, path = _place(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound
