"""Files by byte ranges: a task seeks and reads what it needs, whatever the size of a file."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote

from pyarrow import fs


def _at(path: str):
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def opened(path: str):
    """A file to read at any place: read_at(bytes, offset)."""
    system, at = _at(path)
    return system.open_input_file(at)


def listed(path: str) -> list[tuple[str, int]]:
    """Files under a path, deep, with their sizes, in order; a file is itself."""
    system, at = _at(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ("file://" if path.startswith("file:") else "")
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not posixpath.basename(f.path).startswith((".", "_")))


def put(path: str, data: bytes) -> None:
    """Write a file under a name of its own, then move it to its place: a task that runs again replaces it whole."""
    import uuid

    system, at = _at(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    part = f"{posixpath.dirname(at)}/_{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, at)
