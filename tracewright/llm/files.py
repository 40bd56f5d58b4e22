"""Plain files in the shared folder, opened by executors."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri)


def fresh(folder: str, stem: str, suffix: str) -> str:
    """A path that no other attempt of a task uses; a file counts once a manifest names it."""
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def make_folder(folder: str) -> None:
    f, path = opened(folder)
    f.create_dir(path, recursive=True)
