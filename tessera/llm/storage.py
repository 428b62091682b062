"""Files that tasks write themselves (archives, shards): on any file system that the shared folder's URI names."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(uri: str) -> BinaryIO:
    """A new file to write, its folder made where the file system has folders."""
    system, path = opened(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def read_at(uri: str) -> BinaryIO:
    """A file for range reads."""
    system, path = opened(uri)
    return system.open_input_file(path)


def rename(uri: str, to: str) -> None:
    """Gives a whole file its name; one that is there already (from another attempt, with equal content) is replaced."""
    system, path = opened(uri)
    system.move(path, opened(to)[1])
