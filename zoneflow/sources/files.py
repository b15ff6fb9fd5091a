"""Byte access for data sources that run in Python workers, on every file system that Arrow reaches (local, HDFS, object stores)."""

from __future__ import annotations

import sys

from pyarrow import fs
from pyspark import cloudpickle

# Data sources travel to the workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, ending: str) -> list[str]:
    """The file, or the visible files of a folder, with that ending (in any case), by name."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return sorted(p for p in found if p.lower().endswith(ending) and not p.rsplit("/", 1)[-1].startswith(("_", ".")))


def range_of(path_of: str, path: str, start: int, size: int) -> bytes:
    """Bytes of a file; fewer than asked for are an error. `path_of` tells the file system."""
    with located(path_of)[0].open_input_file(path) as file:
        file.seek(start)
        data = file.read(size)
    if len(data) < size:
        raise ValueError(f"{path} ends early: {len(data)} of {size} bytes at {start}")
    return data


def write_whole(path_of: str, path: str, data: bytes) -> None:
    system = located(path_of)[0]
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as file:
        file.write(data)


def publish(path_of: str, staged: list[str], folder: str) -> None:
    """Moves files that tasks have written below `_staging` into the folder; what failed attempts left there goes."""
    system = located(path_of)[0]
    system.create_dir(folder, recursive=True)
    for name in staged:
        system.move(name, f"{folder}/{name.rsplit('/', 1)[-1]}")
    if system.get_file_info(f"{folder}/_staging").type == fs.FileType.Directory:
        system.delete_dir(f"{folder}/_staging")


def withdraw(path_of: str, folder: str) -> None:
    system = located(path_of)[0]
    if system.get_file_info(f"{folder}/_staging").type == fs.FileType.Directory:
        system.delete_dir(f"{folder}/_staging")
