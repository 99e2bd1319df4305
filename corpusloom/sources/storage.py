"""Single files and folders on shared storage, used inside tasks.

A path is plain, or has a scheme: ``file``, ``hdfs``, ``viewfs``, ``s3`` (``s3a``), ``gs``, ``abfs``
(``abfss``). Only what stands before the first slash can be a scheme, so names may hold colons.
"""

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from uuid import uuid4

import pyarrow.fs

SCHEMES = {"s3a": "s3", "s3n": "s3"}


class Entry(NamedTuple):
    """One name in a folder; ``link`` tells of a folder that is reached by a symbolic link."""

    name: str
    is_folder: bool
    size: int
    mtime_ms: int
    link: bool = False


def split(path: str) -> tuple[str, str, str]:
    """(scheme, authority, rest) of a path; the scheme of a plain path is ``file``."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?\Z", path, re.S)
    if found is None:
        return "file", "", path
    return found[1].lower(), found[2] or "", found[3] or "/"


@lru_cache(maxsize=64)
def _remote(scheme: str, authority: str) -> tuple[pyarrow.fs.FileSystem, str]:
    filesystem, base = pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{authority}/")
    return filesystem, base.rstrip("/")


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    scheme, authority, rest = split(path)
    filesystem, base = _remote(scheme, authority)
    return filesystem, base + rest


def is_local(path: str) -> bool:
    return split(path)[0] == "file"


def read_bytes(path: str) -> bytes:
    """One whole file."""
    if is_local(path):
        with open(split(path)[2], "rb") as stream:
            return stream.read()
    filesystem, place = _place(path)
    with filesystem.open_input_stream(place, compression=None) as stream:
        return stream.read()


def write_bytes(path: str, data: bytes) -> None:
    """One whole file with the folders above it; readers see all of it or nothing."""
    if is_local(path):
        target = split(path)[2]
        os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
        waiting = os.path.join(os.path.dirname(target), f".{uuid4().hex}.tmp")
        with open(waiting, "wb") as stream:
            stream.write(data)
        os.replace(waiting, target)
        return
    filesystem, place = _place(path)
    if split(path)[0] in ("hdfs", "viewfs"):  # object stores show a file when it is closed
        filesystem.create_dir(place.rsplit("/", 1)[0], recursive=True)
        waiting = f"{place.rsplit('/', 1)[0]}/.{uuid4().hex}.tmp"
        with filesystem.open_output_stream(waiting, compression=None) as stream:
            stream.write(data)
        filesystem.move(waiting, place)
        return
    with filesystem.open_output_stream(place, compression=None) as stream:
        stream.write(data)


def entry(path: str) -> Entry | None:
    """What a path names; None when there is nothing."""
    if is_local(path):
        try:
            found = os.stat(split(path)[2])
        except OSError:
            return None
        folder = os.path.isdir(split(path)[2])
        return Entry(path.rstrip("/").rsplit("/", 1)[-1], folder, 0 if folder else found.st_size, found.st_mtime_ns // 1_000_000)
    filesystem, place = _place(path)
    info = filesystem.get_file_info([place])[0]
    if info.type == pyarrow.fs.FileType.NotFound:
        return None
    return _entry(info)


def _entry(info: pyarrow.fs.FileInfo) -> Entry:
    folder = info.type == pyarrow.fs.FileType.Directory
    return Entry(info.base_name, folder, 0 if folder else info.size or 0, (info.mtime_ns or 0) // 1_000_000)


def entries(path: str) -> Iterator[Entry]:
    """The names in a folder, in no order; none for a folder that is gone or a broken link."""
    if not is_local(path):
        filesystem, place = _place(path)
        for info in filesystem.get_file_info(pyarrow.fs.FileSelector(place, recursive=False, allow_not_found=True)):
            yield _entry(info)
        return
    try:
        listed = os.scandir(split(path)[2])
    except FileNotFoundError:
        return
    with listed:
        for item in listed:
            try:
                folder, found = item.is_dir(), item.stat()
            except OSError:  # a broken link, or gone since
                continue
            yield Entry(item.name, folder, 0 if folder else found.st_size, found.st_mtime_ns // 1_000_000, folder and item.is_symlink())


def leads_back(path: str) -> bool:
    """Whether a folder that is a link holds itself, so that a walk would not end."""
    place = split(path)[2].rstrip("/")
    real = os.path.realpath(place)
    above = os.path.realpath(os.path.dirname(place))
    return above == real or above.startswith(real.rstrip("/") + "/")
