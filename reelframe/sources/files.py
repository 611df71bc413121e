"""Files by URI from tasks, local or in any store Arrow knows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def list_files(uri: str, suffix: str) -> list[str]:
    """Files below ``uri`` that end in ``suffix``, or the file itself; hidden ones are passed over."""
    return [path for path, _ in list_sizes(uri, suffix)]


def list_sizes(uri: str, suffix: str) -> list[tuple[str, int]]:
    """`list_files` with the bytes of each; nothing is opened."""
    place, path = place_of(uri)
    scheme = "" if isinstance(place, fs.LocalFileSystem) else uri.split("://")[0] + "://"
    info = place.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    found = place.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_")))


def deal(items: Iterable[tuple], most: int) -> Iterator[list]:
    """``(item, cost)`` in lists of neighbours that cost ``most`` together, or of one item that costs more."""
    held, total = [], 0
    for item, cost in items:
        if held and total + cost > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += cost
    if held:
        yield held


def open_read(uri: str):
    place, path = place_of(uri)
    return place.open_input_file(path)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write a file whole: a repeated task replaces it."""
    place, root = place_of(folder)
    place.create_dir(root, recursive=True)
    hidden = f"{root}/.{name}.{os.getpid()}.{uuid.uuid4().hex}"
    with place.open_output_stream(hidden) as out:
        out.write(content)
    place.move(hidden, f"{root}/{name}")


def shared_dir(spark, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where none is set, on the local disk of a single machine.

    On a cluster a folder must be named: what one executor wrote on its own disk no other could read.
    """
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reelframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
