"""``spark.readStream.format("rawstream")``: growing files of an elementary stream as pieces, for `stateful.frame_stream`.

The offset is how many bytes of each file have been taken, so a query that starts again goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from reelframe.sources.files import deal, list_sizes, open_read

SCHEMA = "path string, seq long, data binary, eos boolean"
#: Bytes that a task reads, and that opening a file counts as.
TASK_BYTES, OPEN_BYTES = 64 << 20, 256 << 10


@dataclass
class Pieces(InputPartition):
    """What a task reads: ``(path, start, stop, eos)`` each."""

    pieces: list


class RawStreamReader(DataSourceStreamReader):
    """Files that end in ``suffix`` below ``path``, in pieces of ``bytesPerPartition``; ``seq`` is a piece's place. A task
    reads pieces of `TASK_BYTES` together, each file counting `OPEN_BYTES` more, so small files share tasks.

    A file has ended when one of its name and ``endSuffix`` stands beside it: its last piece, or an empty one if all
    had been taken, says so. What is appended to a file after that is a new stream under the same path.
    """

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".raw")
        self.end = options.get("endSuffix", ".end")
        self.step = int(options.get("bytesPerPartition", 4 << 20))

    def initialOffset(self) -> dict:
        return {"taken": {}, "ended": []}

    def latestOffset(self) -> dict:
        ended = {p[: -len(self.end)] for p, _ in list_sizes(self.path, self.suffix + self.end)}
        taken = dict(list_sizes(self.path, self.suffix))  # listed after the marks: a file that has one is whole
        return {"taken": taken, "ended": sorted(ended & set(taken))}

    def partitions(self, start: dict, end: dict) -> list[Pieces]:
        return [Pieces(pieces) for pieces in deal(self._pieces(start, end), TASK_BYTES)]

    def _pieces(self, start: dict, end: dict) -> Iterator[tuple]:
        """New pieces and what each costs to read."""
        before, ended = set(start["ended"]), set(end["ended"])
        for path, stop in sorted(end["taken"].items()):
            first, ends = start["taken"].get(path, 0), path in ended and path not in before
            cuts = [*range(first, stop, self.step), stop]
            for a, b in zip(cuts, cuts[1:]):
                yield (path, a, b, ends and b == stop), b - a + (OPEN_BYTES if a == first else 0)
            if ends and first == stop:
                yield (path, stop, stop, True), OPEN_BYTES

    def read(self, partition: Pieces) -> Iterator[tuple]:
        for path, pieces in groupby(partition.pieces, key=lambda p: p[0]):
            with open_read(path) as f:
                for _, start, stop, eos in pieces:
                    f.seek(start)
                    yield path, start, f.read(stop - start), eos

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class RawStreamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawstream"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RawStreamReader:
        return RawStreamReader(self.options)
