"""Writing media files of any size with many tasks: parts first, then each file from its parts.

Tasks write stretches of a file's media as parts while they read their rows, a sample at a time. Prefix sums of the
parts' sizes say where each lies and in which file, and a task a file puts header, parts and tables together in
blocks; tables are kept beside the parts and never are together in memory. A file ends before it would pass 4 GiB, and the rest of its packets goes into a further one.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.operators import timeline
from reelframe.sources import mp4, wav
from reelframe.sources.files import open_read, place_of, shared_dir

#: Bytes of a part, and of media in one file before a further one begins; with a part they stay below 4 GiB.
PART_BYTES, FILE_BYTES = 64 << 20, 3_900_000_000
_BLOCK = 8 << 20
#: Samples of a part, whose tables a task holds.
PART_SAMPLES = 1 << 18
_PLAIN = ("timescale", "rate", "channels", "width", "height")
#: Of a stream's samples in a part: how many, their time, runs of equal durations with the first and the last one, keyframes,
#: and the place of the last.
_COUNTS = ("count", "total", "runs", "first", "last", "keys", "end")
_PARTS = f"path string, span int, piece int, bytes long, part string, tracks array<struct<stream:int,codec:string,{','.join(n + ':int' for n in _PLAIN)},{','.join(n + ':long' for n in _COUNTS)}>>"
_TRACK = pa.list_(pa.struct([("stream", pa.int32()), ("codec", pa.string()), *((n, pa.int32()) for n in _PLAIN), *((n, pa.int64()) for n in _COUNTS)]))
_ARROW = pa.schema([("path", pa.string()), ("span", pa.int32()), ("piece", pa.int32()), ("bytes", pa.int64()), ("part", pa.string()), ("tracks", _TRACK)])


class _Part:
    """One part while its samples come in: a file of media, and beside it one of tables, stream by stream.

    The tables are sizes, places from the part's start, runs of durations and the numbers of keyframes.
    """

    def __init__(self, folder: str, path: str, span: int, piece: int):
        self.path, self.span, self.piece, self.bytes, self.samples = path, span, piece, 0, 0
        self.part = f"{folder}/part-{uuid.uuid4().hex}"  # a repeated task writes other parts; those of a lost one aren't named
        place, root = place_of(folder)
        place.create_dir(root, recursive=True)
        self.out = place.open_output_stream(f"{root}/{self.part.rsplit('/', 1)[1]}")
        self.tracks: dict[int, tuple[dict, tuple[array, ...]]] = {}

    def add(self, row: dict) -> None:
        data = row["data"] or b""
        if row["stream_index"] not in self.tracks:
            number = lambda name: row.get(name) or 0
            described = {"stream": row["stream_index"], "codec": row["codec_id"], "timescale": number("timescale"), "rate": number("sample_rate"), "channels": number("channels"), "width": number("width"), "height": number("height")}
            self.tracks[row["stream_index"]] = described, (array("q"), array("q"), array("q"), array("b"))
        sizes, places, durations, sync = self.tracks[row["stream_index"]][1]
        self.out.write(data)
        sizes.append(len(data))
        places.append(self.bytes)
        durations.append(1 if row.get("duration") is None else row["duration"])
        sync.append(bool(row.get("keyframe")))
        self.bytes += len(data)
        self.samples += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        place, root = place_of(f"{self.part}.tables")
        made = []
        with place.open_output_stream(root) as out:
            for described, columns in self.tracks.values():
                sizes, places, durations, sync = (np.frombuffer(c, "i1" if c.typecode == "b" else "i8") for c in columns)
                if described["codec"] in mp4.ENTRY_OF and (durations.min() < 0 or durations.max() > mp4.U32_MAX):
                    raise ValueError(f"{self.path}: a duration doesn't fit 32 bits")
                starts = np.flatnonzero(np.diff(durations, prepend=-1))
                runs = np.column_stack([np.diff(starts, append=len(durations)), durations[starts]])
                keys = np.flatnonzero(sync) + 1
                for table, form in ((sizes, ">u4"), (places, ">u8"), (runs, ">u4"), (keys, ">u4")):
                    out.write(table.astype(form).tobytes())
                numbers = (len(sizes), durations.sum(), len(runs), durations[0], durations[-1], len(keys), places[-1])
                made.append(described | {n: int(v) for n, v in zip(_COUNTS, numbers)})
        return pa.RecordBatch.from_pylist([{"path": self.path, "span": self.span, "piece": self.piece, "bytes": self.bytes, "part": self.part, "tracks": made}], schema=_ARROW)


class _Tables:
    """The tables of one stream over all parts of a file, a part at a time."""

    def __init__(self, rows: list[dict], stream: int):
        self.held, base, number = [], 0, 0  # (row, the stream there, where its tables begin, bytes and samples before)
        for r in rows:
            at = 0
            for t in r["tracks"]:
                if t["stream"] == stream:
                    self.held.append((r, t, at, base, number))
                    number += t["count"]
                at += 12 * t["count"] + 8 * t["runs"] + 4 * t["keys"]
            base += r["bytes"]
        self.count, self.total, self.keys = (sum(t[n] for _, t, *_ in self.held) for n in ("count", "total", "keys"))
        tracks = [t for _, t, *_ in self.held]
        self.runs = sum(t["runs"] for t in tracks) - sum(a["last"] == b["first"] for a, b in zip(tracks, tracks[1:]))
        self.end = self.held[-1][3] + tracks[-1]["end"]

    def _read(self, skip: Callable[[dict], int], entries: Callable[[dict], int], form: str) -> Iterator[tuple[np.ndarray, int, int]]:
        for r, t, at, base, number in self.held:
            with open_read(f"{r['part']}.tables") as f:
                f.seek(at + skip(t))
                yield np.frombuffer(f.read(entries(t) * int(form[-1])), form), base, number

    def sizes(self) -> Iterator[bytes]:
        return (x.tobytes() for x, _, _ in self._read(lambda t: 0, lambda t: t["count"], ">u4"))

    def places(self, head: int, form: str) -> Iterator[bytes]:
        return ((x.astype(np.int64) + base + head).astype(form).tobytes() for x, base, _ in self._read(lambda t: 4 * t["count"], lambda t: t["count"], ">u8"))

    def times(self) -> Iterator[bytes]:
        """Runs of equal durations; those that meet at a part's end are one."""
        open_run = np.zeros((0, 2), np.int64)
        for x, _, _ in self._read(lambda t: 12 * t["count"], lambda t: 2 * t["runs"], ">u4"):
            runs = x.astype(np.int64).reshape(-1, 2)
            if len(open_run) and open_run[0, 1] == runs[0, 1]:
                runs[0, 0] += open_run[0, 0]
                open_run = open_run[:0]
            runs = np.concatenate([open_run, runs])
            yield runs[:-1].astype(">u4").tobytes()
            open_run = runs[-1:]
        yield open_run.astype(">u4").tobytes()

    def keyframes(self) -> Iterator[bytes]:
        return ((x.astype(np.int64) + number).astype(">u4").tobytes() for x, _, number in self._read(lambda t: 12 * t["count"] + 8 * t["runs"], lambda t: t["keys"], ">u4"))

    def boxes(self, head: int) -> list:
        wide = self.end + head > mp4.U32_MAX
        made = [mp4.chunked_table(b"stts", 8, self.runs, self.times()), mp4.chunked_table(b"stsz", 4, self.count, self.sizes(), bytes(4)), mp4.CHUNK_RUNS, mp4.chunked_table(b"co64" if wide else b"stco", 8 if wide else 4, self.count, self.places(head, ">u8" if wide else ">u4"))]
        return made if self.keys == self.count else [*made, mp4.chunked_table(b"stss", 4, self.keys, self.keyframes())]


def _copy(out, path: str) -> None:
    with open_read(path) as f:
        while block := f.read(_BLOCK):
            out.write(block)


def _whole(out, rows: list[dict], kind: str) -> None:
    """One file from its parts in order."""
    size = sum(r["bytes"] for r in rows)
    described: dict[int, dict] = {}
    for r in rows:
        for t in r["tracks"]:
            described.setdefault(t["stream"], t)
    if kind == "wav":
        if list(described) != [0]:
            raise ValueError("a WAV file has one stream, numbered 0")
        out.write(wav.wav_header(described[0]["codec"], described[0]["channels"], described[0]["rate"], size))
        for r in rows:
            _copy(out, r["part"])
        out.write(b"\0" * (size % 2))
        return
    if sorted(described) != list(range(len(described))):
        raise ValueError(f"{rows[0]['path']}: streams aren't numbered from 0")
    head, tracks = mp4.media_head(size), []
    for i in range(len(described)):
        d = described[i]
        if d["codec"] not in mp4.ENTRY_OF:
            raise ValueError(f"{d['codec']} can't be written as MP4")
        tables = _Tables(rows, i)
        tracks.append(mp4.chunked_track(i + 1, mp4.Track(d["codec"], *(d[n] for n in _PLAIN)), tables.total, tables.boxes(len(head))))
    out.write(head)
    for r in rows:
        _copy(out, r["part"])
    for chunk in mp4.chunked_moov(tracks):
        out.write(chunk)


def write_media(rows: DataFrame, folder: str, kind: str, order: str = "seq", rows_per_part: int = 65_536, part_bytes: int = PART_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the packets of each ``path`` in ``order`` (a number; ties by stream) as ``wav`` or ``mp4`` files below
    ``folder``: ``(path, file_no, file string, bytes long)`` of what was written.

    ``rows`` have the columns of the format. A path is cut into stretches of about ``rows_per_part`` rows, each
    written by a task of its own in parts of at most ``part_bytes`` and a sample. The first file has the path's name;
    where its media pass ``file_bytes`` the next ones are called name-1, name-2, and so on, and their times begin anew.
    A file appears when it is whole; a repeated task replaces it. Parts stay in the shared folder.
    """
    if kind not in ("wav", "mp4"):
        raise ValueError(f"no writer for {kind!r}")
    if file_bytes + part_bytes >= 1 << 32:
        raise ValueError("a file and a part must stay below 4 GiB")
    spark = rows.sparkSession
    held = shared_dir(spark, "parts")
    columns = [c for c in ("path", "stream_index", "duration", "timescale", "codec_id", "keyframe", "sample_rate", "channels", "width", "height", "data") if c in rows.columns]
    cut = timeline.even_spans(rows.select(*columns, F.col(order).alias("__order")), "__order", rows_per_part, "__span")
    ready = cut.repartition("path", "__span").sortWithinPartitions("path", "__span", "__order", "stream_index")

    def parts(batches) -> Iterator[pa.RecordBatch]:
        now: _Part | None = None
        for batch in batches:
            names = [n for n in batch.schema.names if n != "data"]
            plain = batch.select(names).to_pylist()
            for i, row in enumerate(plain):
                if now is not None and ((row["path"], row["__span"]) != (now.path, now.span) or now.bytes >= part_bytes or now.samples >= PART_SAMPLES):
                    same, piece = (row["path"], row["__span"]) == (now.path, now.span), now.piece
                    yield now.close()
                    now = _Part(f"{held}/media", row["path"], row["__span"], piece + 1) if same else None
                if now is None:
                    now = _Part(f"{held}/media", row["path"], row["__span"], 0)
                now.add(row | {"data": batch.column("data")[i].as_py()})
        if now is not None:
            yield now.close()

    ready.mapInArrow(parts, _PARTS).write.parquet(f"{held}/parts")
    made = spark.read.parquet(f"{held}/parts")
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("path").orderBy("span", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = made.select("path", "span", "piece", "bytes", before.alias("before"))  # a row a part
    of = placed.withColumn("file_no", F.floor(F.col("before") / F.lit(file_bytes)).cast("int")).select("path", "span", "piece", "file_no")
    whole = made.join(of, ["path", "span", "piece"])

    def assemble(key, table):
        path, number = (k.as_py() for k in key)
        parts_of = sorted(table.to_pylist(), key=lambda r: (r["span"], r["piece"]))
        name = path.rsplit("/", 1)[-1]
        if number:
            stem, _, suffix = name.rpartition(".")
            name = f"{stem or suffix}-{number}" + (f".{suffix}" if stem else "")
        place, root = place_of(folder)
        place.create_dir(root, recursive=True)
        hidden = f"{root}/.{name}.{uuid.uuid4().hex}"
        with place.open_output_stream(hidden) as out:
            _whole(out, parts_of, kind)
            size = out.tell()
        place.move(hidden, f"{root}/{name}")
        return pa.table({"path": [path], "file_no": pa.array([number], pa.int32()), "file": [name], "bytes": [size]})

    # a group is one file: at most 4 GiB of media, of which this task holds a row and a part's tables at a time, and a block
    whole.groupBy("path", "file_no").applyInArrow(assemble, "path string, file_no int, file string, bytes long").write.parquet(f"{held}/files")
    return spark.read.parquet(f"{held}/files")
