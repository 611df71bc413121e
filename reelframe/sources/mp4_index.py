"""MP4 files by way of an index: one pass parses the tables of every file, then packets are read by time or place.

The index is a table like any other, a row a stretch of samples: it can be written, filtered and joined, and reading
from it opens only what is read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.errors import FAIL, SKIP
from reelframe.operators.seek import ANY, BACKWARD, BYTE
from reelframe.sources.files import deal, list_sizes, open_read, place_of
from reelframe.sources.mp4 import OPEN_BYTES, ROWS_AT_ONCE, SCHEMA, TASK_BYTES, Bounds, Samples, Track, file_samples, read_batches

INDEX = "path string, stream_index int, first long, samples int, pts long, last_pts long, low long, high long, key_before long, timescale int, codec_id string, sample_rate int, channels int, width int, height int, offsets array<long>, sizes array<long>, durations array<long>, keyframes array<int>"
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
_ARROW = pa.schema([(c.split(" ")[0], _KINDS[c.split(" ")[1]]) for c in INDEX.split(", ")])
_PLAIN = ["path", "stream_index", "first", "samples", "pts", "last_pts", "low", "high"]
_ARRAYS = ["offsets", "sizes", "durations"]
_KEYS = ["path", "stream_index"]


def index_files(spark: SparkSession, path: str, samples: int = 16384, errors: str = FAIL) -> DataFrame:
    """A row for each stretch of at most ``samples`` samples of every track of the ``.mp4`` files below ``path``.

    One task lists the files, and their names never are on the driver; each file is opened by one task, small ones
    together, which parses its tables once and reads none of its media.
    ``key_before`` is the last keyframe before the stretch. A file that can't be parsed is an error or left out.
    Write the index before reading by it, else its tables are parsed again.
    """

    def names(_):
        place, root = place_of(path)
        if place.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = list_sizes(path, ".mp4")
        for a in range(0, len(found), ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[a : a + ROWS_AT_ONCE]), (pa.string(), pa.int64()))], names=["path", "size"])

    def parse(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with open_read(name) as f:
                        key, stream = -1, -1
                        for s in file_samples(f, name, f.size(), samples * max(1, ROWS_AT_ONCE // samples)):
                            key, stream = (key, stream) if s.stream == stream else (-1, s.stream)
                            yield from _rows_of(_stretches(s, samples, key))
                            key = max(key, int(np.where(s.sync, s.seq, -1).max(initial=-1)))
                except (ValueError, struct.error):
                    if errors == SKIP:
                        continue
                    raise

    if any(c in path for c in "*?[{"):  # patterns are Spark's
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true").load(path)
        return listed.select(F.regexp_replace("path", "^file:/+", "/").alias("path")).mapInArrow(parse, INDEX)
    listed = spark.range(1, numPartitions=1).mapInArrow(names, "path string, size long")
    count, size = listed.agg(F.count("*"), F.sum("size")).first()
    tasks = min(count, -(-((size or 0) + count * OPEN_BYTES) // TASK_BYTES))
    return listed.select("path").repartition(max(1, tasks)).mapInArrow(parse, INDEX)


def _rows_of(stretches: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    for rows in deal(((r, r["samples"]) for r in stretches), 8 * ROWS_AT_ONCE):
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _stretches(s: Samples, step: int, key: int = -1) -> Iterator[dict]:
    """Rows of the index; ``key`` is the last keyframe before the samples."""
    t, keys = s.track, np.where(s.sync, s.seq, -1)
    before = np.maximum.accumulate(np.concatenate([[key], keys]))
    for a in range(0, len(s.seq), step):
        part = s.where(slice(a, a + step))
        yield {
            "path": s.path, "stream_index": s.stream, "first": int(part.seq[0]), "samples": len(part.seq), "pts": int(part.pts[0]), "last_pts": int(part.pts[-1]), "low": int(part.offsets.min()), "high": int((part.offsets + part.sizes).max()),
            "key_before": int(before[a]) if before[a] >= 0 else None, "timescale": t.timescale, "codec_id": t.codec, "sample_rate": t.rate, "channels": t.channels, "width": t.width, "height": t.height,
            "offsets": part.offsets, "sizes": part.sizes, "durations": part.durations, "keyframes": np.flatnonzero(part.sync),
        }


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of an index whose lists are arrays."""
    for i in range(batch.num_rows):
        yield {name: (column[i].values.to_numpy() if pa.types.is_list(column.type) else column[i].as_py()) for name, column in zip(batch.schema.names, batch.columns)}


def _samples(row: dict) -> Samples:
    """The stretch of an index row; lists are its arrays."""
    offsets, sizes, durations = (np.asarray(row[c], np.int64) for c in _ARRAYS)
    sync = np.zeros(len(offsets), bool)
    sync[np.asarray(row["keyframes"], np.int64)] = True
    track = Track(row["codec_id"], row["timescale"], row["sample_rate"], row["channels"], row["width"], row["height"])
    return Samples(row["path"], row["stream_index"], track, row["first"] + np.arange(len(offsets)), row["pts"] + np.cumsum(durations) - durations, offsets, sizes, durations, sync)


def starts(index: DataFrame, since: float, flag: str = BACKWARD) -> DataFrame:
    """``(path, stream_index, start)``: the packet of each stream that reading from ``since`` begins with.

    ``since`` are seconds, with ``BYTE`` a byte of the file. A time before a stream's first packet finds it. A stream
    without such a packet, keyframe or byte has no row. One stretch a stream is looked into.
    """
    if flag not in (BACKWARD, ANY, BYTE):
        raise ValueError(f"unknown seek flag {flag!r}")
    at = F.lit(int(since)).cast("long") if flag == BYTE else F.floor(F.lit(float(since)) * F.col("timescale"))
    here = F.col("low") <= F.col("at") if flag == BYTE else (F.col("pts") <= F.col("at")) | (F.col("first") == 0)
    held = F.struct(*index.columns, "at")
    target = index.withColumn("at", at).where(here).groupBy(*_KEYS).agg(F.max_by(held, "first").alias("t")).select("t.*")

    def find(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                s = _samples(row)
                if flag == BYTE:
                    i = int(np.flatnonzero(s.offsets <= row["at"])[-1])
                else:
                    i = max(0, int(np.searchsorted(s.pts, row["at"], side="right")) - 1)
                start = int(s.seq[i])
                if flag == BACKWARD:
                    keys = s.seq[: i + 1][s.sync[: i + 1]]
                    start = int(keys[-1]) if len(keys) else row["key_before"]
                if start is not None:
                    found.append((row["path"], row["stream_index"], start))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 3, (pa.string(), pa.int32(), pa.int64()))], names=[*_KEYS, "start"])

    return target.mapInArrow(find, "path string, stream_index int, start long")


def read_packets(index: DataFrame, since: float | None = None, until: float | None = None, flag: str = BACKWARD, payload: bool = True, bytes_per_task: int = 128 << 20) -> DataFrame:
    """Packets (columns of ``format("mp4")``) of the index's streams from ``since`` (see `starts`) to before ``until``.

    Conditions on the index, such as ``index.where("stream_index = 0")``, choose streams and files. Only stretches in
    reach are read, in each only the bytes of the packets returned, by as many tasks as these bytes ask for.
    """
    plan = index.withColumn("start", F.lit(0).cast("long"))
    if since is not None:
        plan = index.join(starts(index, since, flag), _KEYS).where("first + samples > start")
    stop = F.lit(1 << 62) if until is None else F.lit(int(until)) if flag == BYTE else F.ceil(F.lit(float(until)) * F.col("timescale"))
    plan = plan.withColumn("stop", stop.cast("long")).where(F.col("low" if flag == BYTE else "pts") < F.col("stop"))
    media = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x) if payload else F.lit(0)
    size = plan.agg(F.sum(media + F.col("samples") * 64)).first()[0] or 0  # a packet costs something besides its bytes

    def read(batches):
        for batch in batches:
            for row in _rows(batch):
                s = _samples(row)
                s = s.where((s.seq >= row["start"]) & ((s.offsets if flag == BYTE else s.pts) < row["stop"]))
                with open_read(row["path"]) as f:
                    yield from read_batches(f, s, payload)

    return plan.repartition(max(1, -(-size // bytes_per_task)), *_KEYS, "first").mapInArrow(read, SCHEMA)


def _dataset(folder: str):
    import pyarrow.dataset as ds

    place, root = place_of(folder)
    return ds.dataset(root, filesystem=place, format="parquet")


def _in_reach(rows: pa.Table | pa.RecordBatch, bounds: Bounds) -> np.ndarray:
    """Which rows of the index may hold something wanted, by the plain columns."""
    first, samples, stream, pts, last, low, high = (rows.column(c).to_numpy() for c in ("first", "samples", "stream_index", "pts", "last_pts", "low", "high"))
    keep = bounds.overlap(seq=(first, first + samples - 1), pts=(pts, last), stream_index=(stream, stream), pos=(low, high))
    return keep if bounds.paths is None else keep & np.array([bounds.has_path(p) for p in rows.column("path").to_pylist()], bool)


def plan_stretches(folder: str, bounds: Bounds, bytes_per_task: int) -> list[list[tuple]]:
    """What tasks look at: rows of the index as ``(its file, row group, first row, row after the last)``, cut so that they
    stand for ``bytes_per_task`` of media, a media file counting `OPEN_BYTES` more.

    Only the plain columns are read, a row group at a time, and nothing is kept of a row; tasks ask again which rows are
    in reach.
    """

    def ranges(fragment) -> list[tuple]:
        found = []
        for group in fragment.split_by_row_group():
            rows = group.to_table(columns=_PLAIN, use_threads=False)
            kept = np.flatnonzero(_in_reach(rows, bounds))
            if len(kept):
                files = rows.column("path").combine_chunks().dictionary_encode().indices.to_numpy()[kept]
                cost = (rows.column("high").to_numpy() - rows.column("low").to_numpy())[kept] + np.where(np.diff(files, prepend=-1) != 0, OPEN_BYTES, 0)
                cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(cost) // bytes_per_task)) + 1).tolist(), len(kept)]
                found += [((fragment.path, group.row_groups[0].id, int(kept[a]), int(kept[b - 1]) + 1), int(cost[a:b].sum())) for a, b in zip(cuts, cuts[1:])]
        return found

    with ThreadPoolExecutor(8) as pool:
        return list(deal(chain.from_iterable(pool.map(ranges, _dataset(folder).get_fragments())), bytes_per_task))


def load_stretches(folder: str, ranges: list[tuple], bounds: Bounds) -> Iterator[Samples]:
    """The stretches in reach of what `plan_stretches` gave a task, a few at a time."""
    import pyarrow.parquet as pq

    place, _ = place_of(folder)
    for file, group, start, stop in ranges:
        with place.open_input_file(file) as f:
            at = 0
            for batch in pq.ParquetFile(f, pre_buffer=False, buffer_size=1 << 20).iter_batches(batch_size=64, row_groups=[group]):
                part = batch.slice(max(0, start - at), max(0, min(batch.num_rows, stop - at) - max(0, start - at)))
                if part.num_rows:
                    for row in _rows(part.filter(pa.array(_in_reach(part, bounds)))):
                        yield _samples(row)
                at += batch.num_rows
                if at >= stop:
                    break
