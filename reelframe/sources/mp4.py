"""MP4 files: boxes, tracks and samples as rows; ``format("mp4")`` reads packets and writes files from them."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from reelframe.sources.files import deal, list_sizes, open_read, put_file

# Boxes that hold boxes, codecs by sample entry, sample entry by codec.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf")
CODEC_OF = {b"avc1": "h264", b"avc3": "h264", b"hev1": "hevc", b"hvc1": "hevc", b"vp09": "vp9", b"av01": "av1", b"mp4a": "aac", b"Opus": "opus", b"fLaC": "flac"}
ENTRY_OF = {"h264": b"avc1", "hevc": b"hev1", "vp9": b"vp09", "av1": b"av01", "aac": b"mp4a", "opus": b"Opus", "flac": b"fLaC"}
VIDEO = ("h264", "hevc", "vp9", "av1")
U32_MAX = 0xFFFFFFFF
SCHEMA = "path string, stream_index int, seq long, pts long, dts long, duration long, timescale int, codec_id string, keyframe boolean, pos long, sample_rate int, channels int, width int, height int, data binary"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes that opening a file counts as where files are dealt to tasks, bytes of a task, and rows and bytes of small batches that are joined.
OPEN_BYTES, TASK_BYTES, ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 256 << 20, 16384, 4 << 20
#: Bytes of tables that are parsed as a whole.
MOOV_BYTES = 16 << 20
#: Whole numbers of a packet that a pushed condition may bound.
RANGES = ("stream_index", "seq", "pts", "dts", "pos")


def walk_boxes(data: bytes, start: int = 0, stop: int | None = None, depth: int = 0, parent: str = "") -> Iterator[tuple]:
    """(depth, parent, type, offset, size, payload_offset, payload_size) of every box, parents first.

    A size of 1 is followed by a 64-bit one, 0 reaches to the end. A box that says it is longer than what holds
    it ends there.
    """
    stop = len(data) if stop is None else stop
    while start + 8 <= stop:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= stop:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head:
            return
        end = min(start + size, stop)
        name = kind.decode("latin-1")
        yield depth, parent, name, start, size, start + head, max(0, size - head)
        if kind in CONTAINERS:
            yield from walk_boxes(data, start + head, end, depth + 1, name)
        start = end


def boxes(files: DataFrame, key: str, data: str) -> DataFrame:
    """All boxes of each row's bytes; null bytes have none."""
    schema = files.select(key).schema
    for n, t in (("box_no", "integer"), ("depth", "integer"), ("parent", "string"), ("box_type", "string"), ("offset", "long"), ("size", "long"), ("payload_offset", "long"), ("payload_size", "long")):
        schema = schema.add(n, t)

    def run(batches):
        for batch in batches:
            rows = [(k, i, *b) for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, b in enumerate(walk_boxes(raw or b""))]
            cols = list(zip(*rows)) or [[]] * 9
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=schema.names)

    return files.select(key, data).mapInArrow(run, schema)


def sample_rows(files: DataFrame, key: str, data: str) -> DataFrame:
    """``(key, stream_index, seq, pts, duration, pos, size, keyframe)`` of the samples that each row's bytes, a ``moov``
    box or a whole file, describe. Bytes without a track, and null, have none."""
    schema = files.select(key).schema
    for n, t in (("stream_index", "integer"), ("seq", "long"), ("pts", "long"), ("duration", "long"), ("pos", "long"), ("size", "long"), ("keyframe", "boolean")):
        schema = schema.add(n, t)

    def run(batches):
        for batch in batches:
            for k, raw in zip(batch.column(0), batch.column(1).to_pylist()):
                try:
                    tracks = read_tracks(raw or b"")
                except ValueError:
                    continue
                for i, t in enumerate(tracks):
                    s = track_samples("", i, t)
                    n = len(s.seq)
                    keys = pa.array([k.as_py()] * n, k.type)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, i), pa.int32()), *(pa.array(x, pa.int64()) for x in (s.seq, s.pts, s.durations, s.offsets, s.sizes)), pa.array(s.sync)], names=schema.names)

    return files.select(key, data).mapInArrow(run, schema)


@dataclass
class Track:
    codec: str
    timescale: int
    rate: int = 0
    channels: int = 0
    width: int = 0
    height: int = 0
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    durations: list[int] = field(default_factory=list)
    sync: list[bool] = field(default_factory=list)


def _entries(data: bytes, at: int, size: int, form: str) -> list[tuple]:
    """Counted table entries after version and flags; the count is held to what the box can hold."""
    step = struct.calcsize(">" + form)
    count = min(struct.unpack_from(">I", data, at + 4)[0], max(0, size - 8) // step)
    return list(struct.iter_unpack(">" + form, data[at + 8 : at + 8 + count * step]))


def _held(counts: np.ndarray, n: int) -> np.ndarray:
    """Which entry each of ``n`` places falls under if the entries hold so many; one past the last where none does.
    Counts from a file may be any number, so they are never laid out."""
    return np.searchsorted(np.cumsum(np.minimum(counts, n)), np.arange(n), side="right")


def _table_of(data: bytes, at: int, size: int, columns: int, form: str = ">u4") -> np.ndarray:
    return np.array(_entries(data, at, size, ("Q" if form == ">u8" else "I") * columns), np.int64).reshape(-1, columns)


def described(data: bytes, tables: dict[str, tuple[int, int]]) -> Track:
    """A track without its samples."""
    at, _ = tables["mdhd"]
    timescale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    handler = data[tables["hdlr"][0] + 8 : tables["hdlr"][0] + 12]
    at = tables["stsd"][0] + 8
    entry = data[at + 4 : at + 8]
    track = Track(CODEC_OF[entry], timescale)
    if handler == b"soun":
        track.channels = struct.unpack_from(">H", data, at + 24)[0] or 2
        track.rate = struct.unpack_from(">I", data, at + 32)[0] >> 16 or timescale
    else:
        track.width, track.height = struct.unpack_from(">HH", data, at + 32)
    return track


def parse_track(data: bytes, tables: dict[str, tuple[int, int]], file_size: int | None = None) -> Track:
    """One track from the places of its boxes, its sample tables as arrays. A missing table or an unknown codec is an
    error.

    A run of chunks holds from its first chunk on until a later entry says otherwise; chunks before the first run,
    and all where there is no run, hold one sample. Samples beyond the last chunk's lie at the first chunk (without
    runs: at the last). Of samples of one size there are no more than the file has room for.
    """
    track = described(data, tables)
    at, size = tables["stsz"]
    same, count = struct.unpack_from(">II", data, at + 4)
    if same:
        sizes = np.full(min(count, (len(data) if file_size is None else file_size) // same), same, np.int64)
    else:
        sizes = np.frombuffer(data, ">u4", min(count, max(0, size - 12) // 4), at + 12).astype(np.int64)
    n = len(sizes)
    chunks = (_table_of(data, *tables["co64"], 1, ">u8") if "co64" in tables else _table_of(data, *tables["stco"], 1)).ravel()
    times = _table_of(data, *tables["stts"], 2)
    times = times[times[:, 0] > 0]
    of = _held(times[:, 0], n) if len(times) else np.zeros(n, np.int64)
    track.durations = times[np.minimum(of, len(times) - 1), 1] if len(times) else np.ones(n, np.int64)
    before = np.concatenate([[0], np.cumsum(sizes)])
    runs = _table_of(data, *tables["stsc"], 3)
    if len(runs) and len(chunks):
        marks, starts = np.zeros(len(chunks), np.int64), np.maximum(runs[:, 0] - 1, 0)
        here = np.flatnonzero(starts < len(chunks))
        np.maximum.at(marks, starts[here], here + 1)  # of a chunk the last entry in the table's order that begins at or before it
        per_chunk = np.append(1, runs[:, 1])[np.maximum.accumulate(marks)]
        chunk = _held(per_chunk, n)
        opens = np.concatenate([[0], np.cumsum(np.minimum(per_chunk, n))])
        inside = before[:-1] - before[np.minimum(opens[np.minimum(chunk, len(chunks))], n)]
        track.offsets = np.where(chunk < len(chunks), chunks[np.minimum(chunk, len(chunks) - 1)] + inside, chunks[0])
    else:
        track.offsets = chunks[np.minimum(np.arange(n), len(chunks) - 1)] if len(chunks) else np.zeros(n, np.int64)
    track.sizes, track.sync = sizes, np.ones(n, bool)
    if "stss" in tables:
        listed = _table_of(data, *tables["stss"], 1).ravel() - 1
        track.sync = np.zeros(n, bool)
        track.sync[listed[(listed >= 0) & (listed < n)]] = True
    return track


def read_tracks(data: bytes, file_size: int | None = None) -> list[Track]:
    """Tracks of a ``moov`` box or a whole file; one that doesn't parse is left out, none at all is an error."""
    found: list[dict[str, tuple[int, int]]] = []
    for _, _, kind, _, _, at, size in walk_boxes(data):
        if kind == "trak":
            found.append({})
        elif found:
            found[-1].setdefault(kind, (at, size))
    tracks = []
    for tables in found:
        try:
            tracks.append(parse_track(data, tables, file_size))
        except (KeyError, struct.error, IndexError):
            continue
    if not tracks:
        raise ValueError("no track")
    return tracks


def find_moov(f) -> bytes:
    """The ``moov`` box of an open file, without reading the media before or after it."""
    at, size = moov_place(f)
    f.seek(at)
    return f.read(size) if size else f.read()


def moov_place(f) -> tuple[int, int]:
    """Where the ``moov`` box of an open file lies and its size; 0: it reaches to the end."""
    at = 0
    while True:
        f.seek(at)
        head = f.read(16)
        if len(head) < 8:
            raise ValueError("no moov box")
        size, kind = struct.unpack_from(">I4s", head)
        if size == 1:
            size = struct.unpack_from(">Q", head, 8)[0]
        if kind == b"moov":
            return at, size
        if size < 8:
            raise ValueError("no moov box")
        at += size


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: bytes, form: str, rows: list[tuple]) -> bytes:
    return full_box(kind, struct.pack(">I", len(rows)), *(struct.pack(">" + form, *r) for r in rows))


def duration_runs(durations: list[int]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for d in durations:
        if runs and runs[-1][1] == d:
            runs[-1][0] += 1
        else:
            runs.append([1, d])
    return [tuple(r) for r in runs]


def chunked_box(kind: bytes, *parts: bytes | tuple[int, Iterable[bytes]]) -> tuple[int, Iterator[bytes]]:
    """A box as its size and its bytes in chunks; a part is bytes or such a pair."""
    size = 8 + sum(len(p) if isinstance(p, bytes) else p[0] for p in parts)
    wide = size > U32_MAX

    def chunks():
        yield struct.pack(">I4sQ", 1, kind, size + 8) if wide else struct.pack(">I4s", size, kind)
        for p in parts:
            yield from (p,) if isinstance(p, bytes) else p[1]

    return size + 8 * wide, chunks()


def chunked_table(kind: bytes, width: int, count: int, chunks: Iterable[bytes], before: bytes = b"") -> tuple[int, Iterator[bytes]]:
    """A counted table of ``count`` entries of ``width`` bytes that come in chunks."""
    return chunked_box(kind, struct.pack(">I", 0) + before + struct.pack(">I", count), (width * count, chunks))


def chunked_track(number: int, t: Track, total: int, tables: list) -> tuple[int, Iterator[bytes]]:
    """The ``trak`` box; ``tables`` are those of times, sizes, chunks, places and keyframes, bytes or chunked."""
    video = t.codec in VIDEO
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    tkhd = full_box(b"tkhd", struct.pack(">5I8xhhHH", 0, 0, number, 0, total & U32_MAX, 0, 0, 0 if video else 0x100, 0), matrix, struct.pack(">II", t.width << 16, t.height << 16), flags=3)
    mdhd = full_box(b"mdhd", struct.pack(">4IHH", 0, 0, t.timescale, total & U32_MAX, 0x55C4, 0))
    hdlr = full_box(b"hdlr", struct.pack(">I4s12x", 0, b"vide" if video else b"soun"), b"\0")
    if video:
        entry = box(ENTRY_OF[t.codec], struct.pack(">6xH16xHHII4xH32xHh", 1, t.width, t.height, 0x480000, 0x480000, 1, 24, -1))
    else:
        entry = box(ENTRY_OF[t.codec], struct.pack(">6xH8xHH4xI", 1, t.channels, 16, (t.rate & 0xFFFF) << 16))
    dinf = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
    stbl = chunked_box(b"stbl", full_box(b"stsd", struct.pack(">I", 1), entry), *tables)
    return chunked_box(b"trak", tkhd, chunked_box(b"mdia", mdhd, hdlr, chunked_box(b"minf", dinf, stbl)))


#: Every chunk holds one sample.
CHUNK_RUNS = _table(b"stsc", "III", [(1, 1, 1)])


def _tables_of(t: Track) -> list[bytes]:
    wide = any(o > U32_MAX for o in t.offsets)
    tables = [_table(b"stts", "II", duration_runs(t.durations)), full_box(b"stsz", struct.pack(">II", 0, len(t.sizes)), struct.pack(f">{len(t.sizes)}I", *t.sizes)), CHUNK_RUNS, _table(b"co64" if wide else b"stco", "Q" if wide else "I", [(o,) for o in t.offsets])]
    if not all(t.sync):
        tables.append(_table(b"stss", "I", [(i + 1,) for i, s in enumerate(t.sync) if s]))
    return tables


def media_head(size: int) -> bytes:
    """What stands before ``size`` bytes of media."""
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2mp41")
    return ftyp + (struct.pack(">I4sQ", 1, b"mdat", size + 16) if size + 8 > U32_MAX else struct.pack(">I4s", size + 8, b"mdat"))


def chunked_moov(tracks: list[tuple[int, Iterator[bytes]]]) -> Iterator[bytes]:
    """What stands after the media: the ``moov`` box with these ``trak`` boxes, in chunks."""
    mvhd = full_box(b"mvhd", struct.pack(">4II H10x", 0, 0, 1000, 0, 0x10000, 0x100), struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000), bytes(24), struct.pack(">I", len(tracks) + 1))
    return chunked_box(b"moov", mvhd, *tracks)[1]


def mp4_frame(tracks: list[Track], size: int) -> tuple[bytes, bytes]:
    """What stands before and after ``size`` bytes of media; offsets of the tracks count from the start of the media and
    are moved to its place."""
    head = media_head(size)
    for t in tracks:
        t.offsets = [o + len(head) for o in t.offsets]
    return head, b"".join(chunked_moov([chunked_track(i + 1, t, sum(t.durations), _tables_of(t)) for i, t in enumerate(tracks)]))


def mp4_bytes(tracks: list[Track], media: list[bytes]) -> bytes:
    """A whole file."""
    head, tables = mp4_frame(tracks, sum(map(len, media)))
    return b"".join((head, *media, tables))


@dataclass
class Samples:
    """Some samples of one track of one file, by their places in the track."""

    path: str
    stream: int
    track: Track
    seq: np.ndarray
    pts: np.ndarray
    offsets: np.ndarray
    sizes: np.ndarray
    durations: np.ndarray
    sync: np.ndarray

    def where(self, keep: np.ndarray) -> Samples:
        return Samples(self.path, self.stream, self.track, *(x[keep] for x in (self.seq, self.pts, self.offsets, self.sizes, self.durations, self.sync)))


def track_samples(path: str, stream: int, t: Track) -> Samples:
    n = len(t.sizes)
    return Samples(path, stream, t, np.arange(n), np.cumsum(t.durations) - t.durations, t.offsets, t.sizes, t.durations, t.sync)


class _Entries:
    """Entries of a table in an open file, read by their places; the count is held to what the box can hold."""

    def __init__(self, f, at: int, size: int, columns: int = 1, form: str = ">u4", head: int = 4):
        self.f, self.at, self.columns, self.form = f, at + head + 4, columns, form
        self.width = columns * int(form[-1])
        f.seek(at + head)
        self.count = min(struct.unpack(">I", f.read(4))[0], max(0, size - head - 4) // self.width)

    def get(self, a: int, b: int) -> np.ndarray:
        self.f.seek(self.at + a * self.width)
        return np.frombuffer(self.f.read((b - a) * self.width), self.form).astype(np.int64).reshape(-1, self.columns)


class _Laid:
    """Values that each hold for a number of places, laid out a block of places at a time."""

    def __init__(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], beyond: np.ndarray):
        self.blocks, self.beyond = blocks, beyond
        self.counts, self.values = np.zeros(0, np.int64), np.zeros((0, len(beyond)), np.int64)

    def take(self, n: int) -> np.ndarray:
        out = []
        while n:
            if not len(self.counts):
                self.counts, self.values = next(self.blocks, (None, None))
                if self.counts is None:
                    self.blocks, self.counts, self.values = iter(()), np.zeros(0, np.int64), np.zeros((0, len(self.beyond)), np.int64)
                    out.append(np.tile(self.beyond, (n, 1)))
                    break
            total = np.cumsum(np.minimum(self.counts, n))
            j = int(np.searchsorted(total, n))
            used = self.counts[: j + 1].copy()
            if j < len(total):
                used[j] = n - (total[j - 1] if j else 0)
            out.append(np.repeat(self.values[: len(used)], used, axis=0))
            n -= int(used.sum())
            if j < len(total):
                self.counts, self.values = self.counts[j:].copy(), self.values[j:]
                self.counts[0] -= used[j]
            else:
                self.counts = self.counts[:0]
        return np.concatenate(out) if out else self.values[:0]


def _boxes_in(f, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """`walk_boxes` over an open file: (type, payload's place, payload's size), of which only heads are read."""
    while start + 8 <= stop:
        f.seek(start)
        raw = f.read(16)
        size, kind = struct.unpack_from(">I4s", raw)
        head = 8
        if size == 1 and start + 16 <= stop:
            size, head = struct.unpack_from(">Q", raw, 8)[0], 16
        elif size == 0:
            size = stop - start
        if size < head:
            return
        end = min(start + size, stop)
        yield kind.decode("latin-1"), start + head, end - start - head
        if kind in CONTAINERS:
            yield from _boxes_in(f, start + head, end)
        start = end


def _long_track(f, tables: dict[str, tuple[int, int]], path: str, stream: int, file_size: int, at_once: int) -> Iterator[Samples]:
    """What `parse_track` says, ``at_once`` samples at a time; of the tables only the runs of chunks and a byte a sample
    for keyframes are held."""

    def part(kind: str, n: int) -> bytes:
        f.seek(tables[kind][0])
        return f.read(min(n, tables[kind][1]))

    heads = [part(kind, 4096) for kind in ("mdhd", "hdlr", "stsd")]
    track = described(b"".join(heads), {kind: (sum(map(len, heads[:i])), len(heads[i])) for i, kind in enumerate(("mdhd", "hdlr", "stsd"))})
    same, count = struct.unpack(">II", part("stsz", 12)[4:])
    sizes = _Entries(f, *tables["stsz"], head=8)
    n = min(count, file_size // same) if same else sizes.count
    chunks = _Entries(f, *tables["co64"], form=">u8") if "co64" in tables else _Entries(f, *tables["stco"])
    times, runs = _Entries(f, *tables["stts"], 2), _Entries(f, *tables["stsc"], 3)
    last = 1
    for a in range(0, times.count, at_once):
        held = times.get(a, min(a + at_once, times.count))
        held = held[held[:, 0] > 0]
        last = int(held[-1, 1]) if len(held) else last
    durations = _Laid((((e := times.get(a, min(a + at_once, times.count)))[:, 0], e[:, 1:]) for a in range(0, times.count, at_once)), np.array([last]))
    keys = None
    if "stss" in tables:
        keys, listed = np.zeros(n, bool), _Entries(f, *tables["stss"])
        for a in range(0, listed.count, at_once):
            places = listed.get(a, min(a + at_once, listed.count)).ravel() - 1
            keys[places[(places >= 0) & (places < n)]] = True
    by_runs = runs.count > 0 and chunks.count > 0
    first = int(chunks.get(0, 1)[0, 0]) if chunks.count else 0
    if by_runs:
        table = runs.get(0, runs.count)
        starts = np.maximum(table[:, 0] - 1, 0)
        later = np.append(np.minimum.accumulate(starts[::-1])[::-1][1:], np.int64(1) << 62)
        starts, per_chunk = starts[starts < later], np.append(1, table[starts < later, 1])  # of a chunk the last entry that begins at or before it

        def laid():
            for a in range(0, chunks.count, at_once):
                ids = np.arange(a, min(a + at_once, chunks.count))
                yield per_chunk[np.searchsorted(starts, ids, side="right")], np.column_stack([ids, chunks.get(a, int(ids[-1]) + 1)])

        places = _Laid(laid(), np.array([chunks.count, first]))
    pts, chunk_now, chunk_bytes = 0, -1, 0
    for a in range(0, n, at_once):
        b = min(a + at_once, n)
        size = np.full(b - a, same, np.int64) if same else sizes.get(a, b).ravel()
        duration = durations.take(b - a).ravel()
        if by_runs:
            held = places.take(b - a)
            before = np.cumsum(size) - size
            opens = np.flatnonzero(np.diff(held[:, 0], prepend=chunk_now))
            start = np.zeros(b - a, np.int64)
            start[opens] = before[opens]
            start = np.maximum.accumulate(start)
            inside = before - start + np.where(held[:, 0] == chunk_now, chunk_bytes, 0)
            offsets = np.where(held[:, 0] < chunks.count, held[:, 1] + inside, first)
            chunk_now, chunk_bytes = int(held[-1, 0]), int(inside[-1] + size[-1])
        elif chunks.count:
            offsets = chunks.get(min(a, chunks.count - 1), max(min(b, chunks.count), min(a, chunks.count - 1) + 1)).ravel()
            offsets = np.append(offsets, np.full(b - a - len(offsets), offsets[-1]))
        else:
            offsets = np.zeros(b - a, np.int64)
        yield Samples(path, stream, track, np.arange(a, b), pts + np.cumsum(duration) - duration, offsets, size, duration, np.ones(b - a, bool) if keys is None else keys[a:b])
        pts += int(duration.sum())


def file_samples(f, path: str, size: int, at_once: int = 65536, moov_bytes: int = MOOV_BYTES) -> Iterator[Samples]:
    """Samples of a file's tracks in order; from a ``moov`` box beyond ``moov_bytes`` in blocks of ``at_once``, so that
    memory doesn't follow the file."""
    at, length = moov_place(f)
    if (length or size - at) <= moov_bytes:
        for i, t in enumerate(read_tracks(find_moov(f), size)):
            yield track_samples(path, i, t)
        return
    found: list[dict[str, tuple[int, int]]] = []
    for kind, place, n in _boxes_in(f, at, min(size, at + length) if length else size):
        if kind == "trak":
            found.append({})
        elif found:
            found[-1].setdefault(kind, (place, n))
    stream = 0
    for tables in found:
        blocks = _long_track(f, tables, path, stream, size, at_once)
        try:
            first = next(blocks, None)
        except (KeyError, struct.error, IndexError):
            continue
        if first is not None:
            yield first
            yield from blocks
        stream += 1
    if not stream:
        raise ValueError("no track")


def read_batches(f, s: Samples, payload: bool, at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The samples as rows of `SCHEMA`; what lies side by side in the file is read in one go, ``at_once`` bytes at most
    unless one sample is longer. A sample that the file ends in has the bytes that are there."""
    sizes = s.sizes if payload else np.full(len(s.sizes), 64)
    a = 0
    while a < len(s.seq):
        total = np.cumsum(sizes[a : a + 65536])
        b = a + max(1, int(np.searchsorted(total, at_once, side="right")))
        part, n = s.where(slice(a, b)), b - a
        data: list = [None] * n
        if payload:
            ends = part.offsets + part.sizes
            breaks = np.flatnonzero(part.offsets[1:] != ends[:-1]) + 1
            for x, y in zip([0, *breaks.tolist()], [*breaks.tolist(), n]):
                f.seek(int(part.offsets[x]))
                block, at = f.read(int(ends[y - 1] - part.offsets[x])), part.offsets[x]
                for i in range(x, y):
                    data[i] = block[part.offsets[i] - at : ends[i] - at]
        t, number = s.track, lambda v, kind: pa.array(np.full(n, v), kind)
        pts = pa.array(part.pts, pa.int64())
        columns = [pa.array([s.path] * n), number(s.stream, pa.int32()), pa.array(part.seq, pa.int64()), pts, pts, pa.array(part.durations, pa.int64()), number(t.timescale, pa.int32()), pa.array([t.codec] * n),
            pa.array(part.sync), pa.array(part.offsets, pa.int64()), *(number(v, pa.int32()) for v in (t.rate, t.channels, t.width, t.height)), pa.array(data, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=COLUMNS)
        a = b


class Bounds:
    """What conditions pushed to a reader leave of streams, keyframes, places and times."""

    def __init__(self):
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}
        self.paths: set | None = None
        self.keyframe: bool | None = None

    def take(self, condition: Filter) -> bool:
        """Whether the condition is one that the reader answers itself, in full."""
        name = condition.attribute[0] if len(getattr(condition, "attribute", ())) == 1 else None
        if isinstance(condition, IsNotNull):
            return name in (*RANGES, "path", "keyframe")  # these are never null
        value = getattr(condition, "value", None)
        if name in RANGES and type(value) is int:
            low, high = {EqualTo: (value, value), GreaterThan: (value + 1, None), GreaterThanOrEqual: (value, None), LessThan: (None, value - 1), LessThanOrEqual: (None, value)}.get(type(condition), (None, None))
            if low is not None:
                self.low[name] = max(low, self.low.get(name, low))
            if high is not None:
                self.high[name] = min(high, self.high.get(name, high))
            return low is not None or high is not None
        if name == "path" and isinstance(condition, (EqualTo, In)):
            wanted = {value} if isinstance(condition, EqualTo) else set(value)
            self.paths = wanted if self.paths is None else self.paths & wanted
            return True
        if name == "keyframe" and isinstance(condition, EqualTo):
            if self.keyframe is not None and self.keyframe != value:
                self.paths = set()  # nothing is both
            self.keyframe = value
            return True
        return False

    def has_path(self, path: str) -> bool:
        return self.paths is None or path in self.paths

    def overlap(self, **spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which rows, that reach from the first to the last value of each column named, may hold something wanted."""
        keep = np.ones(len(next(iter(spans.values()))[0]), bool)
        for name, (first, last) in spans.items():
            for column in ("pts", "dts") if name == "pts" else (name,):
                keep &= (last >= self.low.get(column, -(1 << 62))) & (first <= self.high.get(column, 1 << 62))
        return keep

    def pick(self, s: Samples) -> Samples:
        stream = np.full(len(s.seq), s.stream)
        keep = self.overlap(seq=(s.seq, s.seq), pts=(s.pts, s.pts), stream_index=(stream, stream), pos=(s.offsets, s.offsets))
        return s.where(keep if self.keyframe is None else keep & (s.sync == self.keyframe))


def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with small batches put together."""
    for group in deal(((b, max(b.num_rows * BYTES_AT_ONCE // ROWS_AT_ONCE, b.nbytes)) for b in batches), BYTES_AT_ONCE):
        yield group[0] if len(group) == 1 else pa.concat_batches(group)


@dataclass
class Stretch(InputPartition):
    """What a task reads: the samples in bytes of files, ``(path, first, until)`` each; or, with an index, places in it."""

    files: list = field(default_factory=list)
    indexed: list = field(default_factory=list)


class Mp4Reader(DataSourceReader):
    """Plans without opening a media file: from the listing, or from an index that `mp4_index.index_files` made.

    Without one a task parses its files' tables: a file beyond ``bytesPerPartition`` is read by several tasks, each of
    which does, and small files share a task, each counting `OPEN_BYTES` more. With one no task does, and stretches that
    no condition allows aren't planned.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.step = int(options.get("bytesPerPartition", TASK_BYTES))
        self.index = options.get("index")
        self.bounds = Bounds()

    def partitions(self) -> list[InputPartition]:
        if self.index:
            from reelframe.sources.mp4_index import plan_stretches

            return [Stretch(indexed=keys) for keys in plan_stretches(self.index, self.bounds, self.step)]
        pieces = (((path, a, a + self.step), OPEN_BYTES + min(self.step, size - a)) for path, size in list_sizes(self.path, ".mp4") if self.bounds.has_path(path) for a in range(0, max(size, 1), self.step))
        return [Stretch(files) for files in deal(pieces, self.step)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from joined(self._batches(partition))

    def _batches(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if partition.indexed:
            from reelframe.sources.mp4_index import load_stretches

            picked = (s for s in map(self.bounds.pick, load_stretches(self.index, partition.indexed, self.bounds)) if len(s.seq))
            for path, of_file in groupby(picked, key=lambda s: s.path):
                with open_read(path) as f:
                    for samples in of_file:
                        yield from read_batches(f, samples, self.payload)
            return
        for path, first, until in partition.files:
            with open_read(path) as f:
                size = f.size()
                for s in map(self.bounds.pick, file_samples(f, path, size)):
                    # what lies beyond the file's end, if anything does, is the last stretch's
                    at = np.minimum(s.offsets, max(size - 1, 0))
                    yield from read_batches(f, s.where((at >= first) & (at < until)), self.payload)


class ConditionedMp4Reader(Mp4Reader):
    """Takes conditions on path, stream, keyframe, place and time from the query and answers them itself.

    Spark 4.1 keeps what a query pushed with the loaded table: a later query on the same DataFrame that pushes nothing
    would see the earlier one's rows. So this is asked for by an option, for a DataFrame that serves one query; an
    index filtered as a table (`mp4_index.read_packets`) has no such bound.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for condition in filters:
            if not self.bounds.take(condition):
                yield condition


@dataclass
class Written(WriterCommitMessage):
    files: int


class Mp4Writer(DataSourceWriter):
    """One file per ``path``. Rows of a file must stand together, in the order the media are to be written."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator) -> Written:
        files, name, tracks, media, size = 0, None, {}, [], 0

        def close():
            if sorted(tracks) != list(range(len(tracks))):
                raise ValueError(f"{name}: streams aren't numbered from 0")
            put_file(self.folder, name.rsplit("/", 1)[-1], mp4_bytes([tracks[i] for i in sorted(tracks)], media))

        for row in iterator:
            if name is not None and row["path"] != name:
                close()
                files, tracks, media, size = files + 1, {}, [], 0
            name = row["path"]
            t = tracks.get(row["stream_index"])
            if t is None:
                if row["codec_id"] not in ENTRY_OF:
                    raise ValueError(f"{row['codec_id']} can't be written as MP4")
                t = tracks[row["stream_index"]] = Track(row["codec_id"], row["timescale"], row["sample_rate"] or 0, row["channels"] or 0, row["width"] or 0, row["height"] or 0)
            data = bytes(row["data"] or b"")
            t.offsets.append(size)
            t.sizes.append(len(data))
            t.durations.append(1 if row["duration"] is None else row["duration"])
            t.sync.append(bool(row["keyframe"]))
            media.append(data)
            size += len(data)
        if name is not None:
            close()
            files += 1
        return Written(files)


class Mp4Source(DataSource):
    """``spark.read.format("mp4").load(path)``; options: ``payload=false`` leaves out the media, ``index`` names the
    folder of an index, ``bytesPerPartition`` bounds what a task reads, ``pushFilters=true`` lets the query's conditions
    reach the reader (see `ConditionedMp4Reader`)."""

    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Mp4Reader:
        return (ConditionedMp4Reader if self.options.get("pushFilters", "false").lower() == "true" else Mp4Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> Mp4Writer:
        return Mp4Writer(self.options)
