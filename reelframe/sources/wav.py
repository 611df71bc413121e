"""WAV files: ``format("wav")`` reads packets and writes files from them."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from reelframe.sources.files import list_sizes, open_read, put_file

# Sample format tag and bits of each codec.
TAGS = {(1, 8): "pcm_u8", (1, 16): "pcm_s16le", (3, 32): "pcm_f32le"}
FRAMES_PER_PACKET = 4096
SCHEMA = "path string, stream_index int, seq long, pts long, duration long, sample_rate int, channels int, codec_id string, pos long, data binary"


@dataclass
class Header:
    codec: str
    channels: int
    rate: int
    align: int
    start: int
    size: int


def read_header(f) -> Header:
    """Walks the chunks to ``data``; unknown ones are passed over. ``fmt `` must come first."""
    riff = f.read(12)
    if riff[:4] != b"RIFF" or riff[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, made = 12, None
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("no data chunk")
        name, size = struct.unpack("<4sI", head)
        at += 8
        if name == b"fmt ":
            tag, channels, rate, _, align, bits = struct.unpack("<HHIIHH", f.read(16))
            if (tag, bits) not in TAGS:
                raise ValueError(f"unsupported WAV format {tag} with {bits} bits")
            made = Header(TAGS[tag, bits], channels, rate, align, 0, 0)
        elif name == b"data":
            if made is None:
                raise ValueError("missing fmt")
            made.start, made.size = at, size
            return made
        at += size + size % 2
        f.seek(at)


def wav_header(codec: str, channels: int, rate: int, size: int) -> bytes:
    """What stands before ``size`` bytes of samples; an odd number of them is followed by a byte of padding."""
    found = [k for k, c in TAGS.items() if c == codec]
    if not found or channels < 1:
        raise ValueError(f"{codec} with {channels} channels can't be written as WAV")
    if size + size % 2 + 36 >= 1 << 32:
        raise ValueError("a WAV file ends at 4 GiB; mux.write_media goes on in a further one")
    tag, bits = found[0]
    align = channels * bits // 8
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, channels, rate, rate * align, align, bits)
    return struct.pack("<4sI4s", b"RIFF", 36 + size + size % 2, b"WAVE") + head + struct.pack("<4sI", b"data", size)


def wav_bytes(codec: str, channels: int, rate: int, payload: bytes) -> bytes:
    """A whole file; an odd payload is padded."""
    return wav_header(codec, channels, rate, len(payload)) + payload + b"\0" * (len(payload) % 2)


@dataclass
class Stretch(InputPartition):
    path: str
    first: int
    until: int


class WavReader(DataSourceReader):
    """Plans stretches of bytes from the listing alone, so that a large file is read by many tasks and none is opened
    to plan. A task reads the header and takes the packets that start in its stretch; of these, with ``since`` and
    ``until`` (seconds), those from the packet that holds the one time to before the other."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.step = int(options.get("bytesPerPartition", 16 << 20))
        self.since, self.until = float(options.get("since", "0")), float(options.get("until", "inf"))

    def partitions(self) -> list[InputPartition]:
        return [Stretch(path, a, a + self.step) for path, size in list_sizes(self.path, ".wav") for a in range(0, max(size, 1), self.step)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        if partition is None:
            return
        with open_read(partition.path) as f:
            h = read_header(f)
            step = FRAMES_PER_PACKET * h.align
            low, high = (max(0, -(-(x - h.start) // step)) for x in (partition.first, partition.until))
            # packets lie at even places: the one that holds a time is known from the rate
            low = max(low, int(self.since * h.rate // FRAMES_PER_PACKET))
            if self.until != float("inf"):
                high = min(high, math.ceil(self.until * h.rate / FRAMES_PER_PACKET))
            for seq in range(low, min(high, -(-h.size // step))):
                at = seq * step
                size = min(step, h.size - at)
                data = None
                if self.payload:
                    f.seek(h.start + at)
                    data = f.read(size)
                    if len(data) < size:
                        return
                yield partition.path, 0, seq, at // h.align, size // h.align, h.rate, h.channels, h.codec, h.start + at, data


@dataclass
class Written(WriterCommitMessage):
    files: int


class WavWriter(DataSourceWriter):
    """One file per ``path`` (its name below the target). Rows of a file must stand together, in order of seq."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator) -> Written:
        files, name, parts, last = 0, None, [], None

        def close():
            put_file(self.folder, name.rsplit("/", 1)[-1], wav_bytes(last["codec_id"], last["channels"], last["sample_rate"], b"".join(parts)))

        for row in iterator:
            if name is not None and row["path"] != name:
                close()
                files, parts = files + 1, []
            if row["stream_index"] != 0:
                raise ValueError("a WAV file has one stream")
            name, last = row["path"], row
            parts.append(bytes(row["data"] or b""))
        if name is not None:
            close()
            files += 1
        return Written(files)


class WavSource(DataSource):
    """``spark.read.format("wav").load(path)``; options: ``payload=false`` leaves out the samples,
    ``since`` and ``until`` bound the time, ``bytesPerPartition`` what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(self.options)
