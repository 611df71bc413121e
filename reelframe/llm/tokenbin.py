"""Token ids as wavelet-matrix shard files: one compressed file a shard, with access, rank and select."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.cluster import put_file, settle, shared_dir
from reelframe.llm.tokens import encoder

MAGIC = b"RFWM0002"
#: A shard file is closed at the first document end after so many ids.
IDS_PER_SHARD = 4_000_000
#: Bits between stored ranks.
RANK_STEP = 512
#: Bits of one value between stored places.
SELECT_STEP = 4096
#: A plane's bits, ranks, and places of its 0s and its 1s.
PLANE_SECTIONS = 4


def build_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard's file: header, document index, then for each bit from the highest its plane and ranks.

    Plane k holds that bit of every id in the plane's order; the next plane's order is this one's with the ids
    whose bit is 0 first, both halves in order. After a plane's ranks stand the blocks that hold every
    `SELECT_STEP`-th 0 and 1. Each section is a zstandard frame. An empty shard is allowed.
    """
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    sections = [known.tobytes(), null.tobytes(), np.array(lengths, "<i8").tobytes()]
    kind = np.uint16 if planes <= 16 else np.uint32
    order = ids.astype(kind)
    for k in range(planes - 1, -1, -1):
        padded = np.zeros(-(-max(1, len(order)) // RANK_STEP) * RANK_STEP, np.uint8)
        padded[: len(order)] = order >> kind(k) & kind(1)
        counts = padded.reshape(-1, RANK_STEP).sum(1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(counts)])
        before = np.arange(len(ranks)) * RANK_STEP - ranks
        sections += [np.packbits(padded, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
        for seen, total in ((before, len(order) - int(ranks[-1])), (ranks, int(ranks[-1]))):
            sections.append((np.searchsorted(seen, np.arange(0, total, SELECT_STEP), side="right") - 1).astype("<u4").tobytes())
        ones, split = padded[: len(order)].view(bool), len(order) - int(ranks[-1])
        ordered = np.empty_like(order)
        ordered[:split], ordered[split:] = order[~ones], order[ones]
        order = ordered
    pack = zstandard.ZstdCompressor(level=1).compress
    frames = [pack(s) for s in sections]
    return MAGIC + struct.pack("<QIII", len(ids), len(doc_ids), planes, len(frames)) + struct.pack(f"<{len(frames)}Q", *map(len, frames)) + b"".join(frames)


class Shard:
    """Reader of one shard file; a section is inflated when first asked for. Positions and occurrence numbers
    count from 0."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a shard file")
        self.n, n_docs, self.planes, n_frames = struct.unpack_from("<QIII", content, 8)
        sizes = struct.unpack_from(f"<{n_frames}Q", content, 28)
        self.edges = [28 + 8 * n_frames]
        for size in sizes:
            self.edges.append(self.edges[-1] + size)
        if self.edges[-1] != len(content) or n_frames != 3 + PLANE_SECTIONS * self.planes:
            raise ValueError("truncated shard file")
        self.content, self.sections = content, {}
        null = self._section(1, "u1")
        self.doc_ids = [None if z else int(d) for d, z in zip(self._section(0, "<i8"), null)]
        self.lengths = self._section(2, "<i8")

    def _section(self, number: int, kind: str) -> np.ndarray:
        if number not in self.sections:
            frame = self.content[self.edges[number] : self.edges[number + 1]]
            self.sections[number] = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), kind)
        return self.sections[number]

    def bits(self, k: int) -> np.ndarray:
        """Plane k, eight bits a byte."""
        return self._section(3 + PLANE_SECTIONS * k, "u1")

    def ranks(self, k: int) -> np.ndarray:
        """Ones of plane k before each block of `RANK_STEP` bits, and in all."""
        return self._section(4 + PLANE_SECTIONS * k, "<u4")

    def zeros(self, k: int) -> int:
        return self.n - int(self.ranks(k)[-1])

    def _bit(self, k: int, i: int) -> int:
        return int(self.bits(k)[i >> 3]) >> (i & 7) & 1

    def _ones(self, k: int, i: int) -> int:
        """Ones of plane k before place i."""
        block = i // RANK_STEP
        rest = self.bits(k)[block * RANK_STEP // 8 : -(-i // 8)]
        tail = np.unpackbits(rest, bitorder="little")[: i - block * RANK_STEP] if len(rest) else rest
        return int(self.ranks(k)[block]) + int(tail.sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.planes):
            bit = self._bit(k, i)
            i = self.zeros(k) + self._ones(k, i) if bit else i - self._ones(k, i)
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        if token >> self.planes:
            return 0, 0
        a, b = 0, i
        for k in range(self.planes):
            ones_a, ones_b = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros(k) + ones_a, self.zeros(k) + ones_b) if token >> (self.planes - 1 - k) & 1 else (a - ones_a, b - ones_b)
        return a, b

    def count(self, token: int, i: int | None = None) -> int:
        """How often the id stands before position i (all: None)."""
        a, b = self._range(token, self.n if i is None else i)
        return b - a

    def find(self, token: int, j: int) -> int:
        """Position of the id's j-th occurrence."""
        a, b = self._range(token, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for k in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros(k) if bit else i)
        return i

    def _select(self, k: int, bit: int, want: int) -> int:
        """Place of plane k's want-th bit of this value: from two samples to a block, then inside it."""
        samples = self._section((6 if bit else 5) + PLANE_SECTIONS * k, "<u4")
        low = int(samples[want // SELECT_STEP])
        high = int(samples[want // SELECT_STEP + 1]) if want // SELECT_STEP + 1 < len(samples) else len(self.ranks(k)) - 2
        ranks = self.ranks(k)[low : high + 1].astype(np.int64)
        before = ranks if bit else np.arange(low, high + 1) * RANK_STEP - ranks
        block = int(np.searchsorted(before, want, side="right")) - 1
        inside = np.unpackbits(self.bits(k)[(low + block) * RANK_STEP // 8 : (low + block + 1) * RANK_STEP // 8], bitorder="little")
        return (low + block) * RANK_STEP + int(np.flatnonzero(inside == bit)[want - int(before[block])])

    def all_ids(self) -> np.ndarray:
        """Every id in order, from the lowest plane's order back to the first's."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.planes - 1, -1, -1):
            bits = np.unpackbits(self.bits(k), count=self.n, bitorder="little").view(bool) if self.n else np.zeros(0, bool)
            split, back = self.zeros(k), np.empty(self.n, kind)
            back[~bits] = values[:split]
            back[bits] = values[split:] | kind(1 << (self.planes - 1 - k))
            values = back
        return values


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, ids_per_shard: int = IDS_PER_SHARD) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shard files in ascending ``doc_id`` order (null first, ties by a hash of the text, then by it).

    Null and empty texts have the end id alone; repeated rows are written as often as they come; other columns
    are ignored. Rows are range-partitioned, so a file holds consecutive documents and files ascend with their
    number. A repeated task attempt replaces its files. Returns the files' manifest
    ``(shard long, name string, n_docs long, n_tokens long)``; no documents give none.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, 0
        names, raw, rows = [], [], []

        def close():
            ids = np.frombuffer(b"".join(raw), "<u4")
            shard = part << 24 | number
            put_file(folder, f"{shard:016x}.wm", build_shard(names, [len(x) // 4 for x in raw], ids))
            rows.append((shard, f"{shard:016x}.wm", len(names), len(ids)))

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode(batch.column(1))):
                names.append(d)
                raw.append(x + end)
                held += len(x) // 4 + 1
                if held >= ids_per_shard:
                    close()
                    names, raw, held, number = [], [], 0, number + 1
        if names:
            close()
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["shard", "name", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    # rows without a doc_id, or with the same, are dealt out by their text
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return settle(ordered.mapInArrow(write, "shard long, name string, n_docs long, n_tokens long"), folder + "-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: ``(doc_id, start, n_tokens, ids_crc32)``; start counts the ids of all before it."""

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(content.as_py())
                raw, n = shard.all_ids().astype("<u4").tobytes(), shard.lengths
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                number = int(path.rsplit("/", 1)[-1][:16], 16)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(n), pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "place", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
    rows = files.mapInArrow(read, "shard long, doc_id long, place long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids as shard files in the shared folder and read them back."""
    folder = shared_dir(docs.sparkSession, "token-shards")
    return read_shards(write_shards(docs, folder, vocabulary, end_id), folder)
