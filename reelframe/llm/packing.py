"""Best-fit packing of tokenised documents into fixed-length sequences, certified by lower bounds."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelframe.llm.cluster import lean, settle, shared_dir
from reelframe.llm.tokens import encoder

#: Pieces packed together in one task.
PIECES_PER_TASK = 50_000
#: Words a worker keeps the ids of while packing; fewer than elsewhere, as other stages' memory stays in use.
MAX_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, sealed boolean, bound long, bins long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32)`` of every document's ids with ``end_id`` after them.

    A null or empty text has the end id alone. Only documents longer than ``capacity`` are cut. Repeated rows
    give repeated pieces. Other columns are ignored.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches):
        for batch in batches:
            ids = encoder(vocabulary, MAX_WORDS).encode(batch.column(1))
            out = [(d, i, a // 4, len(x) // 4, zlib.crc32(x)) for d, raw in zip(batch.column(0).to_pylist(), ids) for i, (a, x) in enumerate((a, (raw + end)[a : a + 4 * capacity]) for a in range(0, len(raw) + 4, 4 * capacity))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), PIECES)


def sequence_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that any packing needs, by two families of dual feasible functions.

    A dual feasible function maps lengths to weights so that whatever fits together weighs at most one
    sequence; the rounded-up sum of weights therefore never exceeds the optimum.
    """
    if not len(lengths):
        return 0
    best = -(-int((lengths * counts).sum()) // capacity)
    by_length = np.zeros(capacity + 2, dtype=np.int64)
    by_length[lengths] = counts
    number, total = np.cumsum(by_length), np.cumsum(by_length * np.arange(capacity + 2))
    # threshold e: above capacity - e counts whole, below e counts nothing
    e = np.arange(1, capacity // 2 + 1)
    large = number[capacity] - number[capacity - e]
    middle = total[capacity - e] - total[e - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for k in range(1, 33):  # rounding down to k-ths of a sequence
        scaled = (k + 1) * lengths
        weight = np.where(scaled % capacity == 0, k * (scaled // capacity), (scaled // capacity) * (k + 1))
        best = max(best, -(-int((weight * counts).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the fullest bin that still holds it."""
    n = len(lengths)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)  # by free space
    free_sizes, bins = 0, 0  # bit s: some bin has s free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = free_sizes >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                free_sizes ^= 1 << free
        else:
            free, b = capacity, bins
            bins += 1
        where[i], offset[i] = b, capacity - free
        left = free - size
        if left:
            open_bins[left].append(b)
            free_sizes |= 1 << left
    return where, offset


def _pack_task(capacity: int, turn: int, last: bool):
    def pack(batches):
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        sizes, counts = np.unique(lengths, return_counts=True)
        bound = sequence_bound(sizes, counts, capacity)
        where, offset = best_fit_decreasing(lengths, capacity)
        bins = int(where.max()) + 1
        free = capacity - np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        sealed = np.ones(bins, bool)
        if not last:
            if bins > bound:
                sealed = free == 0  # not certified: all that isn't full is packed anew with others' documents
            elif free.max() > 0:
                sealed[int(free.argmax())] = False  # certified: only its emptiest sequence looks for company
        n = len(lengths)
        ids = (np.int64(turn) << 56) | (np.int64(TaskContext.get().partitionId()) << 32) | where
        for col, values in (("sequence_id", ids), ("offset", offset), ("sealed", sealed[where]), ("bound", np.full(n, bound)), ("bins", np.full(n, bins))):
            table = table.append_column(col, pa.array(values))
        yield from table.to_batches()

    return pack


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Place ``pieces`` (columns of `token_pieces`) in as few sequences of ``capacity`` as can be found.

    Each task packs its pieces best-fit decreasing and certifies its count by `sequence_bound`. A task with a
    gap gives up every sequence that isn't full, a certified one its emptiest; what is given up is dealt out
    anew to fewer tasks and packed again, until the corpus-wide bound is met, everything left fits one task's
    worth of pieces, or a round saves no sequence. Pieces are dealt by a hash of all their columns, so no key makes a task large; identical
    pieces (repeated rows) are apart only by place. No rows give no rows. Result: the pieces with
    ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).
    """
    spark = pieces.sparkSession
    folder = shared_dir(spark, "packing")
    waiting = settle(pieces, f"{folder}/pieces")
    sizes = waiting.groupBy("length").count().orderBy("length").collect()  # at most `capacity` rows
    count = sum(r["count"] for r in sizes)
    needed = sequence_bound(np.array([r["length"] for r in sizes], np.int64), np.array([r["count"] for r in sizes], np.int64), capacity)
    done, sealed_bins, total = [], 0, None
    for turn in itertools.count():
        tasks = max(1, -(-count // PIECES_PER_TASK))
        last = tasks == 1
        dealt = waiting.select(*PIECES.replace(" long", "").replace(" int", "").split(", "))
        dealt = dealt.repartition(tasks, F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn))) if tasks > 1 else dealt.coalesce(1)
        placed = settle(dealt.mapInArrow(lean(_pack_task(capacity, turn, last)), PLACED), f"{folder}/turn={turn}")
        done.append(placed)
        if last:
            break
        whole, left = placed.agg(F.count_distinct(F.when(F.col("sealed"), F.col("sequence_id"))), F.count_if(~F.col("sealed"))).first()
        open_bins = placed.where("not sealed").select("sequence_id").distinct().count()
        before, total = total, sealed_bins + whole + open_bins
        if total <= needed or before is not None and total >= before:
            done[-1] = placed.withColumn("sealed", F.lit(True))
            break
        sealed_bins += whole
        waiting, count = placed.where("not sealed"), left
    out = done[0].where("sealed")
    for part in done[1:]:
        out = out.unionByName(part.where("sealed"))
    return out.drop("sealed", "bound", "bins")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise and pack whole documents; see `token_pieces` and `pack`."""
    return pack(token_pieces(docs, vocabulary, capacity, end_id), capacity)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """The packed sequences themselves: ``(sequence_id, ids array<int>)``, pieces in order of their offset.

    ``doc_id`` must be unique here. A sequence holds at most ``capacity`` ids, so its group is bounded.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def ids_of(batches):
        for batch in batches:
            raw = [np.frombuffer(x + end, "<i4") for x in encoder(vocabulary, MAX_WORDS).encode(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.list_(pa.int32()))], names=["doc_id", "all_ids"])

    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(ids_of), "doc_id long, all_ids array<int>")
    parts = placed.join(ids, placed["doc_id"].eqNullSafe(ids["doc_id"])).select("sequence_id", "offset", F.slice("all_ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
