"""Periodic runs of words: suffix trees of a text and of its reversal answer how far two places agree, and
Lyndon roots name the places to extend.

A run of period q is at least 4 q words long, so every three words that begin inside it and end inside it
occur in it three times or more. Positions of which that isn't true for their document, then for their stretch,
belong to no run; trees are built over the stretches that are left. This only says where no run can be: every
run is found by its Lyndon root, extended both ways in the trees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run is this many times its period, and this many words, at least.
EXPONENT, SHORTEST = 4, 6
#: Bytes of texts taken apart at once; bounds the words in memory. A longer text is taken alone.
BYTES_AT_ONCE = 8_000_000
#: Words that tell stretches apart: a run of exponent 4 holds each of its shingles this many times at least.
SHINGLE = 3
#: Counters of shingles; that two share one only keeps more positions than needed.
_COUNTER_BITS = 23
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Entries of the tour under one minimum of the table over it.
_BLOCK = 32
RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class SuffixTree:
    """Ukkonen's tree of a sequence of whole numbers from 0, closed by an end mark that sorts before all of them.

    ``order()`` gives the places of the suffixes in rising order, ``order(True)`` with the numbers' order turned
    round; ``common(a, b)`` how long the suffixes from ``a`` and ``b`` agree.
    """

    def __init__(self, numbers: np.ndarray):
        self.symbols = [*(numbers + 1).tolist(), 0]
        self.width = max(self.symbols) + 1
        child = self._grow()
        parents, symbols = np.divmod(np.fromiter(child.keys(), np.int64, len(child)), self.width)
        nodes = np.fromiter(child.values(), np.int64, len(child))
        turned = np.where(symbols > 0, self.width - symbols, 0)
        self.edges = np.searchsorted(np.sort(parents), np.arange(len(self.first) + 1)).tolist()
        self.children = [nodes[np.lexsort((by, parents))].tolist() for by in (symbols, turned)]

    def _grow(self) -> dict[int, int]:
        """One pass over the symbols. Returns the child of (node * width + first symbol of its edge)."""
        symbols, width = self.symbols, self.width
        total = len(symbols)
        first, stop, link = [0], [0], [0]  # of the edge that leads to a node, and the node's suffix link
        child: dict[int, int] = {}
        node = edge = length = pending = 0  # the active point: ``length`` symbols from ``edge`` on below ``node``
        for at, symbol in enumerate(symbols):
            pending += 1
            waits = 0  # the inner node made last, which has no suffix link yet
            while pending:
                if not length:
                    edge = at
                key = node * width + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(at)
                    stop.append(total)
                    link.append(0)
                    if waits:
                        link[waits] = node
                        waits = 0
                else:
                    span = stop[below] - first[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    middle = first[below] + length
                    if symbols[middle] == symbol:
                        length += 1
                        if waits:
                            link[waits] = node
                        break
                    split = len(first)
                    first += (first[below], at)
                    stop += (middle, total)
                    link += (0, 0)
                    child[key] = split
                    child[split * width + symbol] = split + 1
                    child[split * width + symbols[middle]] = below
                    first[below] = middle
                    if waits:
                        link[waits] = split
                    waits = split
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - pending + 1
        self.first, self.stop = first, stop
        return child

    def _walk(self, turned: bool, tour: list | None = None, places: list | None = None) -> np.ndarray:
        """Suffixes as their leaves are met. ``tour`` takes a node's string depth each time the walk is at it,
        ``places`` where in the tour each leaf is."""
        first, stop, edges, below = self.first, self.stop, self.edges, self.children[turned]
        total, leaves, stack = len(self.symbols), [], []
        node, depth, at = 0, 0, edges[0]
        while True:
            if tour is not None:
                tour.append(depth)
            if at == edges[node + 1]:
                if not stack:
                    return np.array(leaves, np.int64)
                node, depth, at = stack.pop()
                continue
            child = below[at]
            low = depth + stop[child] - first[child]
            if edges[child] == edges[child + 1]:
                leaves.append(total - low)
                if tour is not None:
                    places.append(len(tour))
                    tour.append(low)
                at += 1
            else:
                stack.append((node, depth, at + 1))
                node, depth, at = child, low, edges[child]

    def order(self, turned: bool = False) -> np.ndarray:
        return self._walk(turned)[1:]  # the first is the end mark's

    def prepare(self) -> SuffixTree:
        """Lay minima over the Euler tour: within blocks from either end, and over 1, 2, 4, ... blocks."""
        tour: list[int] = []
        places: list[int] = []
        leaves = self._walk(False, tour, places)
        self.place = np.empty(len(self.symbols), np.int64)
        self.place[leaves] = places
        blocks = -(-len(tour) // _BLOCK)
        grid = np.full(blocks * _BLOCK, len(self.symbols), np.int32)
        grid[: len(tour)] = tour
        self.depths, grid = grid, grid.reshape(blocks, _BLOCK)
        self.to_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.from_left = np.minimum.accumulate(grid, axis=1).ravel()
        self.levels = [grid.min(axis=1)]
        while 2 ** len(self.levels) <= blocks:
            low, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))
        return self

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """String depth of the lowest common ancestors of the leaves of ``a`` and ``b`` (never the same leaf)."""
        x, y = self.place[a], self.place[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        out = np.minimum(self.to_right[x], self.from_left[y])
        near = x // _BLOCK == y // _BLOCK
        if near.any():  # inside one block: the entries between the two are looked at
            at = x[near, None] + np.arange(_BLOCK)
            out[near] = np.where(at <= y[near, None], self.depths[np.minimum(at, len(self.depths) - 1)], len(self.symbols)).min(axis=1)
        left, many = x // _BLOCK + 1, y // _BLOCK - x // _BLOCK - 1
        scale = np.frexp(np.maximum(many, 1))[1] - 1
        for k in np.unique(scale[many > 0]).tolist():
            some, level = np.flatnonzero((scale == k) & (many > 0)), self.levels[k]
            lows = np.minimum(level[left[some]], level[left[some] + many[some] - 2**k])
            out[some] = np.minimum(out[some], lows)
        return out


def _next_smaller(ranks: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank, or the end: where the longest Lyndon word from there stops."""
    out, stack = [len(ranks)] * len(ranks), []
    for i, rank in enumerate(ranks):
        while stack and ranks[stack[-1]] > rank:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out, np.int64)


def find_runs(numbers: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), in this order, of the maximal runs of the sequence that are long enough.

    The longest Lyndon words from each place, in both orders of the numbers, hold a root of every run; how far its
    period goes on to the right and to the left is the common extension of two suffixes in either tree.
    """
    n = len(numbers)
    if n < SHORTEST:
        return np.empty((0, 3), np.int64)
    codes = np.unique(numbers, return_inverse=True)[1].astype(np.int64)
    forward, starts, roots = SuffixTree(codes), [], []
    for turned in (False, True):
        ranks = np.empty(n, np.int64)
        ranks[forward.order(turned)] = np.arange(n)
        starts.append(np.arange(n))
        roots.append(_next_smaller(ranks.tolist()) - starts[-1])
    start, period = np.concatenate(starts), np.concatenate(roots)
    some = EXPONENT * period <= n
    start, period = start[some], period[some]
    right = forward.prepare().common(start, start + period)
    del forward
    backward = SuffixTree(codes[::-1]).prepare()
    left = backward.common(n - start, n - start - period)
    length = left + period + right
    some = length >= np.maximum(SHORTEST, EXPONENT * period)
    return np.unique(np.stack([start - left, length, period], axis=1)[some], axis=0)


def _stretches(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of what may hold runs: all shingles occur often enough in their owner, then in their stretch."""
    at = np.arange(max(0, len(codes) - SHINGLE + 1))
    keys = sum(codes[at + k].astype(np.uint64) * _FACTORS[k] for k in range(SHINGLE)) if len(at) else np.empty(0, np.uint64)
    at = at[owner[at] == owner[at + SHINGLE - 1]]
    groups = owner[at]
    while len(at):
        slots = ((keys[at] + groups.astype(np.uint64) * _FACTORS[3]) * _FACTORS[0] >> np.uint64(64 - _COUNTER_BITS)).astype(np.int64)
        often = np.bincount(slots)[slots] >= EXPONENT - 1
        kept, of = at[often], groups[often]
        if not len(kept):
            return []
        breaks = np.flatnonzero((np.diff(kept) != 1) | (np.diff(of) != 0)) + 1
        lengths = np.diff([0, *breaks, len(kept)])
        long = lengths + SHINGLE - 1 >= SHORTEST
        stretch = np.repeat(np.arange(len(lengths)), lengths)
        chosen = long[stretch]
        if chosen.sum() == len(at):
            heads = np.cumsum(lengths) - lengths
            return [(a, a + n + SHINGLE - 1) for a, n in zip(kept[heads].tolist(), lengths.tolist())]
        at, groups = kept[chosen], stretch[chosen]
    return []


def _runs_by_text(codes: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of each text that has any; text i has the codes up to ``ends[i]`` from where the one before stops."""
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    found: dict[int, list] = {}
    for a, b in _stretches(codes, owner):
        runs = find_runs(codes[a:b])
        if len(runs):
            text = int(owner[a])
            runs[:, 0] += a - (int(ends[text - 1]) if text else 0)
            found.setdefault(text, []).extend(map(tuple, runs.tolist()))
    return {text: sorted(runs, key=lambda r: (r[0], r[2])) for text, runs in found.items()}


#: Given a batch's doc_ids (Arrow) and its numbers of words, says which word stands at each place: places in the
#: batch's words, one text after another.
Rewrite = Callable[[pa.Array, np.ndarray], np.ndarray]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``(doc_id, n_words long, runs, collapsed string)`` of each whole text, words cut at ASCII white space.

    ``runs`` are all maximal stretches (start, length, period: words counted from 0) of which the smallest period
    fits in four times and that have six words at least, by start, then period. ``collapsed`` joins by one space
    the words that no run holds after its first period. Null, empty and white texts have no words, no runs and an
    empty text; repeated rows and null ids each get a row; other columns are ignored; no rows give none.
    """

    def take_apart(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(real)])[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        words = flat.filter(pa.array(real)).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        sizes = np.diff(ends, prepend=0)
        if rewrite is not None:
            codes = codes[rewrite(ids, sizes)]
        found = _runs_by_text(codes, ends)
        gone = np.zeros(len(codes) + 1, np.int64)
        for text, runs in found.items():
            head = int(ends[text] - sizes[text])
            for start, length, period in runs:
                gone[head + start + period] += 1
                gone[head + start + length] -= 1
        stays = np.cumsum(gone[:-1]) == 0
        edges = np.concatenate([[0], np.cumsum(stays)])[np.concatenate([[0], ends])]
        kept = words.dictionary.take(pa.array(codes[stays]))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), kept), pa.scalar(" ", pa.large_string()))
        rows = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, ())] for i in range(len(ids))]
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(rows, _ARROW_RUNS), joined.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    def runs(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            ends, a = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)), 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES_AT_ONCE, side="right")))
                yield take_apart(ids.slice(a, b - a), texts.slice(a, b - a))
                a = b

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(runs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_planted_runs(ids: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The rewriting that the registered query is held against: for a tenth of the documents, chosen by a CRC of
    their doc_id, the words from a place on repeat what stands there (a null doc_id: as it is)."""
    import zlib

    places, head = np.arange(int(sizes.sum())), 0
    for doc, n in zip(ids.to_pylist(), sizes.tolist()):
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            places[head + a : head + n] = head + a + np.arange(n - a) % p
        head += n
    return places


def run_digest(docs: DataFrame) -> DataFrame:
    """One row a document: its longest run by exponent (ties: first start, then least period) and digests."""
    found = periodic_runs(docs, with_planted_runs)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
