"""Removal of repeated byte strings, decided by suffix arrays built through linear grouping.

A string of `span` bytes that occurs twice is looked for in three steps. Each window of `span` bytes names one
place in it by content alone (its anchor: the leftmost least hash of `ANCHOR` bytes), so equal windows name
equal anchors at equal offsets, and only anchors seen twice can own a repeated window. The windows that one
anchor owns form a context. Contexts that are equal as a whole repeat as a whole. Where an anchor has several
contexts, a suffix array over them tells which of their windows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.cluster import lean, settle, shared_dir

#: Bytes of an anchor; at least one lies in every window.
ANCHOR = 64
#: Contexts of one anchor that share a suffix array; an anchor with more is cut into blocks, which are then
#: held against each other by the digests of their windows.
BLOCK = 64
#: Contexts per task of the suffix-array step.
CONTEXTS_PER_TASK = 4_000
#: Bytes of a text hashed at once; texts longer than this are hashed in overlapping stretches.
STRETCH = 1 << 20
#: Digests of windows that one task holds against each other.
DIGESTS_PER_GROUP = 1 << 16
_MULTIPLIER = 0x9E3779B97F4A7C15
_U = np.uint64


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes of ``text`` (small non-negative numbers) in order, in linear grouping.

    First the suffixes are grouped by their longest Lyndon prefix. Groups, at first one a symbol, are taken in
    descending order. Each member's pointer to the previous smaller suffix is found by following the pointers
    of what lies between; the suffixes pointed to grow by the group's prefix, as often as they are pointed to,
    and so move behind the rest of their own group. Then, in ascending order of suffixes, each suffix places
    those whose Lyndon prefix ends where it starts next in their group: the chain of previous-smaller pointers
    from its left neighbour. Nothing is renamed and no comparison of suffixes takes place.
    """
    n = len(text) + 1
    s = [x + 1 for x in text]
    s.append(0)
    order = sorted(range(n), key=s.__getitem__)
    place, head, size = [0] * n, [0] * n, [0] * n
    last, start = -1, 0
    for slot, i in enumerate(order):
        if s[i] != last:
            last, start = s[i], slot
        place[i] = slot
        head[i] = start
        size[start] += 1
    smaller = list(range(-1, n - 1))
    end = n
    while end > 1:
        first = head[order[end - 1]]
        if end - first == 1:
            i = order[first]
            p = smaller[i]
            while p >= 0 and head[p] > first:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                h = head[p]
                k = size[h]
                if k > 1:
                    slot = h + k - 1
                    x, at = order[slot], place[p]
                    order[at], order[slot] = x, p
                    place[x], place[p] = at, slot
                    size[h] = k - 1
                    head[p] = slot
                    size[slot] = 1
        else:
            times: dict[int, int] = {}
            for i in sorted(order[first:end]):
                p = smaller[i]
                while p >= 0 and head[p] >= first:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            if times:
                by_times: dict[tuple[int, int], list[int]] = {}
                for p, c in times.items():
                    by_times.setdefault((-c, head[p]), []).append(p)
                for _, h in sorted(by_times) if len(by_times) > 1 else by_times:
                    grown = by_times[_, h]
                    k = size[h]
                    if len(grown) == k:
                        continue
                    slot = h + k
                    for p in grown:
                        slot -= 1
                        x, at = order[slot], place[p]
                        order[at], order[slot] = x, p
                        place[x], place[p] = at, slot
                    size[h] = slot - h
                    size[slot] = len(grown)
                    for p in grown:
                        head[p] = slot
        end = first
    free = list(range(n))  # by group's first slot, its next free one
    order[0] = n - 1
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and (h := head[j]) >= 0:
            order[free[h]] = j
            free[h] += 1
            head[j] = -1
            j = smaller[j]
    return order[1:]


class _Rolling:
    """Hashes of any stretch of a text from one running sum."""

    def __init__(self):
        draw = np.random.Generator(np.random.PCG64(20))
        self.letters = draw.integers(0, 1 << 63, 256, dtype=np.uint64) | _U(1)
        self.up, self.down = self._powers(_MULTIPLIER), self._powers(pow(_MULTIPLIER, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out, n = np.ones(STRETCH + 1, np.uint64), 1
        while n <= STRETCH:
            m = min(n, STRETCH + 1 - n)
            out[n : n + m] = out[:m] * _U(pow(base, n, 1 << 64))
            n += m
        return out

    def anchors(self, data: np.ndarray, span: int):
        """Per context: anchor hash, context hash, first and last window, and the anchor's place."""
        width = span - ANCHOR + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.down[: len(data)], out=sums[1:])
        hashes = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * self.up[: len(data) - ANCHOR + 1])
        ranked = (hashes & ~_U(STRETCH - 1)) | np.arange(len(hashes), dtype=np.uint64)  # ties: the leftmost
        owner = (_sliding_least(ranked, width) & _U(STRETCH - 1)).astype(np.int64)
        cut = np.flatnonzero(owner[1:] != owner[:-1])
        lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(owner) - 1]])
        at = owner[lo]
        whole = _mix((sums[hi + span] - sums[lo]) * self.up[lo] + (at - lo).astype(np.uint64) * _U(0x2545F4914F6CDD1D) + (hi - lo).astype(np.uint64))
        return hashes[at], whole, lo, hi, at


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours: running leasts within blocks from the left and from the right."""
    blocks = np.full(-(-len(values) // width) * width, _U(0xFFFFFFFFFFFFFFFF))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


_ROLLING: list[_Rolling] = []


def text_contexts(data: bytes, span: int):
    """Arrays (anchor, context, lo, hi, at) for a whole text; nothing if it is shorter than ``span``."""
    if not _ROLLING:
        _ROLLING.append(_Rolling())
    raw, parts = np.frombuffer(data, np.uint8), []
    step = STRETCH - span + 1
    for a in range(0, max(1, len(raw) - span + 1), step):
        piece = raw[a : a + STRETCH]
        if len(piece) >= span:
            anchor, whole, lo, hi, at = _ROLLING[0].anchors(piece, span)
            parts.append((anchor.view(np.int64), whole.view(np.int64), lo + a, hi + a, at + a))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


def repeated_windows(contexts: list[tuple[bytes, int, int]], span: int) -> list[dict[int, int]]:
    """Per context ``(bytes, number of windows, offset of the anchor)``: its windows' classes, by offset.

    Windows have the same class if their ``span`` bytes are equal. All contexts hold the same anchor, which
    stands as one symbol in the suffix array's text. No window starts after it, so the bytes that follow stand
    seven to a symbol, counted from the anchor: the order of such symbols is that of their bytes.
    """
    text: list[int] = []
    starts: list[tuple[int, int] | None] = []
    for c, (data, windows, at) in enumerate(contexts):
        starts += [(c, k) if k < windows else None for k in range(at + 1)]
        text += [x + 2 for x in data[:at]]
        text.append(1)
        tail = [int.from_bytes(data[i : i + 7].ljust(7, b"\0"), "big") + 2 for i in range(at + ANCHOR, len(data), 7)]
        text += tail
        text.append(0)
        starts += [None] * (len(tail) + 1)
    classes: list[dict[int, int]] = [{} for _ in contexts]
    label, held = -1, None
    for i in suffix_array(text):
        if starts[i] is not None:
            c, k = starts[i]
            window = contexts[c][0][k : k + span]
            if window != held:
                label, held = label + 1, window
            classes[c][k] = label
    return classes


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Ascending places as (first, last) of each run."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by ``doc_id`` and a hash of the text, so that rows repeated under one id are told apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _packed(docs: DataFrame, keep_empty: bool) -> DataFrame:
    """Keyed texts as zstandard frames: half the bytes to shuffle."""

    def press(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "h", "z"])

    rows = _keyed(docs)
    return (rows if keep_empty else rows.where("text <> ''")).mapInArrow(lean(press), "doc_id long, h long, z binary")


def _same_doc(left: str, right: str):
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.h") == F.col(f"{right}.h"))


def repeated_spans(docs: DataFrame, span: int, folder: str) -> DataFrame:
    """``(doc_id, h, lo, hi)``: every byte from lo to hi - 1 lies in a string of ``span`` bytes that starts at
    another place of the corpus too. Spans may overlap. Groups of equal contexts are counted before they are
    shuffled, joins on anchors are left to Spark's skew handling, and an anchor with many contexts is cut into
    blocks, so no anchor however common comes to one task."""

    def find(batches):
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(7)]
            for d, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                got = text_contexts(t.encode("utf-8", "surrogatepass"), span)
                if got is not None:
                    anchor, whole, lo, hi, at = got
                    n = len(lo)
                    for c, x in zip(cols, (anchor, whole, np.full(n, -1 if d is None else d), np.full(n, d is None), np.full(n, h), lo, np.stack([hi - lo + 1, at - lo], 1))):
                        c.append(x)
            if cols[0]:
                a, c, d, null, h, lo, more = (np.concatenate(x) for x in cols)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(d, mask=null), pa.array(h), pa.array(lo.astype(np.int32)), pa.array(more[:, 0].astype(np.int32)), pa.array(more[:, 1].astype(np.int32))], names=["a", "c", "doc_id", "h", "lo", "windows", "off"])

    long_enough = _keyed(docs).where(F.octet_length("text") >= span)
    found = long_enough.mapInArrow(lean(find), "a long, c long, doc_id long, h long, lo int, windows int, off int")
    anchors = found.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("n > 1").select("a", (F.col("c1") == F.col("c2")).alias("alike"))
    shared = settle(found.join(anchors, "a"), f"{folder}/shared")
    to_span = lambda df: df.select("doc_id", "h", F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("windows") + (span - 1)).cast("long").alias("hi"))
    varied = shared.where("not alike")
    contexts = varied.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "lo", "windows", "off")).alias("first"))
    contexts = settle(contexts, f"{folder}/contexts")
    many = contexts.groupBy("a").agg(F.count("*").alias("n_contexts"))
    alike = varied.join(contexts.where("n > 1").select("a", "c"), ["a", "c"], "left_semi")
    spans = to_span(shared.where("alike")).unionByName(to_span(alike))

    # the bytes of one occurrence of each context
    wanted = contexts.join(many, "a").select("first.*", "a", "n", F.pmod(F.col("c"), F.ceil(F.col("n_contexts") / BLOCK)).cast("int").alias("block"), F.when(F.col("n_contexts") > BLOCK, F.ceil(F.col("n_contexts") * BLOCK / DIGESTS_PER_GROUP)).otherwise(0).cast("int").alias("cut"))
    by_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "block", "cut", "n", "lo", "windows", "off")).alias("wanted"))

    def fetch(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for d, h, z, wanted_here in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = unpack(z)
                rows += [(w["a"], w["block"], w["cut"], w["n"] > 1, d, h, w["lo"], w["windows"], w["off"], data[w["lo"] : w["lo"] + w["windows"] + span - 1]) for w in wanted_here]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 10, kinds)], names=["a", "block", "cut", "alike", "doc_id", "h", "lo", "windows", "off", "data"])

    pieces = _packed(docs, False).alias("d").join(by_doc.alias("w"), _same_doc("d", "w")).select("d.doc_id", "d.h", "z", "wanted")
    pieces = pieces.mapInArrow(lean(fetch), "a long, block int, cut int, alike boolean, doc_id long, h long, lo int, windows int, off int, data binary")
    tasks = max(1, -(-contexts.count() // CONTEXTS_PER_TASK))
    dealt = pieces.repartition(tasks, "a", "block").sortWithinPartitions("a", "block", "doc_id", "h", "lo")

    def judge(batches):
        names = ["a", "doc_id", "h", "lo", "hi", "part", "digests", "windows"]

        def emit(rows):
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], names=names)

        def close(group, out):
            a, _, cut = group[0][:3]
            once: dict[tuple, tuple] = {(g[4], g[5], g[6]): g for g in group}  # a row repeated under its id came twice
            group = list(once.values())
            classes = repeated_windows([(g[9], g[7], g[8]) for g in group], span)
            times: dict[int, int] = {}
            for found_here in classes:
                for label in found_here.values():
                    times[label] = times.get(label, 0) + 1
            told: set[int] = set()
            for g, found_here in zip(group, classes):
                _, _, _, alike_here, d, h, lo, windows, _, data = g
                repeated = [k for k in sorted(found_here) if times[found_here[k]] > 1]
                if not alike_here:
                    out += [(a, d, h, lo + p, lo + q + span, None, None, None) for p, q in _runs(repeated)]
                parts: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
                for k, label in found_here.items() if cut else ():
                    settled = alike_here or times[label] > 1
                    if settled and label in told:
                        continue
                    told.add(label)
                    digest = hashlib.blake2b(data[k : k + span], digest_size=16).digest()
                    parts.setdefault((int.from_bytes(digest[:4], "big") % cut, settled), []).append((digest, k))
                for (part, settled), found in parts.items():
                    out.append((a, d, h, lo, None, part, b"".join(x for x, _ in found), b"" if settled else np.array([k for _, k in found], "<i4").tobytes()))

        group, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(10))):
                if group and row[:2] != group[0][:2]:
                    close(group, out)
                    group = []
                    if len(out) > 20_000:
                        yield emit(out)
                        out = []
                group.append(row)
        if group:
            close(group, out)
        yield emit(out)

    judged = settle(dealt.mapInArrow(lean(judge), "a long, doc_id long, h long, lo long, hi long, part int, digests binary, windows binary"), f"{folder}/judged")

    def across(batches):
        """Windows whose digest another block has too; a block names each of its digests once."""

        def close(group):
            times: dict[bytes, int] = {}
            for _, _, _, _, _, digests, _ in group:
                for i in range(0, len(digests), 16):
                    times[digests[i : i + 16]] = times.get(digests[i : i + 16], 0) + 1
            for _, _, d, h, lo, digests, windows in group:
                places = np.frombuffer(windows, "<i4").tolist()
                again = sorted(k for i, k in enumerate(places) if times[digests[16 * i : 16 * i + 16]] > 1)
                yield from ((d, h, lo + p, lo + q + span) for p, q in _runs(again))

        group, out = [], []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if group and row[:2] != group[0][:2]:
                    out += close(group)
                    group = []
                group.append(row)
        out += close(group)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [[]] * 4], names=["doc_id", "h", "lo", "hi"])

    named = judged.where("part is not null").select("a", "part", "doc_id", "h", "lo", "digests", "windows")
    more = named.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(lean(across), "doc_id long, h long, lo long, hi long")
    return spans.unionByName(judged.where("part is null").select("doc_id", "h", "lo", "hi")).unionByName(more)


def cut_documents(docs: DataFrame, span: int = 200) -> DataFrame:
    """``(doc_id, h, n_bytes, n_removed, n_spans, kept binary, removed array<struct<lo,hi>>)`` for every row.

    Each byte covered by a string of ``span`` bytes that also starts anywhere else is removed (strings are judged
    on the input, they may overlap, and matches never cross documents). Texts count as UTF-8 bytes, null as
    empty; a text shorter than ``span`` stays whole; of repeated rows each stays a row; no rows give none.
    """
    folder = shared_dir(docs.sparkSession, "suffix")
    spans = repeated_spans(docs, span, folder).groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    rows = _packed(docs, True).alias("d").join(spans.alias("s"), _same_doc("d", "s"), "left").select("d.doc_id", "d.h", "z", "spans")

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for d, h, z, marks in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data, runs = unpack(z), []
                for lo, hi in sorted((m["lo"], m["hi"]) for m in marks or []):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                edges = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((d, h, len(data), len(data) - len(kept), len(runs), kept, [{"lo": a, "hi": b} for a, b in runs]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 7, kinds)], names=["doc_id", "h", "n_bytes", "n_removed", "n_spans", "kept", "removed"])

    return rows.mapInArrow(lean(cut), "doc_id long, h long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<lo:long,hi:long>>")


def without_repeats(spark: SparkSession, docs: DataFrame, span: int = 200) -> DataFrame:
    """The documents without their repeated strings, other columns unchanged; ``n_chars`` follows the text.

    A character of which a byte stays is kept whole, so texts stay valid. Removed runs are applied by character.
    ``doc_id`` must be unique, or rows must be equal where it isn't.
    """
    cut = cut_documents(docs, span).where("n_removed > 0").select("doc_id", "h", "removed")
    text, names = F.coalesce(F.col("text").cast("string"), F.lit("")), docs.columns

    def rewrite(batches):
        for batch in batches:
            texts = []
            for t, runs in zip(batch.column("text").to_pylist(), batch.column("__removed").to_pylist()):
                if runs:
                    data = t.encode("utf-8", "surrogatepass")
                    gone = np.zeros(len(data) + 1, np.int64)
                    for r in runs:
                        gone[r["lo"]] += 1
                        gone[r["hi"]] -= 1
                    gone = np.cumsum(gone[:-1]) > 0
                    letters = np.cumsum((np.frombuffer(data, "u1") & 0xC0) != 0x80) - 1
                    whole = np.ones(letters[-1] + 1, bool)
                    whole[letters[~gone]] = False  # characters all of whose bytes go
                    t = np.frombuffer(data, "u1")[~whole[letters]].tobytes().decode("utf-8", "surrogatepass")
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    keyed = docs.withColumn("__h", F.xxhash64(text))
    runs = cut.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h2"), F.col("removed").alias("__removed")).dropDuplicates(["__id", "__h2"])
    joined = keyed.join(runs, keyed["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__h2")), "left").drop("__h", "__h2", "__id")
    out = joined.mapInArrow(lean(rewrite), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
