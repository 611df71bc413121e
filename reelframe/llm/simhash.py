"""SimHash near-duplicates: fingerprints and a Gray-order hierarchical index joined against itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelframe.llm.cluster import components, lean, settle, shared_dir

BITS = 64
#: Fingerprints aimed at in an index node; decides how many leading bits name a node.
NODE_SIZE = 256
#: Fingerprints of a node that travel together; a larger node is cut into several packs.
PACK_SIZE = 1024
#: Fingerprints under one lowest inner node.
LEAF_SIZE = 16
#: Words of 64 bits of the fingerprints that find candidates for a similarity.
WIDE_WORDS = 4
#: Such fingerprints aimed at in a node of one table.
WIDE_NODE_SIZE = 256
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle in order: ``width`` ASCII-lower-cased words, or all if there are fewer; no words, none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII alone
    joined, digest, n = b" ".join(words), xxhash.xxh64_intdigest, len(words) - width + 1
    if n <= 1:
        return np.array([digest(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())), np.uint64, n)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 bits whether over half of the hashes have it, eight bits a byte."""
    octets = hashes.astype("<u8").view("u1").reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS_OF_BYTE for k in range(8)])
    return np.packbits(2 * counts > len(hashes), bitorder="little")


def _fingerprint(text: str | None, width: int, seed: int) -> int:
    return int(_majority(_hashes(text, width, seed)).view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp long)`` of each whole text: a bit is set if it is set in over half its shingles' hashes.

    Shingles are ``width`` ASCII-lower-cased words; fewer words make one shingle; no words (null, empty) give 0.
    Repeated rows each get a row; other columns are ignored. ``fp`` holds the 64 bits as a signed number.
    """

    def hashed(batches):
        for batch in batches:
            fps = np.array([_fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(hashed), "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray code, where neighbours differ in one bit."""
    rank = fp.astype(np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(step))
    return rank


class Level:
    """Nodes over consecutive runs of the level below: the bits all their fingerprints share, and those bits."""

    def __init__(self, shared: np.ndarray, bits: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.shared, self.bits, self.starts, self.stops = shared, bits, starts, stops

    @classmethod
    def over(cls, shared: np.ndarray, bits: np.ndarray, size: int) -> Level:
        starts = np.arange(0, len(bits), size)
        ones = np.bitwise_and.reduceat(bits | ~shared, starts)  # set wherever all have a shared 1
        zeros = np.bitwise_and.reduceat(~bits | ~shared, starts)
        known = np.bitwise_and.reduceat(shared, starts)
        same = known & (ones | zeros)
        return cls(same, ones & same, starts, np.minimum(starts + size, len(bits)))


def levels(ordered: np.ndarray) -> list[Level]:
    """The hierarchy over fingerprints in Gray order, leaves first, up to one root."""
    found = [Level(np.full(len(ordered), _ALL), ordered, np.arange(len(ordered)), np.arange(len(ordered)) + 1)]
    while len(found[-1].bits) > 1:
        found.append(Level.over(found[-1].shared, found[-1].bits, LEAF_SIZE))
    return found


def near_pairs(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs, one of each, that differ in ``most`` bits or fewer.

    Both are in Gray order. Pairs of nodes are compared on the bits that both sides share; those differences
    hold for everything below, so a pair of nodes with more than ``most`` is left with all its descendants.
    """
    a, b = levels(left), levels(right)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    at_a, at_b = len(a) - 1, len(b) - 1
    while True:
        x, y = a[at_a], b[at_b]
        apart = np.bitwise_count((x.bits[i] ^ y.bits[j]) & x.shared[i] & y.shared[j])
        i, j = i[apart <= most], j[apart <= most]
        if at_a == 0 and at_b == 0 or not len(i):
            return i, j
        if at_a >= at_b:
            i, j, at_a = *_below(x, i, j), at_a - 1
        else:
            j, i, at_b = *_below(y, j, i), at_b - 1


def _below(level: Level, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's children instead of it, paired with what it was paired with."""
    sizes = (level.stops - level.starts)[i]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(level.starts[i], sizes) + inner, np.repeat(j, sizes)


def spanning(a: np.ndarray, b: np.ndarray, parent: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what ``zip(a, b)`` connects: one fewer than there are members of each component.

    With the same ``parent`` over several calls, only what the calls before haven't connected is returned.
    """
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def gray_rank_column(view: Column) -> Column:
    """`gray_rank` of a signed 64-bit column."""
    for step in (1, 2, 4, 8, 16, 32):
        view = view.bitwiseXOR(F.shiftrightunsigned(view, step))
    return view


def gray_packs(rows: DataFrame, lead: int, carried: list[str]) -> DataFrame:
    """The index's packs over ``rows(table int, view long, *carried binary)`` of one or more tables.

    Rows are range-partitioned in Gray order, so a node, which is a pattern of ``lead`` leading bits, is a run of
    it, and a node with many rows is cut into shorter runs, however they are spread. A pack is a run of up to
    `PACK_SIZE` rows of one node: ``(table, node, pack, shared, bits, views, *carried)`` with the bits that all its
    views share, and views and carried columns one after another. Equal views are told apart by the first carried column.
    """
    shift, kinds = np.uint64(BITS - lead) if lead else np.uint64(0), [pa.binary()] * (1 + len(carried))
    names = ["table", "node", "pack", "shared", "bits", "views", *carried]

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            tables, views = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            nodes = views >> shift if lead else np.zeros(len(views), np.uint64)
            cuts = np.flatnonzero((tables[1:] != tables[:-1]) | (nodes[1:] != nodes[:-1])) + 1
            starts = [k for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(views)]) for k in range(a, b, PACK_SIZE)]
            stops = np.minimum(np.array([*starts[1:], len(views)]), np.array(starts) + PACK_SIZE).tolist()
            ones, zeros = np.bitwise_and.reduceat(views, starts), np.bitwise_and.reduceat(~views, starts)
            held = [batch.column(2 + k).to_pylist() for k in range(len(carried))]
            raw = views.astype("<u8").tobytes()
            columns = [[raw[8 * a : 8 * b] for a, b in zip(starts, stops)], *([b"".join(h[a:b]) for a, b in zip(starts, stops)] for h in held)]
            fixed = [pa.array(tables[starts]), pa.array(nodes[starts].view(np.int64)), pa.array(number + np.arange(len(starts))), pa.array((ones | zeros).view(np.int64)), pa.array(ones.view(np.int64))]
            number += len(starts)
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    ranked = rows.select("table", gray_rank_column(F.col("view")).alias("__rank"), *carried)
    order = ["table", "__rank", *carried[:1]]  # what is sampled for the ranges stays short
    view = F.col("__rank").bitwiseXOR(F.shiftrightunsigned("__rank", 1)).alias("view")  # back from its rank
    ordered = ranked.repartitionByRange(*order).sortWithinPartitions(*order).select("table", view, *carried)
    return ordered.mapInArrow(lean(pack), "table int, node long, pack long, shared long, bits long, views binary" + "".join(f", {c} binary" for c in carried))


def pack_pairs(packs: DataFrame, masks: list[int], most: int, carried: list[str], own: bool = True) -> DataFrame:
    """Pairs of `gray_packs` that can hold views ``most`` bits apart, each once: columns and ``their_`` columns.

    They are met by equality: each pack goes to the patterns that differ from its own by one of ``masks``. Pairs
    whose shared bits alone differ too much are left out, and a pack's pair with itself unless ``own``.
    """
    held = ["pack", "shared", "bits", "views", *carried]
    sent = packs.withColumn("to", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("node").bitwiseXOR(m)))).where("to >= node")
    theirs = packs.select("table", F.col("node").alias("to"), *(F.col(c).alias(f"their_{c}") for c in held))
    pairs = sent.join(theirs, ["table", "to"]).where("to > node or their_pack >= pack" if own else "to > node or their_pack > pack")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("their_bits")).bitwiseAND(F.col("shared")).bitwiseAND(F.col("their_shared")))
    return pairs.where(apart <= most).select("table", *(c for h in ["views", *carried] for c in (h, f"their_{h}")))


def link_fingerprints(distinct: DataFrame, folder: str, most: int = 2, node_size: int = NODE_SIZE) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` differing in ``most`` bits or fewer, none further apart.

    The index's upper nodes are leading-bit patterns; their number follows the number of fingerprints. Every pack
    goes to the patterns that differ from its own in up to ``most`` bits, and no other pair of nodes can hold a
    link. Within a pair of packs the hierarchy is descended by `near_pairs`. A pair of packs returns links that
    span its components, never all pairs.
    """
    count = distinct.count()
    lead = min(24, max(0, int(np.ceil(np.log2(max(1, count) / node_size)))))
    packs = settle(gray_packs(distinct.select(F.lit(0).alias("table"), F.col("fp").alias("view")), lead, []), f"{folder}/packs")
    pairs = pack_pairs(packs, [0, *_patterns(lead, most)], most, []).drop("table")

    def compare(batches):
        for batch in batches:
            found = []
            for x, y in zip(batch.column(0), batch.column(1)):
                left, right = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                i, j = near_pairs(left, right, most)
                p, q = left[i].view(np.int64), right[j].view(np.int64)
                apart = p != q
                found += spanning(p[apart], q[apart])
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return pairs.mapInArrow(lean(compare), "a long, b long")


def _patterns(bits: int, most: int) -> list[int]:
    """Masks with 1 to ``most`` of the lowest ``bits`` bits set."""
    found, last = [], [0]
    for _ in range(min(most, bits)):
        last = sorted({m | 1 << k for m in last for k in range(bits) if not m >> k & 1})
        found += last
    return found


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)``: component_id is the smallest doc_id reachable over fingerprints that
    differ in ``most`` bits or fewer.

    Equal fingerprints are grouped before anything is compared, so a group of copies is one entry however large.
    A null doc_id is reachable but never a component's name unless nothing else is; no rows give no rows.
    """
    folder = shared_dir(docs.sparkSession, "simhash")
    rows = settle(fingerprints(docs, width), f"{folder}/fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), f"{folder}/distinct")
    roots = components(link_fingerprints(distinct.select("fp"), folder, most), "simhash")
    # components are named by their smallest fingerprint first, then by their smallest document
    named = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(names, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def _shingles(text: str, width: int) -> set[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII alone
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _wide_fingerprint(text: str, width: int, seed: int) -> bytes:
    """`WIDE_WORDS` words of 64 bits over the text's different shingles; no words: zero."""
    mixed, out = np.unique(_hashes(text, width, seed)), []
    for _ in range(WIDE_WORDS):
        out.append(_majority(mixed).tobytes())
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # the next word's hashes
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return b"".join(out)


def _differing_share(similarity: float) -> float:
    """Share of a fingerprint's bits that differ on average between sets of this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _radius(bits: int, share: float) -> int:
    """Differing bits that a pair at this share has at most, but for one in about two thousand."""
    return int(np.ceil(bits * share + 3.4 * np.sqrt(bits * share * (1 - share))))


def _tables(lead: int, share: float, miss: float = 0.02) -> int:
    """How many keys of ``lead`` bits leave a miss this rare for a pair whose whole fingerprints differ by one
    standard deviation more than on average."""
    bits = BITS * WIDE_WORDS
    met = (1 - share - np.sqrt(share * (1 - share) / bits)) ** lead
    return 1 if met >= 1 else int(np.ceil(np.log(miss) / np.log(1 - met)))


def _views(fingerprints: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """``(table, view, entry)`` of ``fingerprints(id, wide, *numbers, *carried binary)`` for each table's draw of bits: an
    entry is id, numbers and wide fingerprint as 64-bit numbers; ``carried`` columns follow unchanged."""
    kinds = dict(fingerprints.dtypes)
    numbers = [c for c in fingerprints.columns if c != "wide" and kinds[c] == "bigint"]
    carried = [c for c in fingerprints.columns if c != "wide" and kinds[c] == "binary"]

    def viewed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column("wide").to_pylist()), "u1").reshape(batch.num_rows, -1)
            bits = np.unpackbits(words, axis=1, bitorder="little")
            fixed = [batch.column(c).to_numpy().astype("<i8").view("u1").reshape(-1, 8) for c in numbers]
            entries = pa.array([e.tobytes() for e in np.concatenate([*fixed, words], axis=1)], pa.binary())
            for t, places in enumerate(chosen):  # the first place is the highest bit
                view = np.ascontiguousarray(np.packbits(bits[:, places], axis=1)).view(">u8").ravel().astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(view), entries, *map(batch.column, carried)], names=["table", "view", "entry", *carried])

    return fingerprints.mapInArrow(lean(viewed), "table int, view long, entry binary" + "".join(f", {c} binary" for c in carried))


def _plan(count: int, share: float) -> tuple[int, list[np.ndarray]]:
    """Leading bits of a node for so many fingerprints, and the bits that each table draws."""
    lead = min(32, max(0, int(np.ceil(np.log2(max(1, count) / WIDE_NODE_SIZE)))))
    draw = np.random.default_rng(64)
    return lead, [draw.permutation(BITS * WIDE_WORDS)[:BITS] for _ in range(_tables(lead, share))]


def _met_packs(packs: DataFrame, narrow: int, carried: list[str], several: DataFrame | None = None) -> DataFrame:
    """Pairs of packs of one node, each with itself too: columns and ``their_`` columns.

    ``several``, if given, stands for the packs of `_shared_nodes`.
    """
    own = packs.select(*(c for h in ["views", *carried] for c in (F.col(h), F.col(h).alias(f"their_{h}"))))
    other = pack_pairs(_shared_nodes(packs) if several is None else several, [0], narrow, carried, False)
    return own.unionByName(other.drop("table"))


def _shared_nodes(packs: DataFrame) -> DataFrame:
    """Packs of nodes that have several."""
    several = packs.groupBy("table", "node").count().where("count > 1").select("table", "node")
    return packs.join(several, ["table", "node"], "left_semi")


def _entries(raw: bytes, numbers: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, numbers + WIDE_WORDS)


def _crowded(packs: DataFrame, narrow: int, wide: int, keep: int) -> DataFrame:
    """``packs`` with ``crowded``, a byte for each entry: whether it has more than ``keep`` candidates in its own pack."""

    def count(batches):
        for batch in batches:
            found = []
            for x, mine in zip(batch.column("views"), batch.column("entry")):
                views, entries = np.frombuffer(x.as_py(), "<u8"), _entries(mine.as_py(), 2)
                all_i, all_j = near_pairs(views, views, narrow)
                partners = np.zeros(len(views), np.int64)
                for k in range(0, len(all_i), _PAIRS_HELD):
                    i, _, _ = _apart(entries, entries, all_i[k : k + _PAIRS_HELD], all_j[k : k + _PAIRS_HELD], wide)
                    partners += np.bincount(i, minlength=len(views))
                found.append((partners > keep).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, "crowded"])

    names = ["table", "node", "pack", "shared", "bits", "views", "entry"]
    return packs.select(*names).mapInArrow(lean(count), "table int, node long, pack long, shared long, bits long, views binary, entry binary, crowded binary")


def candidate_links(fingerprints: DataFrame, folder: str, share: float, keep: int) -> DataFrame:
    """``(a, b, more)``: partners b of ``fingerprints(id, wide, grp)`` a of another ``grp`` that may be as near as
    ``share`` of the bits. Of two fingerprints that are such partners one lists the other, or both have ``more``.

    Several tables of the index are used. A table's view of a fingerprint is 64 of its bits, drawn anew for each
    table; nodes, packs, Gray order and levels are those of `link_fingerprints`, and packs meet where their nodes'
    patterns are equal. The number of leading bits follows the number of fingerprints, the number of tables the
    share of pairs that a table misses.

    A task lists all partners of a fingerprint that meets up to ``keep``, and of others the nearest and the smallest, with
    ``more``. Who has more than ``keep`` in its own pack has ``more`` from there and lists none from other packs. So a
    group that fills many packs gives a few rows a fingerprint and table, not some for each pair of its packs.
    """
    lead, chosen = _plan(fingerprints.count(), share)
    narrow, wide = _radius(BITS, share), _radius(BITS * WIDE_WORDS, share)
    packs = settle(gray_packs(_views(fingerprints.select("id", "wide", "grp"), chosen), lead, ["entry"]), f"{folder}/packs")
    several = settle(_crowded(_shared_nodes(packs), narrow, wide, keep), f"{folder}/several")
    pairs = _met_packs(packs.withColumn("crowded", F.lit(b"")), narrow, ["entry", "crowded"], several)

    def compare(batches):
        held, size = [_NONE], 0  # combined in the task: a fingerprint meets several packs, in several tables

        def rows(listed):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in _once(listed)], names=["a", "b", "apart", "more"])

        for batch in batches:
            for x, y, mine, its, crowded, theirs in zip(*(batch.column(k) for k in range(6))):
                all_i, all_j = near_pairs(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), narrow)
                left, right = _entries(mine.as_py(), 2), _entries(its.as_py(), 2)
                free, their_free = (~np.frombuffer(c.as_py(), bool) for c in (crowded, theirs))
                listed = [_NONE]
                for k in range(0, len(all_i), _PAIRS_HELD):
                    i, j, apart = _apart(left, right, all_i[k : k + _PAIRS_HELD], all_j[k : k + _PAIRS_HELD], wide)
                    p, q = left[i, 0], right[j, 0]
                    if len(free):
                        forth, back = free[i], their_free[j]
                        p, q, apart = np.concatenate([p[forth], q[back]]), np.concatenate([q[forth], p[back]]), np.concatenate([apart[forth], apart[back]])
                    listed.append(_listed((p, q, apart, np.zeros(len(p), bool)), keep))  # with itself a pack has both ways
                held.append(_listed(tuple(map(np.concatenate, zip(*listed))), keep))
                size += len(held[-1][0])
                if size > ROWS_COMBINED:
                    held = [_listed(tuple(map(np.concatenate, zip(*held))), keep)]
                    size = len(held[0][0])
                    if size > ROWS_COMBINED // 2:
                        yield rows(held[0])
                        held, size = [_NONE], 0
        yield rows(_listed(tuple(map(np.concatenate, zip(*held))), keep))

    found = pairs.mapInArrow(lean(compare), "a long, b long, apart long, more boolean").distinct()
    each = Window.partitionBy("a", "more")  # tasks name several nearest and smallest; what others list stays
    ranked = found.withColumn("place", F.row_number().over(each.orderBy("apart", "b"))).withColumn("least", F.min("b").over(each))
    return ranked.where(~F.col("more") | (F.col("place") == 1) | (F.col("b") == F.col("least"))).select("a", "b", "more")


#: Pairs of a pack with another that are looked at together; bounds memory alone.
_PAIRS_HELD = 1 << 17


def _apart(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs of entries of different groups whose wide fingerprints, the last numbers, differ in ``most`` bits or
    fewer, and in how many."""
    other = left[i, 1] != right[j, 1]
    i, j, first = i[other], j[other], left.shape[1] - WIDE_WORDS
    apart = sum(np.bitwise_count((left[i, w] ^ right[j, w]).view(np.uint64)).astype(np.int64) for w in range(first, left.shape[1]))
    near = apart <= most
    return i[near], j[near], apart[near]


#: Rows of partners that a task combines before it passes them on.
ROWS_COMBINED = 400_000
#: Partners that a fingerprint lists from a task in the rounds that look at texts; who has more is decided in packs, with
#: all partners at once.
ROUNDS = (1, 4)
_NONE = (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool))


def _listed(rows: tuple[np.ndarray, ...], keep: int) -> tuple[np.ndarray, ...]:
    """Of rows (a, b, apart, more) all of each a that has up to ``keep`` and no ``more`` yet; of another a the nearest, by
    (apart, b), and the one with its smallest b, with ``more``."""
    a, b, apart, more = rows
    if not len(a):
        return rows
    order = np.lexsort((b, apart, a))
    a, b, apart, more = (x[order] for x in rows)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lengths = np.diff(np.append(starts, len(a)))
    more = np.repeat(np.logical_or.reduceat(more, starts), lengths)
    fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]  # several tables find the same pair
    a, b, apart, more = a[fresh], b[fresh], apart[fresh], more[fresh]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    lengths = np.diff(np.append(starts, len(a)))
    more |= np.repeat(lengths > keep, lengths)
    place = np.arange(len(a)) - np.repeat(starts, lengths)
    some = ~more | (place == 0) | (b == np.repeat(np.minimum.reduceat(b, starts), lengths))
    return a[some], b[some], apart[some], more[some]


def _once(rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Rows of `_listed`, but of two without ``more`` that list each other one."""
    a, b, _, more = rows
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((low, high, more))
    low, high = low[order], high[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = more[order][1:] | (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    return tuple(x[order][fresh] for x in rows)


#: Shingles that are told apart at once, and pairs, when sets of shingles are compared.
_SHINGLES_AT_ONCE, _PAIRS_AT_ONCE = 8192, 20_000


def _alike(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs (i, j) of sets ``left[i]`` and ``right[j]``, sorted numbers without repeats, are this similar."""
    rows, cols = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    sets = [left[k] for k in rows[0]] + [right[k] for k in cols[0]]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1  # what one set alone has is in no intersection
    owner, at = owner[common[at]], (np.cumsum(common) - 1)[at[common[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    i, j = rows[1], len(rows[0]) + cols[1]
    shared = np.zeros(len(i), np.int64)
    for first in range(0, int(common.sum()), _SHINGLES_AT_ONCE):
        a, b = np.searchsorted(at, [first, first + _SHINGLES_AT_ONCE])
        grid = np.zeros((len(sets), min(_SHINGLES_AT_ONCE, int(common.sum()) - first)), bool)
        grid[owner[a:b], at[a:b] - first] = True
        packed = np.packbits(np.pad(grid, ((0, 0), (0, -grid.shape[1] % 64))), axis=1).view(np.uint64)
        for k in range(0, len(i), _PAIRS_AT_ONCE):
            some = slice(k, k + _PAIRS_AT_ONCE)
            shared[some] += np.bitwise_count(packed[i[some]] & packed[j[some]]).sum(1, dtype=np.int64)
    return shared >= similarity * (sizes[i] + sizes[j] - shared)


def decided_links(fingerprints: DataFrame, folder: str, share: float, similarity: float) -> DataFrame:
    """Links ``(a, b)`` that connect all candidates among ``fingerprints(id, wide, grp, size, sets)`` of different ``grp``
    whose sets, ``size`` sorted 64-bit hashes, are this similar.

    Candidates are those of `candidate_links`, all of them: sets travel with the packs, a pair of packs decides its
    candidates on the spot, and a task returns links that span what is alike, never all pairs.
    """
    lead, chosen = _plan(fingerprints.count(), share)
    narrow, wide = _radius(BITS, share), _radius(BITS * WIDE_WORDS, share)
    packs = settle(gray_packs(_views(fingerprints.select("id", "wide", "grp", "size", "sets"), chosen), lead, ["entry", "sets"]), f"{folder}/packs")

    def compare(batches):
        parent: dict[int, int] = {}  # over the whole task
        for batch in batches:
            found = []
            for x, y, mine, its, sets, their_sets in zip(*(batch.column(k) for k in range(6))):
                all_i, all_j = near_pairs(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), narrow)
                left, right = _entries(mine.as_py(), 3), _entries(its.as_py(), 3)
                cut = None
                for k in range(0, len(all_i), _PAIRS_HELD):
                    i, j, _ = _apart(left, right, all_i[k : k + _PAIRS_HELD], all_j[k : k + _PAIRS_HELD], wide)
                    if len(i):
                        cut = cut or [np.split(np.frombuffer(z.as_py(), "<u8"), np.cumsum(e[:, 2])[:-1]) for z, e in ((sets, left), (their_sets, right))]
                        keep = _alike(i, j, *cut, similarity)
                        found += spanning(left[i[keep], 0], right[j[keep], 0], parent)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return _met_packs(packs, narrow, ["entry", "sets"]).mapInArrow(lean(compare), "a long, b long").distinct()


def similar_links(links: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of ``links(a, b)`` whose ``texts(id, text)`` have shingle sets of this Jaccard similarity or more.

    Links of one ``b`` in a row have its shingles taken once; Spark splits a join in which one is very common.
    """
    first = links.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        last, mine = None, set()
        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if b != last:
                    last, mine = b, _shingles(y, width)
                others = _shingles(x, width)
                common = len(mine & others)
                if common >= similarity * (len(mine) + len(others) - common):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    return both.mapInArrow(lean(check), "a long, b long")


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``: component_id is the smallest doc_id reachable over pairs of documents whose sets
    of ``width``-word shingles have this Jaccard similarity or more.

    Candidates come from the Gray-order index over wide SimHash fingerprints; each is decided by its shingles.
    Equal texts are one entry. In a few rounds an entry is held against its candidates that aren't in its group yet if
    they are few, else against the nearest and the smallest of them; entries that have more then travel with their sets of
    shingles, and pairs of packs decide all candidates that are left. So no group's pairs are listed,
    nothing unlike is linked, and every candidate is decided; a pair at the threshold is missed only where no table
    of the index holds both, at most a fiftieth of such pairs by design. Texts without words (null, empty, white
    space) are alike. A null doc_id is reachable but never a component's name unless nothing else is. Repeated rows
    each get a row; no rows give none.
    """
    folder = shared_dir(docs.sparkSession, "similar")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))

    def hashed(batches):
        for batch in batches:
            wide = [_wide_fingerprint(t, width, 42) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide, pa.binary())], names=["doc_id", "key", "wide"])

    rows = settle(keyed.mapInArrow(lean(hashed), "doc_id long, key binary, wide binary"), f"{folder}/rows")
    entries = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("wide").alias("wide"))
    entries = settle(entries.withColumn("id", F.monotonically_increasing_id()), f"{folder}/entries")
    share = _differing_share(similarity)
    active = entries.select("id", "wide", F.col("id").alias("grp"))
    texts = tested = alike = groups = None
    for turn, keep in enumerate(ROUNDS):
        met = settle(candidate_links(active, f"{folder}/{turn}", share, keep), f"{folder}/{turn}/met")
        links = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        links = settle(links if tested is None else links.join(tested, ["a", "b"], "left_anti"), f"{folder}/{turn}/links")
        if texts is None:  # later rounds look among the entries of the first one's links
            wanted = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
            named = entries.join(wanted, "id", "left_semi").select("id", F.col("key").alias("k"), F.col("first").alias("f"))
            held = keyed.join(named, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("f")))
            texts = settle(held.select("id", "text").dropDuplicates(["id"]), f"{folder}/texts")
        more = settle(similar_links(links, texts, width, similarity), f"{folder}/{turn}/alike")
        if not more.isEmpty():
            alike = more if alike is None else alike.unionByName(more)
            groups = components(alike, "similar")
        # a pair that neither lists is one of two entries that both have more
        left = met.where("more").select(F.col("a").alias("id")).distinct()
        if left.isEmpty():
            break
        tested = links if tested is None else tested.unionByName(links)
        active = entries.join(left, "id").select("id", "wide")
        active = active.withColumn("grp", F.col("id")) if groups is None else active.join(groups, "id", "left").select("id", "wide", F.coalesce("root", "id").alias("grp"))
    else:
        def shingle_sets(batches):
            for batch in batches:
                sets = [np.unique(_hashes(t, width, 42)).astype("<u8") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "size", "sets"])

        sets = texts.join(active.select("id"), "id", "left_semi").select("id", "text").mapInArrow(lean(shingle_sets), "id long, size long, sets binary")
        more = settle(decided_links(active.join(sets, "id"), f"{folder}/last", share, similarity), f"{folder}/last/alike")
        if not more.isEmpty():
            groups = components(more if alike is None else alike.unionByName(more), "similar")
    named = entries.drop("wide")
    if groups is not None:
        named = named.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    else:
        named = named.withColumn("root", F.col("id"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "key").join(named.join(names, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents of which none with a smaller doc_id is in their component (`similar_documents`), all columns
    unchanged.

    Rows repeated under one doc_id are one document and stay together; rows without a doc_id stay unless one
    with a doc_id is in their component. An empty table gives none.
    """
    first = similar_documents(docs, width, similarity).where("doc_id <=> component_id").select(F.col("doc_id").alias("__first")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(F.col("__first")), "left_semi")
