"""Exact near-duplicate embeddings by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelframe.llm.cluster import components, settle, shared_dir
from reelframe.llm.simhash import spanning

#: Distinct vectors of one tree. A label with more is cut into several trees, each pair of which is compared.
TREE_SIZE = 1024
#: Reference points by which a label's vectors are grouped, so that a tree covers near vectors where there are any.
PIVOTS = 8
#: The radii of the levels halve from the largest distance of unit vectors down to below this one.
SMALLEST_RADIUS = 0.05
#: Slack for rounding in distances; candidates within it are decided by their cosine.
SLACK = 1e-6


class CoverTree:
    """Nested levels over unit vectors: level l's nodes are centres more than its radius apart, every vector is
    within a node's radius of its ancestor's centre, and radii halve from level to level. Nodes keep the largest
    distance from their centre to any vector below."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centres: list[np.ndarray] = []  # by level, point numbers
        self.children: list[list[np.ndarray]] = []  # by level, per node: nodes of the next level
        self.reach: list[np.ndarray] = []
        groups, radius = [np.arange(len(points))], 2.0
        members: list[list[np.ndarray]] = [groups]
        self.centres.append(np.array([0]))
        while radius > SMALLEST_RADIUS:
            radius /= 2
            centres, below, kids = [], [], []
            for group in members[-1]:
                first = len(centres)
                rest = group
                while len(rest):
                    centre = rest[0]
                    near = _distances(points[centre], points[rest]) <= radius
                    near[0] = True
                    centres.append(centre)
                    below.append(rest[near])
                    rest = rest[~near]
                kids.append(np.arange(first, len(centres)))
            self.centres.append(np.array(centres))
            self.children.append(kids)
            members.append(below)
            if all(len(b) == 1 for b in below):
                break
        singles = [np.array([p]) for g in members[-1] for p in g]
        if any(len(g) > 1 for g in members[-1]):  # the lowest level is the vectors themselves
            ends = np.cumsum([len(g) for g in members[-1]])
            self.children.append([np.arange(e - len(g), e) for g, e in zip(members[-1], ends)])
            self.centres.append(np.concatenate(singles) if singles else np.zeros(0, int))
            members.append(singles)
        for centres, groups in zip(self.centres, members):
            self.reach.append(np.array([_distances(points[c], points[g]).max(initial=0.0) for c, g in zip(centres, groups)]))


def _distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (many @ one)))


def near_pairs(left: CoverTree, right: CoverTree, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Point numbers of all pairs at distance ``radius`` or less (and some a rounding error further).

    Both trees are descended together. A pair of nodes whose centres are further apart than the radius and what
    both reach is left with everything below it.
    """
    a = b = 0
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(i):
        ca, cb = left.centres[a], right.centres[b]
        bound = radius + SLACK + left.reach[a][i] + right.reach[b][j]
        if len(i) * 4 > len(ca) * len(cb):
            cosine = (left.points[ca] @ right.points[cb].T)[i, j]
        else:
            cosine = np.concatenate([np.einsum("nd,nd->n", left.points[ca[i[k : k + 65536]]], right.points[cb[j[k : k + 65536]]]) for k in range(0, len(i), 65536)])
        keep = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine)) <= bound
        i, j = i[keep], j[keep]
        if a == len(left.centres) - 1 and b == len(right.centres) - 1:
            return ca[i], cb[j]
        if b == len(right.centres) - 1 or a < len(left.centres) - 1 and a <= b:
            i, j, a = *_below(left.children[a], i, j), a + 1
        else:
            j, i, b = *_below(right.children[b], j, i), b + 1
    return i, j


def _below(children: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.array([c[0] for c in children])
    sizes = np.array([len(c) for c in children])[i]
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first[i], sizes) + inner, np.repeat(j, sizes)


def _tree(block: bytes, width: int) -> tuple[np.ndarray, CoverTree]:
    raw = np.frombuffer(block, "<f8").reshape(-1, width)
    return raw, CoverTree(raw / np.linalg.norm(raw, axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, label, n_links, component_id)`` for every row of ``vectors(vec_id, embedding, label)``.

    Two rows are linked if their labels are equal and not null and the cosine, in double precision, is
    ``threshold`` or more. n_links counts the other rows linked directly; component_id is the smallest vec_id
    reachable; a null vec_id is reachable, but names a component only if no other does, and repeated vec_ids are
    rows of their own. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths never do.

    Equal vectors are one entry with its number of rows, so copies are never paired with each other. A label's
    entries are put near one of `PIVOTS` reference points (a bounded choice that only affects pruning) and cut
    into trees of up to about `TREE_SIZE`. Pairs of trees whose roots are too far apart for a link are dropped;
    for the others both trees are descended, and come out counts by entry and links that span what is linked.
    """
    spark = vectors.sparkSession
    folder = shared_dir(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = settle(rows.withColumn("usable", usable).withColumn("key", F.when(F.col("usable"), F.sha2(F.concat_ws(",", F.col("label"), F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))), f"{folder}/rows")
    entries = rows.where("usable").groupBy("key", "label").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # entries have numbers of their own, as vec_ids may be null or repeat
    entries = settle(entries.withColumn("width", F.size("v")).withColumn("entry", F.monotonically_increasing_id()), f"{folder}/entries")
    # reference points: the first few by hash of each label and width, a bounded list
    first = F.min_by(F.struct("v"), F.xxhash64("key"))
    slots = entries.groupBy("label", "width", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(PIVOTS)).alias("slot")).agg(first.alias("p"))
    points = slots.groupBy("label", "width").agg(F.sort_array(F.collect_list(F.struct("slot", "p.v"))).alias("points"), F.count("*").alias("n_points"))
    sizes = entries.groupBy("label", "width").agg(F.count("*").alias("n"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    nearest = F.array_max(F.transform("points", lambda p: F.struct((dot(F.col("v"), p["v"]) / F.sqrt(dot(p["v"], p["v"]))).alias("c"), p["slot"].alias("slot"))))["slot"]
    placed = entries.join(points, ["label", "width"]).join(sizes, ["label", "width"])
    placed = placed.withColumn("cell", F.when(F.col("n") <= TREE_SIZE, F.lit(0).cast("long")).otherwise(nearest)).select("label", "width", "entry", "copies", "v", "cell")
    placed = settle(placed, f"{folder}/placed")
    cells = placed.groupBy("label", "width", "cell").count()
    # small cells share trees: a running sum over the at most PIVOTS cells of a label; large ones are cut by hash
    order = Window.partitionBy("label", "width").orderBy("cell")
    cells = cells.withColumn("from", F.sum("count").over(order) - F.col("count")).withColumn("parts", F.ceil(F.col("count") / TREE_SIZE))
    tree = F.when(F.col("parts") > 1, F.concat(F.lit("c"), "cell", F.lit("."), F.pmod(F.xxhash64("entry"), F.col("parts")))).otherwise(F.concat(F.lit("s"), F.floor(F.col("from") / TREE_SIZE)))
    placed = placed.join(cells.drop("count"), ["label", "width", "cell"]).withColumn("tree", tree)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("entry")
        raw = np.array(frame["v"].tolist(), "<f8")
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        reach = float(_distances(unit[0], unit).max())
        head = frame.iloc[0]
        return pd.DataFrame({"label": head["label"], "width": head["width"], "tree": head["tree"], "reach": reach, "centre": [unit[0].tolist()], "entries": [frame["entry"].to_numpy("<i8").tobytes()], "copies": [frame["copies"].to_numpy("<i8").tobytes()], "block": [raw.tobytes()]})

    made = "label string, width int, tree string, reach double, centre array<double>, entries binary, copies binary, block binary"
    trees = settle(placed.groupBy("label", "width", "tree").applyInPandas(build, made), f"{folder}/trees")
    radius = float(np.sqrt(2.0 - 2.0 * threshold))
    roots = trees.select("label", "width", "tree", "reach", "centre")
    others = roots.select("label", "width", F.col("tree").alias("tree2"), F.col("reach").alias("reach2"), F.col("centre").alias("centre2"))
    apart = F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * dot(F.col("centre"), F.col("centre2"))))
    meet = roots.join(others, ["label", "width"]).where("tree <= tree2").where(apart <= F.col("reach") + F.col("reach2") + radius + SLACK).select("label", "width", "tree", "tree2")
    mine = trees.select("label", "width", "tree", "entries", "copies", "block")
    theirs = trees.select("label", "width", F.col("tree").alias("tree2"), F.col("entries").alias("entries2"), F.col("copies").alias("copies2"), F.col("block").alias("block2"))
    pairs = meet.join(mine, ["label", "width", "tree"]).join(theirs, ["label", "width", "tree2"]).select("width", F.expr("tree = tree2").alias("own"), "entries", "copies", "block", "entries2", "copies2", "block2")

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, ids2 = np.frombuffer(row["entries"], "<i8"), np.frombuffer(row["entries2"], "<i8")
                n, n2 = np.frombuffer(row["copies"], "<i8"), np.frombuffer(row["copies2"], "<i8")
                raw, tree = _tree(row["block"], row["width"])
                raw2, tree2 = (raw, tree) if row["own"] else _tree(row["block2"], row["width"])
                i, j = near_pairs(tree, tree2, radius)
                if row["own"]:
                    i, j = i[i < j], j[i < j]
                dots = np.einsum("nd,nd->n", raw[i], raw2[j])
                linked = dots / (np.linalg.norm(raw, axis=1)[i] * np.linalg.norm(raw2, axis=1)[j]) >= threshold
                i, j = i[linked], j[linked]
                ours = np.bincount(i, weights=n2[j], minlength=len(ids)).astype(np.int64)
                its = np.bincount(j, weights=n[i], minlength=len(ids2)).astype(np.int64)
                links = spanning(ids[i], ids2[j])
                out = [(int(e), None, int(k)) for e, k in zip(ids, ours) if k] + [(int(e), None, int(k)) for e, k in zip(ids2, its) if k] + [(a, b, 0) for a, b in links]
                cols = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    found = settle(pairs.repartition(F.xxhash64("entries", "entries2")).mapInArrow(compare, "a long, b long, n long"), f"{folder}/found")
    counts = found.where("b is null").groupBy(F.col("a").alias("entry")).agg(F.sum("n").alias("near"))
    reached = components(found.where("b is not null").select("a", "b"), "embeddings").withColumnRenamed("id", "entry")
    known = entries.select("key", "entry", "first", "copies").join(counts, "entry", "left").join(reached, "entry", "left")
    known = known.select("key", "first", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "entry").alias("root"))
    names = known.groupBy("root").agg(F.min("first").alias("component_id"))
    known = known.join(names, "root").select("key", "n_links", "component_id")
    linked = rows.where("usable").select("vec_id", "label", "key").join(known, "key").select("vec_id", "label", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone)
