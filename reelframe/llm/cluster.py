"""What several operators share: the cluster's shared folder, files in it, and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds the rounds of the component search; the contraction needs O(log^2 n) of them.
MAX_ROUNDS = 60


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only where the session names no folder and runs on a single machine, as in tests, is one made on the local disk;
    on a cluster that is an error, as no executor could read what another wrote on its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reelframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends at files that survive lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def put_file(folder: str, name: str, content: bytes) -> None:
    """Write one file from a task. A repeated attempt replaces the file as a whole."""
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    place.create_dir(root, recursive=True)
    hidden = f"{root}/.{name}.{os.getpid()}.{uuid.uuid4().hex}"
    with place.open_output_stream(hidden) as out:
        out.write(content)
    place.move(hidden, f"{root}/{name}")


def release_memory() -> None:
    """Hand what this worker has freed back to the system: workers share their executor's memory, and large arrays that
    come and go leave holes in the heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there with glibc alone
    if trim is not None:
        trim(0)


def lean(task: Callable) -> Callable:
    """``task`` of ``mapInArrow``, after which its worker hands back what the task has freed: Spark keeps more workers
    than run at a time, for the next stages, and what idle ones hold counts as their executor's memory."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` (long ids): rows ``(id, root)``, root = smallest id reachable.

    Alternates large-star and small-star contraction. Every step is a grouped minimum (combined before the
    shuffle) and an equi-join, so a vertex with very many neighbours is split by Spark's skew handling and no
    task or driver ever holds a component. Self-links and repeated links are allowed; vertices without a link
    are not returned; no links give no rows.
    """
    spark = edges.sparkSession
    folder = shared_dir(spark, f"{name}-components")
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{folder}/0")

    def star(links: DataFrame, larger_only: bool) -> DataFrame:
        lowest = links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("m"))
        joined = links.join(lowest, "a")
        if larger_only:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))

    last = None
    for turn in range(1, MAX_ROUNDS):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, True).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = settle(star(down, False).where("a <> b").distinct(), f"{folder}/{turn}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("component search did not settle")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
