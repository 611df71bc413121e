"""Seeking in an index: backward as-of joins with the index's own rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find(targets: DataFrame, index: DataFrame, keys: list[str], keyframe_only: bool = False) -> DataFrame:
    """``targets(*keys, target_id, timestamp)`` with the entry each finds: columns of ``index`` as ``entry``.

    ``index(*keys, seq, timestamp, pos, size, keyframe)``. The last entry at or before the time is found, of equal
    times that with the highest ``seq``; a time before the first entry finds the first. With ``keyframe_only``
    it is the last keyframe at or before, and a time before the first entry finds it only if it is a keyframe;
    otherwise there is none. Targets and entries are merged by one shuffle on ``keys`` and a sort.
    """
    entry = F.struct("timestamp", "seq", "pos", "size", "keyframe")
    first = index.groupBy(*keys).agg(F.min(entry).alias("__first"))
    wanted = F.when(F.col("keyframe"), entry) if keyframe_only else entry
    marks = index.select(*keys, F.lit(0).alias("__probe"), "timestamp", "seq", F.lit(None).cast("long").alias("target_id"), wanted.alias("__entry"), F.lit(True).alias("__any"))
    probes = targets.select(*keys, F.lit(1).alias("__probe"), "timestamp", F.lit(None).cast("long").alias("seq"), F.col("target_id").cast("long").alias("target_id"), F.lit(None).cast(marks.schema["__entry"].dataType).alias("__entry"), F.lit(None).cast("boolean").alias("__any"))
    w = Window.partitionBy(*keys).orderBy("timestamp", "__probe", "seq").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(probes).withColumn("__found", F.last("__entry", ignorenulls=True).over(w)).withColumn("__seen", F.last("__any", ignorenulls=True).over(w)).where("__probe = 1")
    clamp = F.col("__first")
    if keyframe_only:
        clamp = F.when(F.col("__first.keyframe"), clamp)
    found = F.coalesce("__found", F.when(F.col("__seen").isNull(), clamp))
    return merged.join(first, keys, "left").select(*keys, "target_id", "timestamp", found.alias("entry"))


#: How a target is sought: the last keyframe at or before its time, the last entry, or the last one at or before its byte.
BACKWARD, ANY, BYTE = "backward", "any", "byte"


def seek(targets: DataFrame, index: DataFrame, keys: list[str], flag: str = BACKWARD) -> DataFrame:
    """`find` or `find_by_pos` as the flag says; ``targets(*keys, target_id, at)`` with the ``entry`` of each."""
    if flag == BYTE:
        return find_by_pos(targets.withColumnRenamed("at", "pos"), index, keys).select(*keys, "target_id", "entry")
    if flag not in (BACKWARD, ANY):
        raise ValueError(f"unknown seek flag {flag!r}")
    return find(targets.withColumnRenamed("at", "timestamp"), index, keys, flag == BACKWARD).select(*keys, "target_id", "entry")


def find_by_pos(targets: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """``targets(*keys, target_id, pos)`` with the last inserted entry at or before the byte position, or none."""
    entry = F.struct("seq", "timestamp", "pos", "size", "keyframe")
    none = F.lit(None).cast(index.select(entry.alias("e")).schema["e"].dataType)
    marks = index.select(*keys, F.lit(0).alias("__probe"), "pos", F.lit(None).cast("long").alias("target_id"), entry.alias("__entry"))
    probes = targets.select(*keys, F.lit(1).alias("__probe"), "pos", F.col("target_id").cast("long").alias("target_id"), none.alias("__entry"))
    w = Window.partitionBy(*keys).orderBy("pos", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(probes).withColumn("entry", F.max("__entry").over(w)).where("__probe = 1").select(*keys, "target_id", "pos", "entry")
