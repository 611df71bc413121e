"""Container sources and sinks; `register` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from reelframe.sources.mp4 import Mp4Source
    from reelframe.sources.raw_stream import RawStreamSource
    from reelframe.sources.wav import WavSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # sources here take conditions
    spark.dataSource.register(WavSource)
    spark.dataSource.register(Mp4Source)
    spark.dataSource.register(RawStreamSource)
