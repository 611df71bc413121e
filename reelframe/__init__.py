"""Time-based media as DataFrames: exact time bases, timelines, containers, bitstreams and subtitles on Spark."""
