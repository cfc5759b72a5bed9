"""Windowed counts over a column ts, alike for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("ts", late) if df.isStreaming else df


def _time(df: DataFrame) -> DataFrame:
    """Event time needs a time zone in a stream."""
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if df.isStreaming else df


def tumbling(df: DataFrame, size: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    counts = _late(_time(df), late).groupBy(F.window("ts", size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def sliding(df: DataFrame, size: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    counts = _late(_time(df), late).groupBy(F.window("ts", size, step), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(df: DataFrame, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    counts = _late(_time(df), late).groupBy(*keys, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.col("session_window.start").alias("session_start"), "n")
