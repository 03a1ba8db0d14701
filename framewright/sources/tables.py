"""Signals from tables, and graphs from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RenderConfig
from ..functions import columns


def signal_table(df: DataFrame, frame: Column, sample: Column, config: RenderConfig) -> DataFrame:
    """(frame, sample) with the configuration's schema from any table; samples are narrowed, not clamped."""
    return columns.conform(df.select(frame.cast("long").alias("frame"), sample.cast("float").alias("sample")), config)


def read_parquet(spark: SparkSession, path: str, config: RenderConfig, frame: str = "frame", sample: str = "sample") -> DataFrame:
    return signal_table(spark.read.parquet(path), F.col(frame), F.col(sample), config)


def read_graph(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


# Two graph texts.

#: 440 Hz and a pulse wave, through a filter that opens and closes once a second.
DEFAULT_GRAPH = """
sine(440.0) -> $tone;
square(435.0, 0.2) -> $pulse;
sine(1.0) -> $cutoff;
mix([$tone, $pulse], [0.5, 0.5]) -> lpf($cutoff) -> gain(0.5) -> out
"""

TWO_TONE_GRAPH = """
sine(440.0) -> $high;
sine(220.0) -> $low;
mix([$high, $low], [0.4, 0.6]) -> lpf(1000.0) -> gain(0.5) -> out
"""
