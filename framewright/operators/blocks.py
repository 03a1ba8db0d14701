"""The block layout: (start_frame, samples) rows of consecutive samples; the last block may be shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_frames(blocks: DataFrame) -> DataFrame:
    """One row for each sample, without a shuffle."""
    return blocks.select("start_frame", F.posexplode("samples").alias("at", "sample")).select((F.col("start_frame") + F.col("at")).alias("frame"), F.col("sample").cast("float").alias("sample"))


def to_blocks(frames: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` consecutive frames from frame 0; one shuffle."""
    start = F.expr(f"frame div {size}L * {size}L").alias("start_frame")
    rows = F.sort_array(F.collect_list(F.struct("frame", "sample")))
    return frames.groupBy(start).agg(F.transform(rows, lambda r: r["sample"]).alias("samples"))
