"""What a waveform picture needs of a signal: least, largest and mean sample of each bucket of frames, and the scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 1168


def buckets(df: DataFrame, frame_count: int, most: int = MOST_BUCKETS) -> DataFrame:
    """(bucket, minimum, maximum, mean): bucket i has the frames from i * n // b to (i + 1) * n // b; one pre-aggregated shuffle."""
    b = min(frame_count, most)
    bucket = F.expr(f"((frame + 1) * {b}L - 1) div {frame_count}L")
    return df.groupBy(bucket.alias("bucket")).agg(F.min("sample").alias("minimum"), F.max("sample").alias("maximum"), F.avg(F.col("sample").cast("double")).cast("float").alias("mean"))


def peak_scale(df: DataFrame) -> DataFrame:
    """One row: the largest magnitude, 1 at least."""
    return df.agg(F.greatest(F.lit(1.0).cast("float"), F.max(F.abs("sample"))).alias("amplitude_scale"))
