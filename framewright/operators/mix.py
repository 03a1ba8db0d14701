"""N signals aligned on their frames and added."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns


def mixed(inputs: list[DataFrame], weights: list[float]) -> DataFrame:
    """(frame, sample) for each frame that some input has: one shuffle for any number of inputs.

    A frame that comes twice in one input fails.
    """
    tagged = [df.select("frame", F.lit(k).alias("_k"), F.col("sample").alias("_s")) for k, df in enumerate(inputs)]
    of = lambda k: F.max(F.when(F.col("_k") == k, F.col("_s")))
    times = lambda k: F.sum(F.when(F.col("_k") == k, 1).otherwise(0))
    together = reduce(DataFrame.union, tagged).groupBy("frame").agg(*(of(k).alias(f"_{k}") for k in range(len(inputs))), F.greatest(*(times(k) for k in range(len(inputs))), F.lit(0)).alias("_times"))
    total = columns.weighted_sum([F.col(f"_{k}") for k in range(len(inputs))], weights)
    twice = F.raise_error(F.concat(F.lit("mix: duplicate frame "), F.col("frame").cast("string")))
    return together.select("frame", F.when(F.col("_times") <= 1, total).otherwise(twice).alias("sample"))
