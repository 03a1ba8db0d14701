"""The one-pole low-pass filter without a sequential loop.

With L(n) the decay summed up to frame n (in nepers), the filter's output is the sum over k <= n of a(k) x(k) exp(L(k) - L(n)).
Frames are cut where L passes a multiple of SPAN. Within a part, a running window sum of a x exp(L - start) gives the
output up to a factor; the part before is added through its total; what lies further back weighs less than exp(-SPAN).
Parts of low cutoffs span many frames; they are cut into pieces of PIECE frames, whose totals are summed first. So no
window holds more than PIECE rows, or the pieces of one part. A frame that comes twice falls in one piece, where it fails.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RenderConfig

SPAN = 300.0
PIECE = 1 << 16


def ascending(before: Column | None = None) -> Column:
    """The frame; a task that meets a negative one, or one that isn't above the one before it, fails."""
    frame, before = F.col("frame"), F.lit(-1) if before is None else F.coalesce(before, F.lit(-1))
    said = F.concat(F.lit("low pass: out-of-order frame "), frame.cast("string"), F.lit(" after "), before.cast("string"))
    return F.when(before >= frame, F.raise_error(said)).otherwise(frame)


def decayed_sum(rows: DataFrame, term: Column, decay: Column, out: str = "y") -> DataFrame:
    """``rows`` (with a column frame) and ``out``, the sum over frames up to each of term * exp(decay there - decay here).

    ``decay`` must not fall with the frame.
    """
    part = F.floor(decay / F.lit(SPAN))
    cut = rows.withColumns({"_decay": decay, "_part": part, "_piece": F.floor(F.col("frame") / F.lit(PIECE))}).withColumn("_term", term * F.exp(F.col("_decay") - F.lit(SPAN) * F.col("_part")))
    by = Window.partitionBy("_part", "_piece").orderBy("frame")
    summed = cut.withColumns({"_sum": F.sum("_term").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_frame": ascending(F.lag("frame").over(by))}).withColumn("frame", F.col("_frame")).drop("_frame")
    totals = summed.groupBy("_part", "_piece").agg(F.max_by("_sum", "frame").alias("_total"))
    ahead = Window.partitionBy("_part").orderBy("_piece")
    carried = totals.select("_part", "_piece", F.coalesce(F.sum("_total").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    whole = totals.groupBy("_part").agg(F.sum("_total").alias("_last")).select((F.col("_part") + 1).alias("_part"), "_last")
    carried = carried.join(whole, "_part", "left")
    here, there = F.lit(SPAN) * F.col("_part") - F.col("_decay"), F.lit(SPAN) * (F.col("_part") - 1) - F.col("_decay")
    y = F.exp(here) * (F.col("_sum") + F.col("_before")) + F.exp(there) * F.coalesce("_last", F.lit(0.0))
    return summed.join(carried, ["_part", "_piece"]).withColumn(out, y).drop("_decay", "_part", "_piece", "_term", "_sum", "_before", "_last", "_total")


def prefix_sum(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """``rows`` (frame, ...) and ``out``, the sum of ``value`` over frames up to each: in pieces of PIECE frames, then over their totals.

    The window over totals has one row for PIECE frames.
    """
    cut = rows.withColumns({"_piece": F.floor(F.col("frame") / F.lit(PIECE)), "_value": value})
    by = Window.partitionBy("_piece").orderBy("frame")
    summed = cut.withColumns({"_sum": F.sum("_value").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_frame": ascending(F.lag("frame").over(by))}).withColumn("frame", F.col("_frame")).drop("_frame")
    totals = summed.groupBy("_piece").agg(F.max_by("_sum", "frame").alias("_total"))
    before = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_piece", F.coalesce(F.sum("_total").over(before), F.lit(0.0)).alias("_before"))
    return summed.join(offsets, "_piece").withColumn(out, F.col("_sum") + F.col("_before")).drop("_piece", "_value", "_sum", "_before")


def constant(audio: DataFrame, sample: Column, cutoff_hz: float, config: RenderConfig) -> DataFrame:
    """(frame, sample) of the filtered audio; frames without a row are silence and stay without one."""
    rate = 2 * math.pi * cutoff_hz / config.sample_rate_hz
    rows = audio.select("frame", sample.cast("double").alias("_x"))
    out = decayed_sum(rows, F.col("_x") * F.lit(-math.expm1(-rate)), F.col("frame") * F.lit(rate))
    return out.select("frame", F.col("y").cast("float").alias("sample"))


def cutoff(sample: Column, frame: Column, base_hz: float, depth_hz: float, config: RenderConfig) -> Column:
    """The cutoff a modulator's sample stands for; a task fails where it isn't above 0 and below Nyquist."""
    hz = F.lit(float(base_hz)) + F.lit(float(depth_hz)) * sample.cast("double")
    bad = F.concat(F.lit("low pass: mapped invalid cutoff "), hz.cast("string"), F.lit(" Hz at frame "), frame.cast("string"), F.lit(" from modulation sample "), sample.cast("string"))
    return F.when((hz > 0) & (hz < F.lit(config.nyquist_hz)), hz).otherwise(F.raise_error(bad))


def modulated(rows: DataFrame, audio: Column, hz: Column, config: RenderConfig) -> DataFrame:
    """(frame, sample) from dense rows; ``audio`` is null where there is no row, which is silence and gives none."""
    step = rows.select("frame", audio.cast("double").alias("_x"), (F.lit(2 * math.pi) * hz / F.lit(float(config.sample_rate_hz))).alias("_step"))
    summed = prefix_sum(step, F.col("_step"), "_level")
    heard = summed.where("_x is not null")
    out = decayed_sum(heard, F.col("_x") * -F.expm1(-F.col("_step")), F.col("_level"))
    return out.select("frame", F.col("y").cast("float").alias("sample"))
