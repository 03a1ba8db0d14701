"""From logical nodes to DataFrames.

Generators, gains and mixes of them are one projection over a range of frames, without a shuffle. A filter makes such a
signal a table of its own; generators beside it become columns of that table. Tables mix through one shuffle on the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions import columns
from ..operators import low_pass, mix
from . import nodes


@dataclass
class Lowered:
    """A signal as a column over ``rows``; ``rows`` None: over any table that has every frame."""

    sample: Column
    rows: DataFrame | None
    dense: bool
    checked: bool  # whether the samples are known to be valid

    def valid(self, who: str) -> Column:
        return self.sample if self.checked else columns.validated(self.sample, F.col("frame"), who)

    def over(self, frames: DataFrame) -> DataFrame:
        return self.rows if self.rows is not None else frames

    def table(self, frames: DataFrame, who: str) -> DataFrame:
        return self.over(frames).select("frame", self.valid(who).alias("sample"))


def lower(node: nodes.Node, spark: SparkSession, frames: int) -> DataFrame:
    """The signal's (frame, sample) with its schema; signals without end up to ``frames``."""
    range_ = spark.range(0, frames).select(F.col("id").alias("frame"))
    low = _lower(node, spark, frames, range_)
    return columns.conform(low.over(range_).select("frame", low.sample.alias("sample")), node.config)


def _lower(node: nodes.Node, spark: SparkSession, frames: int, range_: DataFrame) -> Lowered:
    frame, config = F.col("frame"), node.config
    match node:
        case nodes.Sine():
            return Lowered(columns.sine(frame, node.frequency_hz, config), None, True, True)
        case nodes.Square():
            return Lowered(columns.square(frame, node.frequency_hz, node.pulse_width, config), None, True, True)
        case nodes.Sawtooth():
            return Lowered(columns.sawtooth(frame, node.frequency_hz, config), None, True, True)
        case nodes.Source():
            return Lowered(F.col("sample"), node.df, False, False)
        case nodes.Gain():
            inner = _lower(node.input, spark, frames, range_)
            return Lowered(columns.gain(inner.valid("gain"), node.factor), inner.rows, inner.dense, True)
        case nodes.Mix():
            return _mix(node, [_lower(x, spark, frames, range_) for x in node.parts], spark, range_)
        case nodes.LowPass():
            return _low_pass(node, spark, frames, range_)
        case nodes.Limit():
            return _limit(node, spark, range_)
    raise PlanError(f"no lowering for {type(node).__name__}")


def _mix(node: nodes.Mix, parts: list[Lowered], spark: SparkSession, range_: DataFrame) -> Lowered:
    if not parts:
        empty = spark.range(0).select(F.col("id").alias("frame"), F.lit(0.0).cast("float").alias("sample"))
        return Lowered(F.col("sample"), empty, False, True)
    tables = [p.rows for p in parts if p.rows is not None]
    if all(p.dense for p in parts) and len(tables) <= 1:
        total = columns.weighted_sum([p.valid("mix") for p in parts], list(node.weights))
        return Lowered(total, tables[0] if tables else None, True, True)
    rows = mix.mixed([p.table(range_, f"mix input {k}") for k, p in enumerate(parts)], list(node.weights))
    return Lowered(F.col("sample"), rows, all(p.dense for p in parts), True)


def _low_pass(node: nodes.LowPass, spark: SparkSession, frames: int, range_: DataFrame) -> Lowered:
    audio, config, cut = _lower(node.input, spark, frames, range_), node.config, node.cutoff
    frame = F.col("frame")
    if cut.modulator is None:
        rows = low_pass.constant(audio.over(range_), audio.valid("low pass"), cut.hz, config)
        return Lowered(F.col("sample"), rows, audio.dense, audio.checked)
    if not audio.dense:  # the modulator must reach to the audio's last frame, and is read no further
        last = audio.over(range_).agg(F.max("frame")).first()[0]
        frames = 0 if last is None else last + 1
        range_ = spark.range(0, frames).select(F.col("id").alias("frame"))
    modulator = _lower(cut.modulator, spark, frames, range_)
    checked = modulator.valid("low pass modulation")
    if audio.dense and modulator.dense and (audio.rows is None or modulator.rows is None):
        base = audio.rows if audio.rows is not None else modulator.over(range_)
        hz = low_pass.cutoff(checked, frame, cut.base_hz, cut.depth_hz, config)
        rows = low_pass.modulated(base, audio.valid("low pass"), hz, config)
    else:
        heard = audio.over(range_).select(low_pass.ascending().alias("frame"), audio.valid("low pass").alias("_audio"))
        moved = modulator.over(range_).select("frame", checked.alias("_mod")).where(frame < frames)
        moved = moved.groupBy("frame").agg(F.max("_mod").alias("_mod"), F.count("*").alias("_times"))
        base = range_.join(moved, "frame", "left").join(heard, "frame", "left")
        want = F.concat(F.lit("low pass: modulation expected frame "), frame.cast("string"))
        mod = F.when(F.col("_times") == 1, F.col("_mod")).when(F.col("_times") > 1, F.raise_error(F.concat(want, F.lit(" once, got it again")))).otherwise(F.raise_error(F.concat(want, F.lit(", got none"))))
        rows = low_pass.modulated(base, F.col("_audio"), low_pass.cutoff(mod, frame, cut.base_hz, cut.depth_hz, config), config)
    return Lowered(F.col("sample"), rows, audio.dense, audio.checked)


def _limit(node: nodes.Limit, spark: SparkSession, range_: DataFrame) -> Lowered:
    short = spark.range(0, node.rows).select(F.col("id").alias("frame"))
    inner = _lower(node.input, spark, node.rows, short)
    if inner.rows is None or inner.dense and node.input.generated:  # made of frames below the limit already
        return Lowered(inner.sample, inner.over(short), False, inner.checked)
    rows = inner.over(short).select("frame", inner.sample.alias("sample")).orderBy("frame").limit(node.rows)
    return Lowered(F.col("sample"), rows, False, inner.checked)
