"""Columns and schemas of frame signals: (frame long, sample float), samples finite and in [-1, 1]."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RenderConfig
from ..errors import PlanError


def frame_schema(config: RenderConfig) -> T.StructType:
    """The schema of every signal of a configuration; the sample rate makes it another timeline."""
    about = {"audio.sample_rate_hz": str(config.sample_rate_hz), "audio.channels": "1", "audio.layout": "frame"}
    return T.StructType([T.StructField("frame", T.LongType(), False, about), T.StructField("sample", T.FloatType(), False, about)])


def conform(df: DataFrame, config: RenderConfig) -> DataFrame:
    """``df`` with the schema of the configuration, metadata included, which expressions lose; a null fails where it is read."""
    frame, sample = frame_schema(config).fields
    given = lambda c, what, none: F.coalesce(c, F.raise_error(F.lit(what)).cast(none.dataType), F.lit(0).cast(none.dataType))
    return df.select(
        given("frame", "null frame index", frame).alias("frame", metadata=frame.metadata),
        given("sample", "null sample", sample).alias("sample", metadata=sample.metadata),
    )


def check_schema(df: DataFrame, config: RenderConfig, where: str) -> None:
    want, got = frame_schema(config), df.schema
    same = len(want) == len(got) and all((a.name, a.dataType, a.nullable, a.metadata) == (b.name, b.dataType, b.nullable, b.metadata) for a, b in zip(want, got))
    if not same:
        raise PlanError(f"{where}: expected input schema {want.json()}, got {got.json()}")


def f32(value: float, label: str) -> float:
    """The value as a 32-bit float holds it."""
    with np.errstate(over="ignore"):
        out = float(np.float32(value))
    if not math.isfinite(out):
        raise PlanError(f"{label} must be finite")
    return out


def check_frequency(value: float, config: RenderConfig, name: str) -> None:
    if not math.isfinite(value):
        raise PlanError(f"{name} must be finite")
    if value < 0:
        raise PlanError(f"{name} must be greater than or equal to 0")
    if value >= config.nyquist_hz:
        raise PlanError(f"{name} must be below Nyquist ({config.nyquist_hz:g} Hz for sample_rate_hz {config.sample_rate_hz})")


def validated(sample: Column, frame: Column, who: str) -> Column:
    """The sample as it is; a task that meets a bad one fails with its frame. Checked before any clamping, as NaN is largest."""
    at = lambda what: F.concat(F.lit(f"{who} {what} at frame "), frame.cast("string"), F.lit(": "), F.coalesce(sample.cast("string"), F.lit("null")))
    number = sample.cast("double")
    return (
        F.when(sample.between(-1, 1), sample)
        .when(sample.isNull() | frame.isNull(), F.raise_error(F.lit(f"{who} null frame or sample")))
        .when(F.isnan(number) | (F.abs(number) == float("inf")), F.raise_error(at("non-finite sample")))
        .otherwise(F.raise_error(at("out-of-range sample")))
    )


def saturated(value: Column) -> Column:
    """A double clamped to [-1, 1], as a 32-bit float."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)).cast("float")


def phase(frame: Column, frequency_hz: float, config: RenderConfig) -> Column:
    """The part of a cycle passed at each frame, from 0."""
    return (frame.cast("double") * F.lit(float(frequency_hz)) / F.lit(float(config.sample_rate_hz))) % F.lit(1.0)


def sine(frame: Column, frequency_hz: float, config: RenderConfig) -> Column:
    return F.sin(F.lit(2 * math.pi) * frame.cast("double") * F.lit(float(frequency_hz)) / F.lit(float(config.sample_rate_hz))).cast("float")


def square(frame: Column, frequency_hz: float, pulse_width: float, config: RenderConfig) -> Column:
    return F.when(phase(frame, frequency_hz, config) < F.lit(float(pulse_width)), 1.0).otherwise(-1.0).cast("float")


def sawtooth(frame: Column, frequency_hz: float, config: RenderConfig) -> Column:
    return (F.lit(2.0) * phase(frame, frequency_hz, config) - F.lit(1.0)).cast("float")


def gain(sample: Column, factor: float) -> Column:
    return saturated(sample.cast("double") * F.lit(factor))


def weighted_sum(samples: list[Column], weights: list[float]) -> Column:
    """Input by input from the left, silence where an input has no row."""
    total = F.lit(0.0)
    for sample, weight in zip(samples, weights):
        total = total + F.coalesce(sample.cast("double"), F.lit(0.0)) * F.lit(weight)
    return saturated(total)
