"""The Python interface: signals as values, built from sources and operators, lowered when a DataFrame is asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .config import RenderConfig
from .functions import columns
from .operators import decode, waveform
from .plans import dsl, nodes
from .plans.lower import lower
from .plans.rewrite import fuse_gains


@dataclass(frozen=True)
class FrameSignal:
    spark: SparkSession
    node: nodes.Node

    @property
    def config(self) -> RenderConfig:
        return self.node.config

    # Sources

    @classmethod
    def sine(cls, spark: SparkSession, config: RenderConfig, frequency_hz: float) -> FrameSignal:
        return cls(spark, nodes.Sine(config, float(frequency_hz)))

    @classmethod
    def square(cls, spark: SparkSession, config: RenderConfig, frequency_hz: float, pulse_width: float) -> FrameSignal:
        return cls(spark, nodes.Square(config, float(frequency_hz), float(pulse_width)))

    @classmethod
    def sawtooth(cls, spark: SparkSession, config: RenderConfig, frequency_hz: float) -> FrameSignal:
        return cls(spark, nodes.Sawtooth(config, float(frequency_hz)))

    @classmethod
    def from_dataframe(cls, df: DataFrame, config: RenderConfig) -> FrameSignal:
        """A table that has the schema of ``frame_schema(config)``, metadata included."""
        return cls(df.sparkSession, nodes.Source(config, df))

    @classmethod
    def from_graph(cls, spark: SparkSession, text: str, config: RenderConfig) -> FrameSignal:
        return cls(spark, dsl.build(text, config))

    # Operators

    def gain(self, factor: float) -> FrameSignal:
        return FrameSignal(self.spark, nodes.Gain(self.config, self.node, factor))

    def mix(self, *others: FrameSignal, weights: Sequence[float] | None = None) -> FrameSignal:
        parts = (self.node, *(o.node for o in others))
        return FrameSignal(self.spark, nodes.Mix(self.config, parts, tuple(weights) if weights is not None else (1.0,) * len(parts)))

    def low_pass(self, cutoff: float | FrameSignal, base_hz: float | None = None, depth_hz: float | None = None) -> FrameSignal:
        cut = nodes.Cutoff.modulated(cutoff.node, base_hz, depth_hz) if isinstance(cutoff, FrameSignal) else nodes.Cutoff(float(cutoff))
        return FrameSignal(self.spark, nodes.LowPass(self.config, self.node, cut))

    def limit(self, rows: int | None = None) -> FrameSignal:
        return FrameSignal(self.spark, nodes.Limit(self.config, self.node, self.config.frame_count if rows is None else rows))

    def transform(self, change: Callable[[DataFrame], DataFrame]) -> FrameSignal:
        """Any change of the rows that keeps the schema."""
        return FrameSignal.from_dataframe(columns.conform(change(self.to_df()), self.config), self.config)

    def optimized(self) -> FrameSignal:
        return FrameSignal(self.spark, fuse_gains(self.node))

    # Results

    def to_df(self) -> DataFrame:
        """The rows; a signal without end has the configuration's frames."""
        return lower(self.node, self.spark, self.config.frame_count)

    def as_view(self, name: str) -> DataFrame:
        """The rows as a temporary view for SQL."""
        df = self.to_df()
        df.createOrReplaceTempView(name)
        return df

    def decode(self) -> np.ndarray:
        return decode.decode(self.to_df(), self.config)

    def report(self) -> DataFrame:
        return decode.report(self.to_df(), self.config.frame_count)

    def waveform(self) -> DataFrame:
        return waveform.buckets(self.to_df(), self.config.frame_count)

    def explain(self, mode: str | None = None) -> str:
        """Prints the graph and, with a mode, Spark's plan; returns the graph."""
        text = self.node.explain()
        print(text)
        if mode:
            self.to_df().explain(mode)
        return text
