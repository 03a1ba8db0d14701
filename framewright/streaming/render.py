"""Signals without end as Structured Streaming queries.

Frames come from Spark's rate-per-micro-batch source, ``batch_frame_capacity`` frames a batch from 0, so each query starts
anew. Graphs of generators, gains and mixes are columns over that one stream. Where a graph has filters, wherever they
stand, the parts below them are such columns, and one keyed operator does the filters, and the gains and mixes above them,
a batch at a time; it keeps the last frame and each filter's last output between batches.
"""

from __future__ import annotations

import math
import queue
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import RenderConfig
from ..errors import PlanError
from ..functions import columns
from ..operators import low_pass
from ..operators.decode import FrameDecoder
from ..plans import nodes
from ..signal import FrameSignal
from ..sinks.wav import StreamingWavStats, write_streaming_wav

_ROWS = "frame long, sample float"
_STATE = "last long, y array<double>"


def frames(spark: SparkSession, config: RenderConfig) -> DataFrame:
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", config.batch_frame_capacity).option("numPartitions", 1).load()
    return stream.select(F.col("value").alias("frame"))


def stateless(node: nodes.Node) -> Column:
    """The sample as a column over frames, for graphs without filters and tables."""
    frame, config = F.col("frame"), node.config
    match node:
        case nodes.Sine():
            return columns.sine(frame, node.frequency_hz, config)
        case nodes.Square():
            return columns.square(frame, node.frequency_hz, node.pulse_width, config)
        case nodes.Sawtooth():
            return columns.sawtooth(frame, node.frequency_hz, config)
        case nodes.Gain():
            return columns.gain(stateless(node.input), node.factor)
        case nodes.Mix():
            return columns.weighted_sum([stateless(p) for p in node.parts], list(node.weights))
    raise PlanError(f"{type(node).__name__} has no column over a stream of frames")


#: Nepers that a run of frames decays by when it is summed at once.
_SPAN = 300.0


def filtered(x: np.ndarray, step: np.ndarray, gap: np.ndarray, y: float) -> np.ndarray:
    """The filter's outputs for samples ``x``: ``step`` is each frame's decay, ``gap`` the frames since the one before, ``y`` the output there."""
    out, gain, level = np.empty(len(x)), -np.expm1(-step), np.cumsum(step * gap)
    a, base = 0, 0.0
    while a < len(x):
        b = max(a + 1, int(np.searchsorted(level, base + _SPAN, "right")))
        if b == a + 1:
            out[a] = y * math.exp(base - level[a]) + gain[a] * x[a]
        else:
            decay = level[a:b] - base
            out[a:b] = np.exp(-decay) * (y + np.cumsum(gain[a:b] * x[a:b] * np.exp(decay)))
        a, base, y = b, level[b - 1], out[b - 1]
    return out


def check_order(frame: np.ndarray, last: int) -> None:
    """Fails at the first frame that isn't above the one delivered before it."""
    before = np.concatenate([[last], frame[:-1]])
    wrong = np.flatnonzero(frame <= before)
    if len(wrong):
        raise ValueError(f"low pass: out-of-order frame {frame[wrong[0]]} after {before[wrong[0]]}")


class _Graph:
    """A graph with filters as steps over the columns of its stateless parts."""

    def __init__(self, node: nodes.Node):
        self.config, self.columns, self.filters = node.config, [], 0
        self.top = self._step(node)

    def _column(self, column: Column) -> Callable:
        k = len(self.columns)
        self.columns.append(column.cast("double"))
        return lambda at: at.column(k)

    def _step(self, node: nodes.Node) -> Callable:
        if not _has_filter(node):
            return self._column(stateless(node))
        match node:
            case nodes.Gain():
                inner, factor = self._step(node.input), node.factor
                return lambda at: _saturated(inner(at) * factor)
            case nodes.Mix():
                parts = [(self._step(p), w) for p, w in zip(node.parts, node.weights)]
                return lambda at: _saturated(sum(part(at) * w for part, w in parts))
            case nodes.LowPass():
                audio, cut, rate = self._step(node.input), node.cutoff, 2 * math.pi / self.config.sample_rate_hz
                if cut.modulator is None:
                    hz = lambda at: np.full(at.size, float(cut.hz))
                elif _has_filter(cut.modulator):
                    moved, nyquist = self._step(cut.modulator), self.config.nyquist_hz
                    hz = lambda at: _cutoffs(moved(at), cut.base_hz, cut.depth_hz, nyquist)
                else:
                    hz = self._column(low_pass.cutoff(stateless(cut.modulator), F.col("frame"), cut.base_hz, cut.depth_hz, self.config))
                k = self.filters
                self.filters += 1
                return lambda at: at.filtered(k, audio(at), hz(at) * rate)
        raise PlanError(f"{type(node).__name__} has no stream")

    def over(self, frames: DataFrame) -> DataFrame:
        top, filters, names = self.top, self.filters, [f"c{k}" for k in range(len(self.columns))]

        def run(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            last, y = state.get if state.exists else (-1, [0.0] * filters)
            rows = pd.concat(list(batches))
            frame = rows["frame"].to_numpy()
            check_order(frame, last)
            at = _Batch([rows[c].to_numpy() for c in names], np.diff(frame, prepend=last), list(y))
            sample = top(at)
            state.update((int(frame[-1]), [float(v) for v in at.y]))
            yield pd.DataFrame({"frame": frame, "sample": sample.astype(np.float32)})

        rows = frames.select("frame", *(c.alias(n) for c, n in zip(self.columns, names)), F.lit(0).alias("signal"))
        return rows.groupBy("signal").applyInPandasWithState(run, _ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)


class _Batch:
    def __init__(self, columns_: list[np.ndarray], gap: np.ndarray, y: list[float]):
        self.columns, self.gap, self.y, self.size = columns_, gap, y, len(gap)

    def column(self, k: int) -> np.ndarray:
        return self.columns[k]

    def filtered(self, k: int, x: np.ndarray, step: np.ndarray) -> np.ndarray:
        out = filtered(x, step, self.gap, self.y[k])
        self.y[k] = out[-1]
        return out.astype(np.float32).astype(np.float64)


def _saturated(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -1, 1).astype(np.float32).astype(np.float64)


def _cutoffs(modulation: np.ndarray, base_hz: float, depth_hz: float, nyquist: float) -> np.ndarray:
    hz = base_hz + depth_hz * modulation
    if not ((hz > 0) & (hz < nyquist)).all():
        raise ValueError("low pass: mapped invalid cutoff")
    return hz


def stream(signal: FrameSignal) -> DataFrame:
    """The streaming (frame, sample) of any graph without tables. A limit counts at the end of the graph only, where
    ``run`` ends at the configuration's frames."""
    node = signal.node
    while isinstance(node, nodes.Limit):
        node = node.input
    rows = frames(signal.spark, signal.config)
    return _Graph(node).over(rows) if _has_filter(node) else rows.select("frame", stateless(node).alias("sample"))


def _has_filter(node: nodes.Node) -> bool:
    return isinstance(node, nodes.LowPass) or any(map(_has_filter, node.inputs))


def run(rows: DataFrame, config: RenderConfig, each: Callable, checkpoint: str) -> StreamingQuery:
    """Starts a query that gives ``each`` the batches (Arrow, by frame) of the first ``frame_count`` frames and is then stopped by ``finish``."""
    done = threading.Event()
    seen = {"rows": 0}

    def batch(df: DataFrame, _id: int) -> None:
        if done.is_set():
            return
        part = df.where(F.col("frame") < config.frame_count).orderBy("frame").toArrow()
        for b in part.combine_chunks().to_batches():
            each(b)
            seen["rows"] += b.num_rows
        if seen["rows"] >= config.frame_count:
            done.set()

    query = rows.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint).start()
    query.framewright_done = done
    return query


def finish(query: StreamingQuery, seconds: float) -> None:
    """Waits for the last frame, then stops the query; its failure is raised."""
    try:
        waited = 0.0
        while not query.framewright_done.wait(0.2):
            waited += 0.2
            if query.exception() is not None:
                raise query.exception()
            if waited > seconds:
                raise TimeoutError(f"no last frame after {seconds} s")
    finally:
        query.stop()


def _arrow() -> pa.Schema:
    return pa.schema([("frame", pa.int64()), ("sample", pa.float32())])


def decode(rows: DataFrame, config: RenderConfig, checkpoint: str, seconds: float = 120) -> np.ndarray:
    """All samples of the first ``frame_count`` frames, checked batch by batch."""
    decoder, parts = FrameDecoder(config), []
    finish(run(rows, config, lambda b: parts.append(decoder.decode_batch(b.cast(_arrow()))), checkpoint), seconds)
    decoder.finish()
    return np.concatenate(parts)


def write_wav(path: str, rows: DataFrame, config: RenderConfig, checkpoint: str, seconds: float = 120) -> StreamingWavStats:
    """Writes the first ``frame_count`` frames of a stream as they come, as ``write_streaming_wav`` does: the destination is
    replaced when they are complete, and left as it was if the query fails or ends early."""
    waiting: queue.Queue = queue.Queue(4)
    query = run(rows, config, lambda b: waiting.put(b.cast(_arrow()), timeout=seconds), checkpoint)

    def batches() -> Iterator[pa.RecordBatch]:
        left, until = config.frame_count, time.monotonic() + seconds
        while left > 0:
            try:
                batch = waiting.get(timeout=0.2)
            except queue.Empty:
                if query.exception() is not None:
                    raise query.exception()
                if time.monotonic() > until:
                    raise TimeoutError(f"no last frame after {seconds} s") from None
                continue
            left -= batch.num_rows
            yield batch

    try:
        return write_streaming_wav(path, batches(), config)
    finally:
        query.stop()
