"""Reading a finite signal: that it has every frame once, in order, with valid samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import RenderConfig
from ..errors import InvalidRender
from ..functions import columns


class FrameDecoder:
    """Takes batches in the order of their frames and gives their samples; the first bad row fails, in the order of the checks below."""

    def __init__(self, config: RenderConfig):
        self.config, self.next_frame, self.batch = config, 0, 0

    def decode_batch(self, batch: pa.RecordBatch) -> np.ndarray:
        if batch.num_columns != 2 or batch.schema.names != ["frame", "sample"] or batch.schema.types != [pa.int64(), pa.float32()]:
            raise InvalidRender(f"schema mismatch in batch {self.batch}: expected (frame int64, sample float), got {batch.schema}")
        n = batch.num_rows
        frames, samples = (c.fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns)
        expected = np.arange(self.next_frame, self.next_frame + n)
        no_frame, no_sample = (c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns)
        with np.errstate(invalid="ignore"):
            faults = [
                (expected >= self.config.frame_count, lambda r: f"unexpected extra frame in batch {self.batch} row {r}; expected coverage 0..{self.config.frame_count}"),
                (no_frame, lambda r: f"null frame index in batch {self.batch} row {r}"),
                (no_sample, lambda r: f"null sample at frame {expected[r]} in batch {self.batch} row {r}"),
                (frames != expected, lambda r: f"discontinuous frame sequence in batch {self.batch} row {r}: expected frame {expected[r]}, got {frames[r]}"),
                (~np.isfinite(samples), lambda r: f"non-finite sample at frame {frames[r]} in batch {self.batch} row {r}"),
                (~(np.abs(samples) <= 1), lambda r: f"out-of-range sample at frame {frames[r]} in batch {self.batch} row {r}: {samples[r]}"),
            ]
        wrong = np.logical_or.reduce([bad for bad, _ in faults]) if n else np.empty(0, bool)
        if wrong.any():
            row = int(np.argmax(wrong))
            raise InvalidRender(next(say(row) for bad, say in faults if bad[row]))
        self.next_frame += n
        self.batch += 1
        return samples

    def finish(self) -> None:
        if self.next_frame < self.config.frame_count:
            raise InvalidRender(f"render ended early: first missing frame is {self.next_frame} of {self.config.frame_count}")


def ordered_batches(df: DataFrame, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The rows by frame, a range of frames at a time on the driver, in Arrow batches of at most ``rows``."""
    packed = df.select("frame", "sample").orderBy("frame").mapInArrow(_packed(rows), "rows binary")
    for row in packed.toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row[0])


def _packed(rows: int):
    schema = pa.schema([("frame", pa.int64()), ("sample", pa.float32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema) as out:
                    out.write_batch(batch.slice(a, rows).cast(schema))
                yield pa.RecordBatch.from_pydict({"rows": [sink.getvalue().to_pybytes()]})

    return run


def decode(df: DataFrame, config: RenderConfig) -> np.ndarray:
    """All samples of a signal, of which the configuration bounds the number."""
    columns.check_schema(df, config, "decode")
    table = df.select("frame", "sample").orderBy("frame").limit(config.frame_count + 1).toArrow()
    table = table.cast(pa.schema([("frame", pa.int64()), ("sample", pa.float32())]))
    decoder = FrameDecoder(config)
    parts = [decoder.decode_batch(b) for b in table.to_batches()]
    if not parts:
        raise InvalidRender("no batches; first missing frame is 0")
    decoder.finish()
    return np.concatenate(parts)


def report(df: DataFrame, frame_count: int) -> DataFrame:
    """One row about a signal of any size: how many rows, distinct frames, nulls and bad samples it has, and the first bad frame (-1: none)."""
    sample = F.col("sample").cast("double")
    odd = F.isnan(sample) | (F.abs(sample) == float("inf"))
    per_frame = df.groupBy("frame").agg(
        F.count("*").alias("times"),
        F.sum(F.when(F.col("sample").isNull(), 1).otherwise(0)).alias("nulls"),
        F.sum(F.when(odd, 1).otherwise(0)).alias("odd"),
        F.sum(F.when(~odd & ~sample.between(-1, 1), 1).otherwise(0)).alias("out"),
    )
    inside = F.col("frame").between(0, frame_count - 1)
    bad = F.col("frame").isNull() | ~inside | (F.col("times") > 1) | (F.col("nulls") + F.col("odd") + F.col("out") > 0)
    return per_frame.agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n_rows"),
        F.count(F.when(inside, 1)).alias("n_frames"),
        (F.lit(frame_count) - F.count(F.when(inside, 1))).alias("n_missing"),
        F.coalesce(F.sum(F.when(inside, F.col("times") - 1)), F.lit(0)).alias("n_repeated"),
        F.coalesce(F.sum(F.when(~inside | F.col("frame").isNull(), F.col("times"))), F.lit(0)).alias("n_extra"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("n_null_samples"),
        F.coalesce(F.sum("odd"), F.lit(0)).alias("n_non_finite"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("n_out_of_range"),
        F.coalesce(F.min(F.when(bad, F.col("frame"))), F.lit(-1).cast("long")).alias("first_bad_frame"),
    )


#: How many values of an order column are checked in one window.
PIECE = 1 << 16


def check_delivery(df: DataFrame, order: str) -> DataFrame:
    """``df`` for rows that come in the order of a column (a number or a time): fails where a frame isn't above the one before it.

    Each piece of the order is checked by itself; its first frame is held against the last one of the piece before.
    """
    piece = F.floor(F.col(order).cast("double") / F.lit(PIECE))
    cut = df.withColumn("_piece", piece)
    inner = cut.withColumn("_before", F.lag("frame").over(Window.partitionBy("_piece").orderBy(order)))
    ends = cut.groupBy("_piece").agg(F.max_by("frame", F.struct(order, "frame")).alias("_end"))
    carried = ends.select(F.col("_piece").alias("_of"), F.lag("_end").over(Window.partitionBy(F.lit(0)).orderBy("_piece")).alias("_carried"))
    rows = inner.join(carried, F.col("_piece").eqNullSafe(F.col("_of")))
    before = F.coalesce("_before", "_carried")
    said = F.concat(F.lit("out-of-order frame "), F.col("frame").cast("string"), F.lit(" after "), before.cast("string"))
    checked = F.when(before >= F.col("frame"), F.raise_error(said)).otherwise(F.col("frame"))
    return rows.withColumn("frame", checked).select(*df.columns)
