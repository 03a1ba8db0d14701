"""Registered queries of the signal engine over the star-schema tables, and the SQL each is held against."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import FrameSignal, RenderConfig
from .operators import blocks, decode, waveform
from .sources.tables import DEFAULT_GRAPH, TWO_TONE_GRAPH, signal_table

RATE = 48_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _config(frames: int, rate: int = RATE) -> RenderConfig:
    return RenderConfig(rate, max(1, frames), max_render_seconds=max(60, -(-frames // rate)))


def _clamped(value) -> F.Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def _events(spark: SparkSession, sf_dir: str, config: RenderConfig) -> FrameSignal:
    return FrameSignal.from_dataframe(signal_table(_table(spark, sf_dir, "events"), F.col("event_id"), _clamped(F.col("value") / F.lit(250.0) - F.lit(1.0)), config), config)


def _orders(spark: SparkSession, sf_dir: str, config: RenderConfig) -> FrameSignal:
    return FrameSignal.from_dataframe(signal_table(_table(spark, sf_dir, "orders"), F.col("o_orderkey"), _clamped(F.col("o_totalprice") / F.lit(250000.0) - F.lit(1.0)), config), config)


def _lineitem(spark: SparkSession, sf_dir: str, config: RenderConfig) -> FrameSignal:
    """A signal with gaps: the largest discount of each order."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("most"))
    return FrameSignal.from_dataframe(signal_table(rows, F.col("l_orderkey"), _clamped(F.col("most") * F.lit(10.0) - F.lit(0.5)), config), config)


def _count(spark: SparkSession, sf_dir: str, name: str) -> int:
    return _table(spark, sf_dir, name).count()


def _rounded(signal: FrameSignal | DataFrame) -> DataFrame:
    df = signal.to_df() if isinstance(signal, FrameSignal) else signal
    return df.select("frame", (F.round(F.col("sample").cast("double"), 6) + F.lit(0.0)).alias("sample"))


def _generated(make: Callable[[SparkSession, RenderConfig], FrameSignal]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(make(spark, _config(_count(spark, sf_dir, "orders"))))

    return query


def _on(table, make: Callable[[FrameSignal], FrameSignal]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(make(table(spark, sf_dir, _config(RATE))))

    return query


def mix_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(RATE)
    return _rounded(_lineitem(spark, sf_dir, config).mix(_events(spark, sf_dir, config), weights=(0.4, 0.6)))


def mix_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(RATE)
    return _rounded(_events(spark, sf_dir, config).mix(_orders(spark, sf_dir, config), _lineitem(spark, sf_dir, config), weights=(0.4, 0.6, -0.3)))


def mix_generator_and_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(_count(spark, sf_dir, "orders"))
    return _rounded(_lineitem(spark, sf_dir, config).mix(FrameSignal.sine(spark, config, 440.0), weights=(0.5, 0.5)).limit())


def lpf_modulated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(RATE)
    return _rounded(_lineitem(spark, sf_dir, config).low_pass(_orders(spark, sf_dir, config)))


def limit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(RATE)
    return _rounded(_lineitem(spark, sf_dir, config).limit(1000))


def decode_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _config(_count(spark, sf_dir, "orders"))
    return decode.report(_lineitem(spark, sf_dir, config).to_df(), config.frame_count)


def waveform_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _count(spark, sf_dir, "orders")
    found = waveform.buckets(_orders(spark, sf_dir, _config(n)).to_df(), n)
    return found.select("bucket", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in ("minimum", "maximum", "mean")))


def peak_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = _orders(spark, sf_dir, _config(RATE)).to_df().select((F.col("sample") * 3).cast("float").alias("sample"))
    return waveform.peak_scale(loud).select(F.round(F.col("amplitude_scale").cast("double"), 6).alias("amplitude_scale"))


def blocks_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 64).alias("start_frame"), F.col("embedding").alias("samples"))
    return _rounded(blocks.to_frames(rows))


def frames_to_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = blocks.to_blocks(_events(spark, sf_dir, _config(RATE)).to_df(), 64)
    digest = F.aggregate("samples", F.lit(0.0), lambda a, x: a + F.round(x.cast("double"), 4))
    return made.select("start_frame", F.size("samples").cast("long").alias("n_samples"), F.round(F.element_at("samples", 1).cast("double"), 6).alias("first_sample"), F.round(F.element_at("samples", -1).cast("double"), 6).alias("last_sample"), F.round(digest, 3).alias("total"))


def _graph(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(FrameSignal.from_graph(spark, text, _config(_count(spark, sf_dir, "orders"))))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "osc_sine": _generated(lambda s, c: FrameSignal.sine(s, c, 440.0)),
    "osc_square": _generated(lambda s, c: FrameSignal.square(s, c, 435.0, 0.2)),
    "osc_sawtooth": _generated(lambda s, c: FrameSignal.sawtooth(s, c, 220.0)),
    "signal_from_table": _on(_events, lambda x: x),
    "gain_half": _on(_events, lambda x: x.gain(0.5)),
    "gain_saturate": _on(_events, lambda x: x.gain(3.0)),
    "gain_negative": _on(_orders, lambda x: x.gain(-0.7)),
    "gain_fused": _on(_orders, lambda x: x.gain(0.5).gain(0.3).optimized()),
    "mix_two": _generated(lambda s, c: FrameSignal.sine(s, c, 440.0).mix(FrameSignal.square(s, c, 435.0, 0.2), weights=(0.5, 0.5))),
    "mix_three": mix_three,
    "mix_sparse": mix_sparse,
    "mix_generator_and_table": mix_generator_and_table,
    "lpf_constant": _on(_orders, lambda x: x.low_pass(1000.0)),
    "lpf_gapped": _on(_lineitem, lambda x: x.low_pass(1000.0)),
    "lpf_slow": _on(_lineitem, lambda x: x.low_pass(1.0)),
    "lpf_modulated": _on(_orders, lambda x: x.low_pass(FrameSignal.sine(x.spark, x.config, 1.0))),
    "lpf_modulated_table": lpf_modulated_table,
    "limit_first": limit_first,
    "decode_report": decode_report,
    "waveform_buckets": waveform_buckets,
    "peak_scale": peak_scale,
    "dsl_two_tone": _graph(TWO_TONE_GRAPH),
    "dsl_default_graph": _graph(DEFAULT_GRAPH),
    "blocks_to_frames": blocks_to_frames,
    "frames_to_blocks": frames_to_blocks,
}


def _f32(x: float) -> str:
    return f"{float(np.float32(x))!r}::DOUBLE"


_N = "(SELECT count(*) FROM orders)"
_FRAMES = f"(SELECT range AS frame FROM range(0, {_N}))"
_EVENTS = "(SELECT event_id AS frame, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value / 250.0::DOUBLE - 1.0::DOUBLE))::FLOAT AS sample FROM events)"
_ORDERS = "(SELECT o_orderkey AS frame, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, o_totalprice / 250000.0::DOUBLE - 1.0::DOUBLE))::FLOAT AS sample FROM orders)"
_LINEITEM = "(SELECT l_orderkey AS frame, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, max(l_discount) * 10.0::DOUBLE - 0.5::DOUBLE))::FLOAT AS sample FROM lineitem GROUP BY l_orderkey)"


def _sine(hz: float) -> str:
    return f"sin({2 * math.pi!r}::DOUBLE * frame::DOUBLE * {hz!r}::DOUBLE / {RATE}.0::DOUBLE)::FLOAT"


def _phase(hz: float) -> str:
    return f"((frame::DOUBLE * {hz!r}::DOUBLE / {RATE}.0::DOUBLE) % 1.0::DOUBLE)"


def _square(hz: float, width: float) -> str:
    return f"(CASE WHEN {_phase(hz)} < {width!r}::DOUBLE THEN 1.0 ELSE -1.0 END)::FLOAT"


def _sat(x: str) -> str:
    return f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {x}))::FLOAT"


def _gain_of(x: str, factor: float) -> str:
    return _sat(f"({x})::DOUBLE * {_f32(factor)}")


def _final(rows: str) -> str:
    return f"SELECT frame, round(sample::DOUBLE, 6) + 0.0 AS sample FROM ({rows})"


def _select(sample: str, source: str = _FRAMES) -> str:
    return f"SELECT frame, {sample} AS sample FROM {source}"


def _mixed(inputs: list[str], weights: list[float]) -> str:
    keys = " UNION ".join(f"SELECT frame FROM {x}" for x in inputs)
    joins = " ".join(f"LEFT JOIN {x} i{k} ON i{k}.frame = f.frame" for k, x in enumerate(inputs))
    total = " + ".join(f"coalesce(i{k}.sample::DOUBLE, 0.0::DOUBLE) * {_f32(w)}" for k, w in enumerate(weights))
    return f"SELECT f.frame, {_sat('0.0::DOUBLE + ' + total)} AS sample FROM ({keys}) f {joins}"


def _recurrence(audio: str, steps: str) -> str:
    """The filter step by step: y falls by the step's decay at each frame and takes up the audio's sample."""
    return f"""
        WITH RECURSIVE audio AS MATERIALIZED ({audio}),
        dense AS MATERIALIZED (SELECT r.range AS frame, a.sample, a.frame IS NOT NULL AS heard FROM range(0, (SELECT max(frame) + 1 FROM audio)) r LEFT JOIN audio a ON a.frame = r.range),
        steps AS MATERIALIZED (SELECT frame, coalesce(sample::DOUBLE, 0.0) AS x, heard, {steps} AS e FROM dense),
        run(frame, y, heard) AS (
            SELECT frame, (1 - exp(-e)) * x, heard FROM steps WHERE frame = 0
            UNION ALL SELECT s.frame, exp(-s.e) * r.y + (1 - exp(-s.e)) * s.x, s.heard FROM run r JOIN steps s ON s.frame = r.frame + 1)
        SELECT frame, round(y::FLOAT::DOUBLE, 6) + 0.0 AS sample FROM run WHERE heard"""


def _decay(hz: float) -> str:
    return f"({2 * math.pi * hz / RATE!r}::DOUBLE)"


_DEFAULT_MIX = _sat(f"0.0::DOUBLE + ({_sine(440.0)})::DOUBLE * 0.5::DOUBLE + ({_square(435.0, 0.2)})::DOUBLE * 0.5::DOUBLE")
_TWO_TONE_MIX = _sat(f"0.0::DOUBLE + ({_sine(440.0)})::DOUBLE * {_f32(0.4)} + ({_sine(220.0)})::DOUBLE * {_f32(0.6)}")
_SWEEP = f"({2 * math.pi!r}::DOUBLE * (1000.0::DOUBLE + 900.0::DOUBLE * ({_sine(1.0)})::DOUBLE) / {RATE}.0::DOUBLE)"

ORACLE_SQL: dict[str, str] = {
    "osc_sine": _final(_select(_sine(440.0))),
    "osc_square": _final(_select(_square(435.0, 0.2))),
    "osc_sawtooth": _final(_select(f"(2.0::DOUBLE * {_phase(220.0)} - 1.0::DOUBLE)::FLOAT")),
    "signal_from_table": _final(f"SELECT * FROM {_EVENTS}"),
    "gain_half": _final(_select(_gain_of("sample", 0.5), _EVENTS)),
    "gain_saturate": _final(_select(_gain_of("sample", 3.0), _EVENTS)),
    "gain_negative": _final(_select(_gain_of("sample", -0.7), _ORDERS)),
    "gain_fused": _final(_select(_gain_of("sample", 0.5 * float(np.float32(0.3))), _ORDERS)),
    "mix_two": _final(_select(_DEFAULT_MIX)),
    "mix_three": _final(_mixed([_EVENTS, _ORDERS, _LINEITEM], [0.4, 0.6, -0.3])),
    "mix_sparse": _final(_mixed([_LINEITEM, _EVENTS], [0.4, 0.6])),
    "mix_generator_and_table": _final(_mixed([_LINEITEM, f"({_select(_sine(440.0))})"], [0.5, 0.5]) + f" WHERE f.frame < {_N}"),
    "lpf_constant": _recurrence(f"SELECT * FROM {_ORDERS}", _decay(1000.0)),
    "lpf_gapped": _recurrence(f"SELECT * FROM {_LINEITEM}", _decay(1000.0)),
    "lpf_slow": _recurrence(f"SELECT * FROM {_LINEITEM}", _decay(1.0)),
    "lpf_modulated": _recurrence(f"SELECT * FROM {_ORDERS}", _SWEEP),
    "lpf_modulated_table": _recurrence(
        f"SELECT * FROM {_LINEITEM}",
        f"({2 * math.pi!r}::DOUBLE * (1000.0::DOUBLE + 900.0::DOUBLE * (SELECT m.sample FROM {_ORDERS} m WHERE m.frame = dense.frame)::DOUBLE) / {RATE}.0::DOUBLE)",
    ),
    "limit_first": _final(f"SELECT * FROM {_LINEITEM} ORDER BY frame LIMIT 1000"),
    "decode_report": f"""
        WITH f AS (SELECT frame, count(*) AS times FROM {_LINEITEM} GROUP BY frame)
        SELECT sum(times)::BIGINT AS n_rows, count(*) FILTER (frame < {_N})::BIGINT AS n_frames, ({_N} - count(*) FILTER (frame < {_N}))::BIGINT AS n_missing,
            coalesce(sum(times - 1) FILTER (frame < {_N}), 0)::BIGINT AS n_repeated, coalesce(sum(times) FILTER (frame >= {_N}), 0)::BIGINT AS n_extra,
            0::BIGINT AS n_null_samples, 0::BIGINT AS n_non_finite, 0::BIGINT AS n_out_of_range, coalesce(min(frame) FILTER (frame >= {_N} OR times > 1), -1)::BIGINT AS first_bad_frame FROM f""",
    "waveform_buckets": f"""
        WITH b AS (SELECT least({_N}, 1168) AS b, {_N} AS n), k AS (SELECT range AS bucket, (range * n) // b AS lo, ((range + 1) * n) // b AS hi FROM b, range(0, (SELECT b FROM b)))
        SELECT bucket, round(min(sample)::DOUBLE, 6) AS minimum, round(max(sample)::DOUBLE, 6) AS maximum, round(avg(sample::DOUBLE)::FLOAT::DOUBLE, 6) AS mean
        FROM k JOIN {_ORDERS} o ON o.frame >= lo AND o.frame < hi GROUP BY bucket""",
    "peak_scale": f"SELECT round(greatest(1.0::FLOAT, max(abs((sample * 3::FLOAT)::FLOAT)))::DOUBLE, 6) AS amplitude_scale FROM {_ORDERS}",
    "dsl_two_tone": f"SELECT frame, round({_gain_of('sample::FLOAT', 0.5)}::DOUBLE, 6) + 0.0 AS sample FROM ({_recurrence(_select(_TWO_TONE_MIX), _decay(1000.0)).replace('round(y::FLOAT::DOUBLE, 6) + 0.0', 'y::FLOAT')})",
    "dsl_default_graph": f"SELECT frame, round({_gain_of('sample::FLOAT', 0.5)}::DOUBLE, 6) + 0.0 AS sample FROM ({_recurrence(_select(_DEFAULT_MIX), _SWEEP).replace('round(y::FLOAT::DOUBLE, 6) + 0.0', 'y::FLOAT')})",
    "blocks_to_frames": "SELECT vec_id * 64 + i - 1 AS frame, round(embedding[i]::FLOAT::DOUBLE, 6) + 0.0 AS sample FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "frames_to_blocks": f"""
        SELECT frame // 64 * 64 AS start_frame, count(*)::BIGINT AS n_samples, round(min_by(sample, frame)::DOUBLE, 6) AS first_sample, round(max_by(sample, frame)::DOUBLE, 6) AS last_sample,
            round(sum(round(sample::DOUBLE, 4)), 3) AS total FROM {_EVENTS} GROUP BY 1""",
}
