import math

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framewright import FrameDecoder, FrameSignal, InvalidRender, PlanError, RenderConfig, frame_schema
from framewright.functions import columns
from framewright.operators import blocks, decode, waveform
from framewright.plans import nodes
from framewright.plans.rewrite import fuse_gains
from framewright.sources.tables import signal_table

SMALL = RenderConfig(8, 10, 4)


#: What a task's failure is raised as; the second where several stages fail at once.
FAILED = (PySparkException, Py4JJavaError)


def table(spark, rows, config=SMALL):
    df = spark.createDataFrame(rows, "frame long, sample float")
    return FrameSignal.from_dataframe(columns.conform(df, config), config)


def rows_of(signal):
    return [(r.frame, r.sample) for r in signal.to_df().orderBy("frame").collect()]


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert abs(a - b) <= max(1e-7, 1e-5 * max(abs(a), abs(b))), (got, want)


def test_oscillators(spark):
    assert np.allclose(FrameSignal.sine(spark, SMALL, 2).decode(), [0, 1, 0, -1, 0, 1, 0, -1, 0, 1], atol=1e-6)
    assert FrameSignal.square(spark, SMALL, 2, 0.25).decode().tolist() == [1, -1, -1, -1, 1, -1, -1, -1, 1, -1]
    assert FrameSignal.sawtooth(spark, SMALL, 2).decode().tolist() == [-1, -0.5, 0, 0.5, -1, -0.5, 0, 0.5, -1, -0.5]
    assert set(FrameSignal.square(spark, SMALL, 2, 0).decode()) == {-1}
    assert set(FrameSignal.square(spark, SMALL, 2, 1).decode()) == {1}
    assert set(FrameSignal.square(spark, SMALL, 0, 0.5).decode()) == {1}
    assert set(FrameSignal.sawtooth(spark, SMALL, 0).decode()) == {-1}


@pytest.mark.parametrize("hz,message", [(math.nan, "finite"), (-1, "greater than or equal"), (4, "below Nyquist"), (math.inf, "finite")])
def test_frequency_limits(spark, hz, message):
    with pytest.raises(PlanError, match=message):
        FrameSignal.sine(spark, SMALL, hz)


def test_pulse_width_limits(spark):
    for width in (-0.1, 1.1, math.nan):
        with pytest.raises(PlanError, match="pulse_width"):
            FrameSignal.square(spark, SMALL, 2, width)


def test_gain(spark):
    close(FrameSignal.sine(spark, SMALL, 2).gain(0.5).decode(), [0, 0.5, 0, -0.5, 0, 0.5, 0, -0.5, 0, 0.5])
    for factor in (0, -0.5, 1e-4, 1e4):
        close(FrameSignal.sine(spark, SMALL, 1).gain(factor).decode(), np.clip(np.sin(2 * np.pi * np.arange(10) / 8).astype(np.float32).astype(float) * float(np.float32(factor)), -1, 1).astype(np.float32))
    with pytest.raises(PlanError, match="finite"):
        FrameSignal.sine(spark, SMALL, 1).gain(math.inf)


@pytest.mark.parametrize("bad,what", [(math.nan, "non-finite"), (1.01, "out-of-range"), (-1.01, "out-of-range"), (math.inf, "non-finite")])
def test_bad_samples_fail_whatever_the_result_would_be(spark, bad, what):
    signal = table(spark, [(0, 0.5), (3, bad)])
    for made in (signal.gain(0.0), signal.mix(FrameSignal.sine(spark, SMALL, 1), weights=(0.0, 1.0)), signal.low_pass(1.0)):
        with pytest.raises(FAILED, match=f"{what} sample at frame 3"):
            made.to_df().collect()


def test_mix(spark):
    one, two = FrameSignal.sine(spark, SMALL, 1), FrameSignal.sine(spark, SMALL, 2)
    close(one.mix(two, weights=(0.25, 0.5)).decode()[:4], [0, 0.6767767, 0.25, -0.3232233])
    loud = FrameSignal.square(spark, SMALL, 0, 1)
    most = float(np.finfo(np.float32).max)
    assert set(loud.mix(weights=(most,)).decode()) == {1.0}
    assert set(loud.mix(loud.gain(-1), weights=(most, most)).decode()) == {0.0}
    master = one.mix(FrameSignal.square(spark, SMALL, 1, 0.5), weights=(0.4, 0.6)).gain(0.5).decode()
    close(master[[0, 2, 4, 6]], [0.3, 0.5, -0.3, -0.5])


def test_mix_of_tables_is_a_full_outer_join(spark):
    a, b, c = table(spark, [(0, 0.5), (1, 0.25), (4, 1.0)]), table(spark, [(1, 0.5), (2, -0.5)]), table(spark, [])
    assert rows_of(a.mix(b, c, weights=(1, 0.5, 1))) == [(0, 0.5), (1, 0.5), (2, -0.25), (4, 1.0)]
    with pytest.raises(FAILED, match="duplicate frame 1"):
        table(spark, [(1, 0.5), (1, 0.25)]).mix(b).to_df().collect()
    assert nodes.Mix(SMALL, (), ()).weights == ()
    with pytest.raises(PlanError, match="same number of inputs as gains"):
        a.mix(b, weights=(1,))
    with pytest.raises(PlanError, match="gain at input 0 must be finite"):
        a.mix(b, weights=(math.nan, 1))


def test_mix_of_a_generator_and_a_table(spark):
    got = rows_of(table(spark, [(1, 0.5), (20, 0.5)]).mix(FrameSignal.square(spark, SMALL, 0, 1), weights=(1, 0.25)).limit())
    assert got == [(n, 0.75 if n == 1 else 0.25) for n in range(10)]


def one_pole(rows, steps):
    """Frame by frame, as a model: rows {frame: sample}, steps[frame]."""
    y, out = 0.0, {}
    for n in range(max(rows) + 1):
        y = y * math.exp(-steps[n]) - math.expm1(-steps[n]) * rows.get(n, 0.0)
        if n in rows:
            out[n] = np.float32(y)
    return out


HALF = 8 * math.log(2) / (2 * math.pi)


@pytest.mark.parametrize("rows, message", [([(None, 1.0), (1, 0.5)], "null frame index"), ([(0, None), (1, 0.5)], "null sample")])
def test_nulls_fail_at_any_input(spark, rows, message):
    signal = table(spark, rows)
    assert [f.nullable for f in signal.to_df().schema] == [False, False]
    for made in (signal, signal.gain(0.5), signal.mix(signal), signal.low_pass(1.0), signal.low_pass(FrameSignal.sine(spark, SMALL, 1), 2.0, 1.0)):
        with pytest.raises(FAILED, match=message):
            made.to_df().collect()
    df = spark.createDataFrame(rows, "frame long, sample float")
    with pytest.raises(FAILED, match=message):
        signal_table(df, F.col("frame"), F.col("sample"), SMALL).collect()


@pytest.mark.parametrize("frames, message", [([0, 1, 1, 3], "out-of-order frame 1 after 1"), ([-1, 0], "out-of-order frame -1 after -1"), ([5, 2, 5], "out-of-order frame 5 after 5")])
def test_filter_audio_must_have_each_frame_once(spark, frames, message):
    signal = table(spark, [(f, 0.5) for f in frames])
    modulator = FrameSignal.sine(spark, SMALL, 1)
    for made in (signal.low_pass(1.0), signal.low_pass(modulator, 2.0, 1.0), signal.gain(0.5).low_pass(3.0).gain(0.1)):
        with pytest.raises(FAILED, match=message):
            made.to_df().collect()
    assert len(rows_of(table(spark, [(f, 0.5) for f in (0, 1, 3)]).low_pass(1.0))) == 3


def test_low_pass_constant(spark):
    close([s for _, s in rows_of(table(spark, [(0, 1.0), (1, 0.0), (2, 0.0), (4, 0.0)]).low_pass(HALF))], [0.5, 0.25, 0.125, 0.03125])
    close([s for _, s in rows_of(table(spark, [(0, 1.0), (1, 0.0), (2, 0.0), (3, 0.0)]).low_pass(HALF))], [0.5, 0.25, 0.125, 0.0625])


def test_low_pass_modulated(spark):
    audio, mod = table(spark, [(0, 1.0), (3, 0.0)]), table(spark, [(0, -1.0), (1, 1.0), (2, -1.0), (3, 1.0), (4, 9.0)])
    got = rows_of(audio.low_pass(mod, 1.5 * HALF, 0.5 * HALF))
    assert [n for n, _ in got] == [0, 3]
    close([s for _, s in got], [0.5, 0.015625])
    flat = table(spark, [(n, 0.0) for n in range(6)])
    noise = table(spark, [(0, 0.3), (2, -0.8), (5, 1.0)])
    close([s for _, s in rows_of(noise.low_pass(flat, 1.5, 0.5))], [s for _, s in rows_of(noise.low_pass(1.5))])


# Modulators of three frames of audio, and what is wrong with them.
@pytest.mark.parametrize(
    "mod,message",
    [([], "expected frame 0"), ([(1, 0.0)], "expected frame 0"), ([(0, 0.0), (2, 0.0)], "expected frame 1"), ([(0, 0.0), (0, 0.0)], "expected frame"), ([(0, 0.0), (1, math.nan), (2, 0.0)], "non-finite sample at frame 1"), ([(0, 0.0), (1, 1.01), (2, 0.0)], "out-of-range sample at frame 1")],
)
def test_malformed_modulation(spark, mod, message):
    with pytest.raises(FAILED, match=message):
        table(spark, [(0, 1.0), (1, 0.0), (2, 0.0)]).low_pass(table(spark, mod), 1.0, 0.5).to_df().collect()


def test_cutoff_limits(spark):
    audio = FrameSignal.sine(spark, SMALL, 1)
    for hz in (0, -1, 4, math.nan):
        with pytest.raises(PlanError):
            audio.low_pass(hz)
    for base, depth in ((1, 1), (3, 1), (1, -1), (math.nan, 0.1)):
        with pytest.raises(PlanError):
            audio.low_pass(audio, base, depth)
    assert (nodes.Cutoff.modulated(audio.node).base_hz, nodes.Cutoff.modulated(audio.node).depth_hz) == (2.0, 1.8)
    far = FrameSignal.sine(spark, RenderConfig(), 1).node
    assert (nodes.Cutoff.modulated(far).base_hz, nodes.Cutoff.modulated(far).depth_hz) == (1000.0, 900.0)


@pytest.mark.parametrize("hz", [0.5, 30.0, 1000.0, 20_000.0])
@pytest.mark.parametrize("partitions", [1, 7])
def test_low_pass_against_the_recurrence(spark, hz, partitions):
    rng = np.random.default_rng(3)
    config = RenderConfig(frame_count=200_000)
    frames = np.flatnonzero(rng.random(150_000) < 0.1)
    rows = dict(zip(frames.tolist(), rng.uniform(-1, 1, len(frames)).astype(np.float32).tolist()))
    df = spark.createDataFrame(list(rows.items()), "frame long, sample float").repartition(partitions)
    got = FrameSignal.from_dataframe(columns.conform(df, config), config).low_pass(hz)
    want = one_pole(rows, [2 * math.pi * hz / 48_000] * 150_000)
    close([s for _, s in rows_of(got)], list(want.values()))


def test_low_pass_modulated_against_the_recurrence(spark):
    config = RenderConfig(frame_count=150_000)
    got = FrameSignal.sawtooth(spark, config, 100).low_pass(FrameSignal.sine(spark, config, 3)).decode()
    n = np.arange(150_000)
    audio = (2 * ((n * 100.0 / 48_000) % 1.0) - 1).astype(np.float32).tolist()
    mod = np.sin(2 * np.pi * n * 3.0 / 48_000).astype(np.float32).astype(float)
    want = one_pole(dict(enumerate(audio)), (2 * math.pi * (1000 + 900 * mod) / 48_000).tolist())
    close(got.tolist(), list(want.values()))


def test_other_timelines_are_rejected(spark):
    other = RenderConfig(16, 10)
    with pytest.raises(PlanError, match="expected input schema"):
        FrameSignal.sine(spark, SMALL, 1).mix(FrameSignal.sine(spark, other, 1))
    with pytest.raises(PlanError, match="expected input schema"):
        FrameSignal.from_dataframe(FrameSignal.sine(spark, other, 1).to_df(), SMALL)
    with pytest.raises(PlanError, match="expected input schema"):
        FrameSignal.from_dataframe(spark.createDataFrame([(0, 1.0)], "frame long, sample double"), SMALL)
    assert FrameSignal.sine(spark, SMALL, 1).to_df().schema == frame_schema(RenderConfig(8, 3, 99))


def test_limit(spark):
    assert rows_of(table(spark, [(9, 0.5), (2, 0.25), (5, 0.0)]).limit(2)) == [(2, 0.25), (5, 0.0)]
    plan = FrameSignal.sine(spark, RenderConfig(), 440).gain(0.5).limit(100).to_df()
    assert plan.count() == 100
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_gain_fusion(spark):
    quiet, loud = FrameSignal.sine(spark, SMALL, 1).gain(0.5).gain(0.5), FrameSignal.sine(spark, SMALL, 1).gain(4).gain(0.25)
    assert fuse_gains(quiet.node) == nodes.Gain(SMALL, nodes.Sine(SMALL, 1.0), 0.25)
    assert fuse_gains(loud.node) == loud.node
    close(quiet.optimized().decode(), quiet.decode())


def test_explain(spark, capsys):
    text = FrameSignal.sine(spark, SMALL, 1).low_pass(2.0).gain(0.5).limit().explain()
    assert text.splitlines() == ["Limit rows=10", "  Gain factor=0.5", "    LowPass cutoff_hz=2.0", "      Sine frequency_hz=1.0"]


@pytest.mark.parametrize(
    "frames,message",
    [([0, 1, 1, 3], "expected frame 2, got 1"), ([0, 1, 3, 4], "expected frame 2, got 3"), ([0, 1], "first missing frame is 2"), ([0, 1, 2, 3, 4], "unexpected extra frame")],
)
def test_decoder(spark, frames, message):
    config = RenderConfig(8, 4)
    with pytest.raises(InvalidRender, match=message):
        table(spark, [(n, 0.0) for n in frames], config).decode()


def test_decoder_checks_order_and_values():
    import pyarrow as pa

    def batch(frames, samples):
        return pa.RecordBatch.from_arrays([pa.array(frames, pa.int64()), pa.array(samples, pa.float32())], ["frame", "sample"])

    config = RenderConfig(8, 4)
    for b, message in [
        (batch([0, 2, 1], [0, 0, 0]), "expected frame 1, got 2"),
        (batch([None], [0]), "null frame index"),
        (batch([0], [None]), "null sample at frame 0"),
        (batch([0], [math.nan]), "non-finite sample at frame 0"),
        (batch([0, 1], [0, 1.5]), "out-of-range sample at frame 1 in batch 0 row 1: 1.5"),
    ]:
        with pytest.raises(InvalidRender, match=message):
            FrameDecoder(config).decode_batch(b)
    with pytest.raises(InvalidRender, match="schema mismatch"):
        FrameDecoder(config).decode_batch(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0.0])], ["frame", "sample"]))
    decoder = FrameDecoder(config)
    assert decoder.decode_batch(batch([0, 1], [0, 1])).tolist() == [0, 1]
    assert decoder.decode_batch(batch([2, 3], [0, -1])).tolist() == [0, -1]
    decoder.finish()


def test_report(spark):
    df = spark.createDataFrame([(0, 0.5), (0, 0.5), (2, float("nan")), (3, None), (9, 2.0)], "frame long, sample float")
    assert decode.report(df, 5).first().asDict() == {
        "n_rows": 5, "n_frames": 3, "n_missing": 2, "n_repeated": 1, "n_extra": 1, "n_null_samples": 1, "n_non_finite": 1, "n_out_of_range": 1, "first_bad_frame": 0,
    }


def test_delivery_order(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (1, 2, 0.0), (2, 1, 0.0)], "seq int, frame long, sample float")
    with pytest.raises(FAILED, match="out-of-order frame 1 after 2"):
        decode.check_delivery(df, "seq").collect()
    assert decode.check_delivery(df.where("seq < 2"), "seq").count() == 2
    wide = [(k * 30_000, 10 * k, 0.5) for k in range(12)]  # several pieces of the order
    got = decode.check_delivery(spark.createDataFrame(wide, "seq int, frame long, sample float"), "seq")
    assert got.columns == ["seq", "frame", "sample"] and sorted(map(tuple, got.collect())) == wide
    wide[7] = (210_000, 60, 0.5)  # the first of its piece, as the last of the piece before
    with pytest.raises(FAILED, match="out-of-order frame 60 after 60"):
        decode.check_delivery(spark.createDataFrame(wide, "seq int, frame long, sample float"), "seq").collect()


def test_blocks(spark):
    df = spark.range(150).select(F.col("id").alias("frame"), (F.col("id") / 150).cast("float").alias("sample"))
    made = blocks.to_blocks(df, 64)
    assert sorted((r.start_frame, len(r.samples)) for r in made.collect()) == [(0, 64), (64, 64), (128, 22)]
    assert sorted(blocks.to_frames(made).collect()) == sorted(df.collect())


@pytest.mark.parametrize("n", [1, 5, 1168, 1169, 3521])
def test_waveform_buckets(spark, n):
    rng = np.random.default_rng(n)
    samples = rng.uniform(-1, 1, n).astype(np.float32)
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(samples)], "frame long, sample float")
    got = waveform.buckets(df, n).orderBy("bucket").collect()
    b = min(n, 1168)
    assert len(got) == b
    for i, r in enumerate(got):
        part = samples[i * n // b : (i + 1) * n // b]
        assert (r.minimum, r.maximum) == (part.min(), part.max()) and abs(r["mean"] - part.mean()) < 1e-6


def test_view(spark):
    FrameSignal.sine(spark, SMALL, 2).as_view("tone")
    assert spark.sql("SELECT count(*) FROM tone WHERE abs(sample) > 0.5").first()[0] == 5
