import numpy as np
import pytest

from pyspark.sql import functions as F

from framewright import FrameSignal, InvalidRender, PlanError, RenderConfig
from framewright.sinks.wav import read_wav
from framewright.streaming import render

CONFIG = RenderConfig(8_000, 700, 256)


@pytest.mark.parametrize("make", [
    lambda s: FrameSignal.sine(s, CONFIG, 440).mix(FrameSignal.square(s, CONFIG, 100, 0.3), weights=(0.4, 0.6)).gain(0.5),
    lambda s: FrameSignal.sawtooth(s, CONFIG, 100).low_pass(500.0).gain(0.5).limit(),
    lambda s: FrameSignal.sawtooth(s, CONFIG, 100).low_pass(FrameSignal.sine(s, CONFIG, 3)),
])
def test_stream_equals_batch(spark, tmp_path, make):
    signal = make(spark)
    got = render.decode(render.stream(signal), CONFIG, str(tmp_path))
    want = signal.decode()
    assert len(got) == 700 and np.allclose(got, want, rtol=1e-5, atol=1e-7)


def test_tables_have_no_stream(spark):
    df = FrameSignal.sine(spark, CONFIG, 1).to_df()
    with pytest.raises(PlanError):
        render.stream(FrameSignal.from_dataframe(df, CONFIG).gain(0.5))


@pytest.mark.parametrize("make", [
    lambda s: FrameSignal.sawtooth(s, CONFIG, 100).low_pass(500.0).mix(FrameSignal.square(s, CONFIG, 60, 0.4).low_pass(90.0).gain(2.0), FrameSignal.sine(s, CONFIG, 9), weights=(0.5, 0.4, 0.3)),
    lambda s: FrameSignal.sawtooth(s, CONFIG, 100).low_pass(3_000.0).low_pass(FrameSignal.square(s, CONFIG, 5, 0.5).low_pass(50.0)).gain(0.7),
])
def test_filters_anywhere_in_a_stream(spark, tmp_path, make):
    signal = make(spark)
    assert np.allclose(render.decode(render.stream(signal), CONFIG, str(tmp_path)), signal.decode(), rtol=1e-5, atol=1e-6)


def test_stream_to_wav(spark, tmp_path):
    signal = FrameSignal.sine(spark, CONFIG, 440).low_pass(900.0)
    path = str(tmp_path / "out.wav")
    stats = render.write_wav(path, render.stream(signal), CONFIG, str(tmp_path / "ok"))
    rate, samples = read_wav(path)
    assert rate == 8_000 and stats.frames == 700
    assert np.allclose(samples, signal.decode(), rtol=1e-5, atol=1e-7)
    before = open(path, "rb").read()
    bad = render.stream(signal).withColumn("sample", F.when(F.col("frame") == 600, F.lit(2.0).cast("float")).otherwise(F.col("sample")))
    with pytest.raises(InvalidRender):
        render.write_wav(path, bad, CONFIG, str(tmp_path / "bad"))
    assert open(path, "rb").read() == before and [p.name for p in tmp_path.iterdir() if p.suffix == ".wav"] == ["out.wav"]


def test_filter_by_batches_equals_one_frame_at_a_time():
    rng = np.random.default_rng(4)
    for scale in (1e-4, 0.3, 40.0, 900.0):
        x, step, gap = rng.uniform(-1, 1, 500), rng.uniform(0, scale, 500), rng.integers(1, 4, 500)
        y, want = 0.25, []
        for v, s, g in zip(x, step, gap):
            y = y * np.exp(-s * g) - np.expm1(-s) * v
            want.append(y)
        assert np.allclose(render.filtered(x, step, gap, 0.25), want, rtol=1e-9, atol=1e-12)


def test_disorder_in_a_batch_fails():
    render.check_order(np.array([3, 4, 9]), 2)
    for frames, said in (([3, 5, 4], "frame 4 after 5"), ([3, 3], "frame 3 after 3"), ([2, 3], "frame 2 after 2")):
        with pytest.raises(ValueError, match=said):
            render.check_order(np.array(frames), 2)
