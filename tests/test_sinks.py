import math
import os
import struct

import numpy as np
import pyarrow as pa
import pytest

from framewright import FrameSignal, InvalidRender, RenderConfig, SinkError, preview, write_streaming_wav, write_wav, write_waveform_svg
from framewright.sinks import svg
from framewright.sinks.wav import read_wav


def batches(samples, size):
    for a in range(0, len(samples), size):
        part = samples[a : a + size]
        yield pa.RecordBatch.from_arrays([pa.array(range(a, a + len(part)), pa.int64()), pa.array(part, pa.float32())], ["frame", "sample"])


RAMP = (np.arange(11) * 0.2 - 1).clip(-1, 1).astype(np.float32)
CONFIG = RenderConfig(frame_count=11)


def test_wav_round_trip(tmp_path):
    path = str(tmp_path / "a.wav")
    write_wav(path, RAMP, CONFIG)
    rate, samples = read_wav(path)
    assert rate == 48_000 and np.array_equal(samples, RAMP)
    raw = open(path, "rb").read()
    assert struct.unpack_from("<I", raw, 4)[0] == len(raw) - 8


@pytest.mark.parametrize("size", [1, 3, 4, 11])
def test_streaming_equals_collected(tmp_path, size):
    one, two = str(tmp_path / "one.wav"), str(tmp_path / "two.wav")
    write_wav(one, RAMP, CONFIG)
    stats = write_streaming_wav(two, batches(RAMP, size), CONFIG)
    assert open(one, "rb").read() == open(two, "rb").read()
    assert stats.frames == 11 and stats.first_decoded_batch >= 0


def test_a_failed_stream_keeps_the_old_file(tmp_path):
    path = str(tmp_path / "a.wav")
    write_wav(path, RAMP, CONFIG)
    before = open(path, "rb").read()

    def broken():
        yield next(batches(RAMP, 4))
        raise RuntimeError("source failed")

    for bad, error in ((batches(RAMP[:5], 4), InvalidRender), (broken(), RuntimeError), (batches(np.append(RAMP, 0), 4), InvalidRender)):
        with pytest.raises(error):
            write_streaming_wav(path, bad, CONFIG)
        assert os.listdir(tmp_path) == ["a.wav"] and open(path, "rb").read() == before


def test_samples_are_checked_before_the_file_is_made(tmp_path):
    path = str(tmp_path / "a.wav")
    for samples, message in ((RAMP[:3], "expected 11, got 3"), (np.append(RAMP[:10], np.float32(math.nan)), "non-finite sample at frame 10"), (np.append(RAMP[:10], np.float32(1.5)), "out-of-range sample at frame 10")):
        with pytest.raises(InvalidRender, match=message):
            write_wav(path, samples, CONFIG)
    assert not os.path.exists(path)
    with pytest.raises(SinkError, match="failed to create"):
        write_wav(str(tmp_path / "no" / "a.wav"), RAMP, CONFIG)
    with pytest.raises(SinkError, match="failed to create temporary"):
        write_streaming_wav(str(tmp_path / "no" / "a.wav"), batches(RAMP, 4), CONFIG)


def test_dataframe_to_wav(spark, tmp_path):
    config = RenderConfig(8_000, 4_000)
    signal = FrameSignal.sine(spark, config, 440).low_pass(1000.0)
    path = str(tmp_path / "a.wav")
    write_streaming_wav(path, signal.to_df(), config)
    assert np.array_equal(read_wav(path)[1], signal.decode())


def test_svg(spark, tmp_path):
    config = RenderConfig(8, 5)
    text = svg.render(np.array([0, 1, 0, -1, 0], np.float32), config)
    assert 'viewBox="0 0 1200 320"' in text and 'data-bucket-count="5"' in text and 'data-frame-count="5"' in text
    assert 'd="M16.000,160.000 V160.000 M308.000,16.000 V16.000' in text
    assert text == svg.render(np.array([0, 1, 0, -1, 0], np.float32), config)
    n = 1168 * 3 + 17
    spike = np.zeros(n, np.float32)
    spike[n // 2] = 1
    long = svg.render(spike, RenderConfig(frame_count=n))
    assert 'data-bucket-count="1168"' in long and 'data-amplitude-scale="1.000000"' in long and "nan" not in long
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(spike)], "frame long, sample float")
    assert svg.render(df, RenderConfig(frame_count=n)) == long
    assert "M600.000," in svg.render(np.zeros(1, np.float32), RenderConfig(frame_count=1))
    path = tmp_path / "a.svg"
    write_waveform_svg(str(path), np.zeros(5, np.float32), config)
    assert path.read_text().startswith("<?xml")
    with pytest.raises(SinkError):
        write_waveform_svg(str(tmp_path / "no" / "a.svg"), np.zeros(5, np.float32), config)


def test_preview(spark, tmp_path, capsys):
    graph = tmp_path / "g.txt"
    graph.write_text("sine(440) -> gain(0.5) -> out")
    path = preview.main(["--graph", str(graph), "--seconds", "0.1", "--waveform", "--output-dir", str(tmp_path / "out"), "--player", "true"], spark)
    assert len(read_wav(path)[1]) == 4800 and os.path.exists(path.removesuffix(".wav") + ".svg")
    assert "first decoded batch" in capsys.readouterr().out
    for bad in (["--seconds", "0"], ["--seconds", "nan"], ["--seconds", "x"], ["--what"]):
        with pytest.raises(SystemExit):
            preview.options(bad)
