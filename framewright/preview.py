"""Renders a graph to a WAV file: python -m framewright.preview [--graph FILE] [--seconds S] [--waveform] [--output-dir DIR] [--player COMMAND] [--player-arg ARG]..."""

from __future__ import annotations

import argparse
import math
import os
import subprocess
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from . import FrameSignal, RenderConfig, write_streaming_wav, write_waveform_svg
from .errors import FramewrightError
from .sources.tables import DEFAULT_GRAPH, read_graph

SAMPLE_RATE_HZ = 48_000


def options(arguments: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="preview", description="Render a signal graph to a WAV file and, with a player, play it.")
    p.add_argument("--graph", help="a graph text; without it a built-in graph")
    p.add_argument("--seconds", type=float, default=1.0)
    p.add_argument("--waveform", action="store_true", help="also draw the waveform as SVG")
    p.add_argument("--output-dir", default="preview")
    p.add_argument("--player", help="a command that gets the file as its last argument")
    p.add_argument("--player-arg", action="append", default=[])
    out = p.parse_args(arguments)
    if not (math.isfinite(out.seconds) and out.seconds > 0):
        p.error("--seconds must be a positive finite number")
    out.frames = math.floor(out.seconds * SAMPLE_RATE_HZ + 0.5)
    if out.frames < 1:
        p.error("--seconds must produce at least one frame")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """The path of the WAV file."""
    o = options(sys.argv[1:] if arguments is None else arguments)
    began = time.monotonic()

    def said(what: str, since: float) -> None:
        print(f"{what}: {time.monotonic() - since:.3f} s")

    spark = spark or SparkSession.builder.appName("preview").getOrCreate()
    config = RenderConfig(SAMPLE_RATE_HZ, o.frames, max_render_seconds=max(60, math.ceil(o.seconds)))
    t = time.monotonic()
    signal = FrameSignal.from_graph(spark, read_graph(o.graph) if o.graph else DEFAULT_GRAPH, config)
    said("graph construction", t)
    os.makedirs(o.output_dir, exist_ok=True)
    handle, path = tempfile.mkstemp(".wav", "preview-", o.output_dir)
    os.close(handle)
    t = time.monotonic()
    df = signal.to_df()
    stats = write_streaming_wav(path, df, config)
    print(f"first decoded batch: {stats.first_decoded_batch:.3f} s")
    said("render and output", t)
    if o.waveform:
        write_waveform_svg(path.removesuffix(".wav") + ".svg", df, config)
    print(path)
    if o.player:
        said("start to player launch", began)
        subprocess.run([o.player, *o.player_arg, path], check=True)
    return path


if __name__ == "__main__":
    try:
        main()
    except (FramewrightError, OSError, subprocess.CalledProcessError) as e:
        sys.exit(f"preview: {e}")
