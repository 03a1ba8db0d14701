"""A picture of a signal: per bucket a line from the least to the largest sample, and the means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import RenderConfig
from ..errors import SinkError
from ..operators import waveform

# The picture's size in pixels and its colours.
WIDTH, HEIGHT, PADDING = 1200, 320, 16
BACKGROUND, BASELINE, ENVELOPE, MEAN = "#07111f", "#334155", "#38bdf8", "#e0f2fe"


def _summary(signal: DataFrame | np.ndarray, config: RenderConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.float32]:
    """(least, largest, mean) of each bucket and the scale; at most 1,168 rows come to the driver."""
    if isinstance(signal, DataFrame):
        table = waveform.buckets(signal, config.frame_count).orderBy("bucket").toArrow()
        low, high, mean = (table.column(c).cast(pa.float32()).to_numpy() for c in ("minimum", "maximum", "mean"))
    else:
        n = len(signal)
        b = min(n, waveform.MOST_BUCKETS)
        cuts = np.arange(b + 1) * n // b
        low, high = (f.reduceat(signal, cuts[:-1]) for f in (np.minimum, np.maximum))
        mean = np.array([signal[x:y].astype(np.float64).mean() for x, y in zip(cuts, cuts[1:])], np.float32)
    return low, high, mean, np.float32(max(1.0, np.abs(low).max(), np.abs(high).max()))


def render(signal: DataFrame | np.ndarray, config: RenderConfig) -> str:
    """The same text for the same signal, always."""
    low, high, mean, scale = _summary(signal, config)
    n = len(low)
    wide = np.float32(WIDTH - 2 * PADDING)
    x = np.float32(PADDING) + np.arange(n, dtype=np.float32) * wide / np.float32(max(1, n - 1)) if n > 1 else np.array([WIDTH / 2], np.float32)
    middle = np.float32(HEIGHT / 2)
    high_y, low_y, mean_y = (middle - v / scale * (middle - np.float32(PADDING)) for v in (high, low, mean))
    envelope = " ".join(f"M{a:.3f},{b:.3f} V{c:.3f}" for a, b, c in zip(x, high_y, low_y))
    means = " ".join(f"{a:.3f},{b:.3f}" for a, b in zip(x, mean_y))
    shapes = [
        f'<line id="zero-baseline" x1="{PADDING}" y1="{middle:.3f}" x2="{WIDTH - PADDING}" y2="{middle:.3f}" stroke="{BASELINE}" stroke-width="1"/>',
        f'<path id="waveform-envelope" d="{envelope}" fill="none" stroke="{ENVELOPE}" stroke-width="1" stroke-linecap="round"/>',
        f'<polyline id="waveform-mean" points="{means}" fill="none" stroke="{MEAN}" stroke-width="1" stroke-linejoin="round"/>',
    ]
    lines = [
        '<?xml version="1.0" encoding="UTF-8"?>',
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}">',
        f'  <rect width="{WIDTH}" height="{HEIGHT}" fill="{BACKGROUND}"/>',
        f'  <g id="waveform" data-frame-count="{config.frame_count}" data-bucket-count="{n}" data-amplitude-scale="{scale:.6f}">',
        *(f"    {s}" for s in shapes),
        "  </g>",
        "</svg>",
    ]
    return "\n".join(lines) + "\n"


def write_waveform_svg(path: str, signal: DataFrame | np.ndarray, config: RenderConfig) -> None:
    if not isinstance(signal, DataFrame):
        from .wav import check_samples

        signal = check_samples(signal, config)
    text = render(signal, config)
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    except OSError as e:
        raise SinkError("write", path, e) from e
