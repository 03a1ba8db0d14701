"""One-dimensional sampled signals on Spark."""

from .config import RenderConfig
from .errors import DslError, FramewrightError, InvalidConfig, InvalidRender, PlanError, SinkError
from .functions.columns import frame_schema
from .operators.decode import FrameDecoder
from .signal import FrameSignal
from .sinks.svg import write_waveform_svg
from .sinks.wav import StreamingWavStats, write_streaming_wav, write_wav

__all__ = [
    "DslError", "FrameDecoder", "FrameSignal", "FramewrightError", "InvalidConfig", "InvalidRender", "PlanError", "RenderConfig",
    "SinkError", "StreamingWavStats", "frame_schema", "write_streaming_wav", "write_wav", "write_waveform_svg",
]
