"""How a graph is rendered."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import InvalidConfig

_LIMITS = {"sample_rate_hz": 2**32 - 1, "frame_count": 2**63 - 1, "batch_frame_capacity": 2**31 - 1, "max_render_seconds": 2**63 - 1}


@dataclass(frozen=True)
class RenderConfig:
    """``batch_frame_capacity`` is the size of a micro-batch; it changes no signal. Frames are long integers."""

    sample_rate_hz: int = 48_000
    frame_count: int = 48_000
    batch_frame_capacity: int = 1_024
    max_render_seconds: int = 60

    def __post_init__(self) -> None:
        for name, most in _LIMITS.items():
            value = getattr(self, name)
            if value <= 0:
                raise InvalidConfig(f"{name} must be greater than 0")
            if value > most:
                raise InvalidConfig(f"{name} must be at most {most}")
        longest = self.sample_rate_hz * self.max_render_seconds
        if longest > 2**64 - 1:
            raise InvalidConfig("sample_rate_hz × max_render_seconds overflows frame_count")
        if self.frame_count > longest:
            raise InvalidConfig(f"frame_count {self.frame_count} exceeds configured maximum {longest} ({self.sample_rate_hz} Hz × {self.max_render_seconds} s)")

    @property
    def nyquist_hz(self) -> float:
        return self.sample_rate_hz / 2
