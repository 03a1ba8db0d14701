"""Logical nodes of a signal graph. A node checks its parameters when it is made; nothing is computed before lowering."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..config import RenderConfig
from ..errors import PlanError
from ..functions import columns


@dataclass(frozen=True)
class Node:
    config: RenderConfig = field(repr=False)

    @property
    def inputs(self) -> tuple[Node, ...]:
        return ()

    @property
    def generated(self) -> bool:
        """Whether it is made of generators only: dense from frame 0 and without end."""
        return bool(self.inputs) and all(x.generated for x in self.inputs)

    @property
    def bounded(self) -> bool:
        return not self.generated

    def parameters(self) -> str:
        return ""

    def explain(self, depth: int = 0) -> str:
        lines = [f"{'  ' * depth}{type(self).__name__}{f' {self.parameters()}' if self.parameters() else ''}"]
        return "\n".join([*lines, *(x.explain(depth + 1) for x in self.inputs)])

    def _same_timeline(self) -> None:
        for x in self.inputs:
            if x.config.sample_rate_hz != self.config.sample_rate_hz:
                raise PlanError(f"{type(self).__name__}: expected input schema of {self.config.sample_rate_hz} Hz, got one of {x.config.sample_rate_hz} Hz")


@dataclass(frozen=True)
class Oscillator(Node):
    frequency_hz: float

    def __post_init__(self) -> None:
        columns.check_frequency(self.frequency_hz, self.config, "frequency_hz")

    @property
    def generated(self) -> bool:
        return True

    def parameters(self) -> str:
        return f"frequency_hz={self.frequency_hz}"


class Sine(Oscillator):
    pass


class Sawtooth(Oscillator):
    pass


@dataclass(frozen=True)
class Square(Oscillator):
    pulse_width: float

    def __post_init__(self) -> None:
        super().__post_init__()
        if not (math.isfinite(self.pulse_width) and 0 <= self.pulse_width <= 1):
            raise PlanError("pulse_width must be finite and between 0 and 1")

    def parameters(self) -> str:
        return f"{super().parameters()}, pulse_width={self.pulse_width}"


@dataclass(frozen=True)
class Source(Node):
    """Rows of a table with the schema of the configuration; frames may have gaps."""

    df: DataFrame = field(repr=False)

    def __post_init__(self) -> None:
        columns.check_schema(self.df, self.config, "Source")


@dataclass(frozen=True)
class Gain(Node):
    input: Node = field(repr=False)
    factor: float

    def __post_init__(self) -> None:
        object.__setattr__(self, "factor", columns.f32(self.factor, "gain"))
        self._same_timeline()

    @property
    def inputs(self) -> tuple[Node, ...]:
        return (self.input,)

    def parameters(self) -> str:
        return f"factor={self.factor}"


@dataclass(frozen=True)
class Mix(Node):
    parts: tuple[Node, ...] = field(repr=False)
    weights: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.parts) != len(self.weights):
            raise PlanError(f"mix must have the same number of inputs as gains, got {len(self.parts)} and {len(self.weights)}")
        object.__setattr__(self, "weights", tuple(columns.f32(w, f"gain at input {i}") for i, w in enumerate(self.weights)))
        self._same_timeline()

    @property
    def inputs(self) -> tuple[Node, ...]:
        return self.parts

    def parameters(self) -> str:
        return f"weights={list(self.weights)}"


@dataclass(frozen=True)
class Cutoff:
    """A constant frequency, or base + depth * sample of a modulator."""

    hz: float | None = None
    modulator: Node | None = field(default=None, repr=False)
    base_hz: float | None = None
    depth_hz: float | None = None

    @classmethod
    def modulated(cls, modulator: Node, base_hz: float | None = None, depth_hz: float | None = None) -> Cutoff:
        base = min(1000.0, modulator.config.nyquist_hz / 2) if base_hz is None else base_hz
        return cls(None, modulator, base, min(900.0, 0.9 * base) if depth_hz is None else depth_hz)


@dataclass(frozen=True)
class LowPass(Node):
    input: Node = field(repr=False)
    cutoff: Cutoff

    def __post_init__(self) -> None:
        c = self.cutoff
        if c.modulator is None:
            columns.check_frequency(c.hz, self.config, "cutoff_hz")
            if c.hz <= 0:
                raise PlanError("cutoff_hz must be greater than 0")
        else:
            if not (math.isfinite(c.base_hz) and math.isfinite(c.depth_hz)):
                raise PlanError("cutoff base_hz and depth_hz must be finite")
            for hz in (c.base_hz - c.depth_hz, c.base_hz + c.depth_hz):
                if not 0 < hz < self.config.nyquist_hz:
                    raise PlanError(f"cutoff mapping reaches {hz} Hz; it must stay above 0 and below Nyquist ({self.config.nyquist_hz:g} Hz)")
        self._same_timeline()

    @property
    def inputs(self) -> tuple[Node, ...]:
        return (self.input,) if self.cutoff.modulator is None else (self.input, self.cutoff.modulator)

    @property
    def generated(self) -> bool:
        """The audio alone decides how long it goes on; a bounded modulator must reach to its end."""
        return self.input.generated

    def parameters(self) -> str:
        c = self.cutoff
        return f"cutoff_hz={c.hz}" if c.modulator is None else f"base_hz={c.base_hz}, depth_hz={c.depth_hz}"


@dataclass(frozen=True)
class Limit(Node):
    """The first ``rows`` rows by frame."""

    input: Node = field(repr=False)
    rows: int

    def __post_init__(self) -> None:
        self._same_timeline()

    @property
    def inputs(self) -> tuple[Node, ...]:
        return (self.input,)

    @property
    def generated(self) -> bool:
        return False

    def parameters(self) -> str:
        return f"rows={self.rows}"
