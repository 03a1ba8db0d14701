"""What can go wrong, by stage."""

from __future__ import annotations


class FramewrightError(Exception):
    """Any failure of this package."""


class InvalidConfig(FramewrightError):
    """A render configuration out of its limits."""


class PlanError(FramewrightError):
    """A node that can't be built from its inputs and parameters."""


class InvalidRender(FramewrightError):
    """Rows that are no complete rendering of a signal."""


class SinkError(FramewrightError):
    """A file that can't be written: what was being done, where, and why."""

    def __init__(self, action: str, path: str, cause: Exception):
        super().__init__(f"failed to {action} {path}: {cause}")
        self.action, self.path = action, path


class DslError(FramewrightError):
    """A graph text that can't be read; line and column count from 1, columns in characters."""

    def __init__(self, message: str, line: int | None = None, column: int | None = None):
        super().__init__(message if line is None else f"line {line}, column {column}: {message}")
        self.line, self.column = line, column
