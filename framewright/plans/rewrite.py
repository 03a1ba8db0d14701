"""Rewrites of signal graphs that change no sample beyond rounding."""

from __future__ import annotations

from dataclasses import replace

from .nodes import Cutoff, Gain, Limit, LowPass, Mix, Node


def fuse_gains(node: Node) -> Node:
    """Two gains in a row become one where the first can't saturate (its factor is at most 1 in size)."""
    if isinstance(node, Gain):
        inner = fuse_gains(node.input)
        if isinstance(inner, Gain) and abs(inner.factor) <= 1:
            return Gain(node.config, inner.input, inner.factor * node.factor)
        return replace(node, input=inner)
    if isinstance(node, Limit):
        return replace(node, input=fuse_gains(node.input))
    if isinstance(node, Mix):
        return replace(node, parts=tuple(map(fuse_gains, node.parts)))
    if isinstance(node, LowPass):
        c = node.cutoff
        return replace(node, input=fuse_gains(node.input), cutoff=c if c.modulator is None else Cutoff(c.hz, fuse_gains(c.modulator), c.base_hz, c.depth_hz))
    return node
