import numpy as np
import pytest

from framewright import DslError, FrameSignal, RenderConfig
from framewright.plans import dsl, nodes

CONFIG = RenderConfig()

# Graph texts and what their errors say.
ERRORS = [
    ("sawtooth() -> out", "sawtooth expects 1 numeric argument"),
    ("sawtooth(440, 0.5) -> out", "sawtooth expects 1 numeric argument"),
    ("sine(440) -> sawtooth(220) -> out", "sawtooth is a source and takes no input"),
    ("sine(440) -> $A;\nmix($A, $B) -> out", "line 2, column 1: undefined reference $B"),
    ("sine(440) -> $A; sine(220) -> $A; $A -> out", "duplicate binding $A"),
    ("sine(440) -> out; sine(220) -> out", "more than one out"),
    ("sine(440) -> gain(0.5)", "statement must end in a binding or out"),
    ("sine(440) -> $A; mix([$A], [0.4, 0.6]) -> out", "mix has 1 inputs but 2 weights"),
    ("sine(440) -> lpf(100000) -> out", "cutoff_hz must be below Nyquist"),
    ("sine(440) -> out -> gain(0.5)", "out must end a statement"),
    ("sine(440) -> $A\nsine(220) -> out", "expected ';' between statements"),
    ("", "graph requires one out"),
    ("out", "out requires an input"),
    ("out(1)", 'unknown node "out"'),
    ("sine(440) -> $A -> gain(1) -> out", "binding must end a statement"),
    ("$A", "undefined reference $A"),
    ("mix() -> out", "mix requires at least one input"),
    ("sine(1) -> $", "expected identifier after $"),
    ("sine(1e999) -> out", "number must be finite"),
    ("sine(1.2.3) -> out", 'invalid number "1.2.3"'),
    ("sine(1) -> gain(1e39) -> out", "gain factor exceeds f32 range"),
    ("sine(1) ? out", "unexpected character '?'"),
    ("sine(1) -> lpf([1]) -> out", "lpf cutoff must be finite or a $reference"),
    ("sine(1) -> gain($A) -> out", "gain expects one input and one numeric argument"),
    ("sine($A) -> out", "sine expects numeric arguments"),
]


@pytest.mark.parametrize("text,message", ERRORS)
def test_errors(text, message):
    with pytest.raises(DslError) as e:
        dsl.build(text, CONFIG)
    assert message in str(e.value)


def test_forms_that_mean_the_same():
    a = dsl.build("sine(440) -> $a; sine(2) -> $b; mix($a, [$b], [0.5, 0.25]) -> lpf($b) -> gain(0.5) -> out;", CONFIG)
    b = dsl.build("sine(440) -> $a; sine(2) -> $b; # a comment\n $a -> mix([$b], [0.5, 0.25]) -> $m; lpf($m, $b) -> $f; gain($f, 0.5) -> out", CONFIG)
    assert a == b
    assert isinstance(a, nodes.Limit) and a.rows == CONFIG.frame_count
    assert dsl.build("sine(4) -> $a; $a -> $b; $b -> out", CONFIG) == dsl.build("sine(4) -> out", CONFIG)
    assert dsl.build("sine(4) -> $a; mix($a) -> out", CONFIG).input.weights == (1.0,)


def test_sawtooth_graph(spark):
    config = RenderConfig(8, 8)
    got = FrameSignal.from_graph(spark, "sawtooth(2) -> gain(0.5) -> out", config).decode()
    assert got.tolist() == [-0.5, -0.25, 0, 0.25, -0.5, -0.25, 0, 0.25]


def test_graph_equals_builder(spark):
    config = RenderConfig(8_000, 32, 7)
    text = "sine(440) -> $a; sine(1) -> $m; $a -> lpf($m) -> gain(0.5) -> out"
    built = FrameSignal.sine(spark, config, 440).low_pass(FrameSignal.sine(spark, config, 1)).gain(0.5).limit()
    assert np.array_equal(FrameSignal.from_graph(spark, text, config).decode(), built.decode())
