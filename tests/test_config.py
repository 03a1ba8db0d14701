import pytest

from framewright import InvalidConfig, RenderConfig


def test_defaults():
    c = RenderConfig()
    assert (c.sample_rate_hz, c.frame_count, c.batch_frame_capacity, c.max_render_seconds) == (48_000, 48_000, 1_024, 60)


@pytest.mark.parametrize("name", ["sample_rate_hz", "frame_count", "batch_frame_capacity", "max_render_seconds"])
def test_zero_is_rejected(name):
    with pytest.raises(InvalidConfig, match=f"{name} must be greater than 0"):
        RenderConfig(**{name: 0})


def test_longest_render():
    assert RenderConfig(frame_count=2_880_000).frame_count == 2_880_000
    with pytest.raises(InvalidConfig, match="frame_count 2880001 exceeds configured maximum 2880000"):
        RenderConfig(frame_count=2_880_001)
    with pytest.raises(InvalidConfig, match="overflows"):
        RenderConfig(max_render_seconds=2**60)
