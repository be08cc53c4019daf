"""Session settings of how finely circles are drawn: a least angle, a least edge, or a fixed number of segments."""

from __future__ import annotations

import math

#: Degrees, length, and no fixed number.
DEFAULTS = {"angle": 10.0, "edge": 1.0, "segments": 0}
_now = dict(DEFAULTS)


def set_min_circular_angle(degrees: float) -> None:
    """Not above 0: ignored."""
    if degrees > 0:
        _now["angle"] = float(degrees)


def set_min_circular_edge_length(size: float) -> None:
    if size > 0:
        _now["edge"] = float(size)


def set_circular_segments(n: int) -> None:
    """Below 3 (but for 0, which lifts it): ignored."""
    if n == 0 or n >= 3:
        _now["segments"] = int(n)


def reset_to_defaults() -> None:
    _now.update(DEFAULTS)


def settings() -> dict:
    return dict(_now)


def circular_segments(radius: float) -> int:
    """The fixed number if set, else the fewer of what angle and edge ask for, in fours, 4 at least."""
    if _now["segments"] > 0:
        return _now["segments"]
    n = int(min(360.0 / _now["angle"], 2 * math.pi * radius / _now["edge"])) + 3
    return max(n - n % 4, 4)
