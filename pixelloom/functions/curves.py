"""Smooth monotone curves through points, as SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pixelloom.functions.sql import n

Points = Sequence[tuple[float, float]]


def slopes(points: Points) -> list[float]:
    """Tangents of a monotone cubic through the points (Fritsch and Carlson)."""
    rise = [(b[1] - a[1]) / max(b[0] - a[0], 1e-6) for a, b in zip(points, points[1:], strict=False)]
    out = [rise[0], *((a + b) / 2 for a, b in zip(rise, rise[1:], strict=False)), rise[-1]]
    for i, d in enumerate(rise):
        if abs(d) < 1e-6:
            out[i] = out[i + 1] = 0.0
            continue
        a, b = out[i] / d, out[i + 1] / d
        if (size := a * a + b * b) > 9:
            out[i], out[i + 1] = (3 / math.sqrt(size) * x * d for x in (a, b))
    return out


def hermite(points: Points, x: str) -> str:
    """Value of the curve at expression x."""
    tangent = slopes(points)
    parts = [f"WHEN {x} <= {n(points[0][0])} THEN {n(points[0][1])}"]
    for i, ((x0, y0), (x1, y1)) in enumerate(zip(points, points[1:], strict=False)):
        h = x1 - x0
        # the cubic in t = (x - x0) / h, by Horner's rule
        c2 = 3 * (y1 - y0) - h * (2 * tangent[i] + tangent[i + 1])
        c3 = 2 * (y0 - y1) + h * (tangent[i] + tangent[i + 1])
        t = f"(({x} - {n(x0)}) / {n(h)})"
        parts.append(f"WHEN {x} < {n(x1)} THEN {n(y0)} + {t} * ({n(h * tangent[i])} + {t} * ({n(c2)} + {t} * {n(c3)}))")
    return f"CASE {' '.join(parts)} ELSE {n(points[-1][1])} END"


def tone_points(shadows: float, midtones: float, highlights: float) -> Points:
    clip = lambda v: min(max(v, 0.0), 1.0)
    return [(0.0, 0.0), (0.25, clip(0.25 + shadows * 0.15)), (0.5, clip(0.5 + midtones * 0.2)), (0.75, clip(0.75 + highlights * 0.15)), (1.0, 1.0)]


def hue_points(center: float, amount: float, width: float) -> Points:
    out = []
    for i in range(13):
        d = abs(i / 12 - center / 360)
        d = min(d, 1 - d)
        out.append((i / 12, min(max(1 + amount * math.exp(-d * d / (2 * max(width / 360, 0.01) ** 2)), 0.0), 2.0)))
    return out
