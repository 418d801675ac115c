"""Brush strokes: smoothing, resampling by arc length, dabs, and laying them on a layer.

Points are rows (stroke_id, ts, x, y, pressure, tilt_x, tilt_y, rotation,
velocity). A stroke is an ordered sequence, so it is one group; its dabs meet the
pixels in a range join that is dealt out by cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["x", "y", "pressure", "tilt_x", "tilt_y", "rotation", "velocity", "ts"]
DABS = "stroke_id long, dab long, x double, y double, size double, opacity double, angle double, roundness double, hardness double"
#: Side of the cells by which dabs and pixels are dealt to tasks.
CELL = 64
#: Dabs (by the cells that they touch) of a stamp for all images at the most.
STAMP = 200_000


@dataclass(frozen=True)
class Brush:
    diameter: float = 20.0
    spacing: float = 0.15
    hardness: float = 0.8
    flow: float = 1.0
    opacity: float = 1.0
    angle: float = 0.0
    roundness: float = 1.0
    scatter: float = 0.0
    smoothing: float = 0.5
    #: curves by name: pressure_size, pressure_opacity, velocity_size, tilt_angle; points of piecewise lines
    dynamics: dict[str, tuple[tuple[float, float], ...]] = field(default_factory=dict)

    def curve(self, name: str, v: np.ndarray, rest: float = 1.0) -> np.ndarray:
        points = self.dynamics.get(name)
        return np.interp(v, *zip(*points, strict=True)) if points else np.full_like(v, rest)


# The curves and presets that brushes are known by.
RISING = ((0.0, 0.0), (1.0, 1.0))
QUICK, SLOW = ((0.0, 0.0), (0.3, 0.6), (0.6, 0.85), (1.0, 1.0)), ((0.0, 0.0), (0.4, 0.15), (0.7, 0.4), (1.0, 1.0))
PRESETS = {
    "pencil": Brush(diameter=8, spacing=0.10, hardness=0.95, flow=0.9, smoothing=0.3, dynamics={"pressure_size": QUICK}),
    "pen": Brush(diameter=12, spacing=0.05, hardness=1.0, smoothing=0.5, dynamics={"pressure_opacity": RISING}),
    "airbrush": Brush(diameter=60, spacing=0.10, hardness=0.0, flow=0.3, smoothing=0.4, dynamics={"pressure_opacity": SLOW}),
    "watercolor": Brush(diameter=40, spacing=0.15, hardness=0.3, flow=0.5, opacity=0.7, smoothing=0.6, dynamics={"pressure_size": RISING, "pressure_opacity": SLOW}),
    "chalk": Brush(diameter=30, spacing=0.20, hardness=0.7, flow=0.8, roundness=0.7, scatter=0.1, smoothing=0.2, dynamics={"pressure_size": RISING}),
}


def smoothed(points: np.ndarray, strength: float, parts: int) -> np.ndarray:
    """Catmull-Rom curve through the points, mixed with the straight line by strength. Columns are FIELDS."""
    n = len(points)
    if n < 2 or strength < 1e-6 or parts <= 1:
        return points
    before, after = np.maximum(np.arange(n - 1) - 1, 0), np.minimum(np.arange(n - 1) + 2, n - 1)
    a, b, c, d = (points[k][:, None] for k in (before, np.arange(n - 1), np.arange(1, n), after))
    t = (np.arange(parts) / parts)[None, :, None]
    curve = b + 0.5 * t * ((c - a) + t * ((2 * a - 5 * b + 4 * c - d) + t * (3 * (b - c) + d - a)))
    curve[..., 2] = np.clip(curve[..., 2], 0, 1)
    curve[..., 6] = np.maximum(curve[..., 6], 0)
    line = b + t * (c - b)
    return np.concatenate([(line + strength * (curve - line)).reshape(-1, points.shape[1]), points[-1:]])


def spaced(path: np.ndarray, step: float) -> np.ndarray:
    """Points along the path: the first, then one for each step of a segment; what a segment leaves over is passed over once more at the start of the next."""
    if not len(path) or step <= 0:
        return path[:0]
    out, rest = [path[0]], 0.0
    for a, b in zip(path, path[1:], strict=False):
        length = math.hypot(*(b[:2] - a[:2]))
        if length < 1e-6:
            continue
        n = max(int(math.floor((length - rest) / step + 1e-12)), 0)
        out += [a + (rest + step * (k + 1)) / length * (b - a) for k in range(n)]
        rest = length - (rest + n * step)
    return np.array(out)


def _scatter(seeds: np.ndarray) -> np.ndarray:
    """Hash of seeds in [0, 1). Its multipliers and shifts, which decide where dabs scatter."""
    h = (seeds * 0x9E3779B9) & 0xFFFFFFFF
    h ^= h >> 16
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    return (h & 0xFFFFFF) / (1 << 24)


def dabs_of(points: np.ndarray, brush: Brush) -> pd.DataFrame:
    path = spaced(smoothed(points, brush.smoothing, 4), max(brush.spacing * brush.diameter, 0.5))
    x, y, pressure, tilt_x, tilt_y, _, speed, _ = path.T if len(path) else np.zeros((8, 0))
    k = np.arange(len(x), dtype=np.int64)
    turn, far = _scatter(k) * 2 * np.pi, brush.scatter * brush.diameter * _scatter(k + 1)
    size = brush.diameter * brush.curve("pressure_size", pressure) * brush.curve("velocity_size", np.clip(speed, 0, 1))
    return pd.DataFrame({
        "dab": k, "x": x + np.cos(turn) * far, "y": y + np.sin(turn) * far, "size": size, "opacity": brush.flow * brush.curve("pressure_opacity", pressure),
        "angle": brush.angle + np.pi * brush.curve("tilt_angle", np.clip(np.hypot(tilt_x, tilt_y), 0, 1), 0.0), "roundness": brush.roundness, "hardness": brush.hardness,
    })


def dabs(strokes: DataFrame, brush: Brush) -> DataFrame:
    """Dabs of every stroke, in order of time. Strokes may have an image_id, which their dabs then have too."""
    keys = [c for c in ("image_id", "stroke_id") if c in strokes.columns]
    names = [c.split()[0] for c in DABS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values("ts", kind="stable")[FIELDS].to_numpy(float)
        return dabs_of(points, brush).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys[:-1], *names]]

    return strokes.groupBy(*keys).applyInPandas(run, ("image_id long, " if len(keys) > 1 else "") + DABS)


def paint(layer: DataFrame, strokes: DataFrame, brush: Brush, color: tuple[float, float, float]) -> DataFrame:
    """The layer's pixels with the strokes on it. Of the dabs over a pixel the most opaque counts, the first on ties.

    Strokes with an image_id are painted on that image. Strokes without one are a stamp for every image of the layer; a
    stamp is broadcast and may have `STAMP` dabs at the most.
    """
    keys = ["image_id"] if "image_id" in strokes.columns else []
    d = dabs(strokes, brush).withColumn("n", F.greatest(F.round("size"), F.lit(1.0)))
    d = d.withColumns({"x0": F.floor(F.col("x") - F.col("n") / 2), "y0": F.floor(F.col("y") - F.col("n") / 2)})
    cell = lambda c, last=0: F.floor((F.col(c) + last) / CELL)
    d = d.withColumn("cy", F.explode(F.sequence(cell("y0"), F.floor((F.col("y0") + F.col("n") - 1) / CELL))))
    d = d.withColumn("cx", F.explode(F.sequence(cell("x0"), F.floor((F.col("x0") + F.col("n") - 1) / CELL))))
    d = d.select(*keys, "stroke_id", "dab", *(F.col(c).alias(f"d_{c}") for c in ("n", "x0", "y0", "opacity", "angle", "roundness", "hardness")), "cy", "cx")
    pixels = layer.withColumns({"cy": F.floor(F.col("y") / CELL), "cx": F.floor(F.col("x") / CELL)})
    if not keys:
        d = d.persist()
        if d.count() > STAMP:
            raise ValueError(f"a stamp for all images has at most {STAMP} dabs; give the strokes an image_id")
        d = F.broadcast(d)
    met = pixels.select("image_id", "y", "x", "cy", "cx").join(d, [*keys, "cy", "cx"]).where("x >= d_x0 AND x < d_x0 + d_n AND y >= d_y0 AND y < d_y0 + d_n")
    u, v = F.col("x") - F.col("d_x0") + 0.5 - F.col("d_n") / 2, F.col("y") - F.col("d_y0") + 0.5 - F.col("d_n") / 2
    along = u * F.cos("d_angle") + v * F.sin("d_angle")
    across = (v * F.cos("d_angle") - u * F.sin("d_angle")) * F.when(F.col("d_roundness") > 1e-6, 1 / F.greatest(F.col("d_roundness"), F.lit(1e-6))).otherwise(100.0)
    far = F.sqrt(along * along + across * across) / (F.col("d_n") / 2)
    edge = (far - F.col("d_hardness")) / F.greatest(1 - F.col("d_hardness"), F.lit(1e-9))
    ink = F.when(far >= 1, 0.0).when((F.col("d_hardness") >= 1) | (far <= F.col("d_hardness")), 1.0).otherwise(F.greatest(1 - edge * edge, F.lit(0.0)))
    covered = met.select("image_id", "y", "x", (ink * F.col("d_opacity")).alias("ink")).where("ink >= 1e-6").groupBy("image_id", "y", "x").agg(F.max("ink").alias("ink"))
    both = layer.join(covered, ["image_id", "y", "x"], "left").withColumn("_s", F.coalesce("ink", F.lit(0.0)) * brush.opacity)
    mixed = {c: F.col("_s") * k + F.col(c) * (1 - F.col("_s")) for c, k in zip("rgb", color, strict=True)}
    return both.withColumns(mixed | {"a": F.col("_s") + F.col("a") * (1 - F.col("_s"))}).select(*layer.columns)


def preset(name: str, **changes: float) -> Brush:
    return replace(PRESETS[name], **changes)
