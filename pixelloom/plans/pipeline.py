"""Chains of operators over images, recorded first and planned when the result is asked for.

    Pipeline(df).brightness(amount=0.1).gaussian_blur(radius=2.0).crop(x=0, y=0, w=64, h=64).pixels()

Planning joins what can run together: operators with declarative plans become one
chain of projections, joins and aggregates for Catalyst; neighbouring kernels run
in one pass over each image, or over each tile where all of them say how far they
look. Operators that work in another colour space are wrapped in conversions, and
a conversion that is followed by its inverse is dropped. A crop that follows
operators on single pixels moves before them, so what is cut away isn't computed.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import geometry, kernels, looks, points, stats, text, warps, whole
from pixelloom.plans import run, staged
from pixelloom.plans.registry import METRICS, OPERATORS, PIXEL, Operator
from pixelloom.plans.rel import SparkRel
from pixelloom.plans.staged import Bound

assert geometry and kernels and looks and points and stats and text and warps and whole  # registered on import

#: Categories whose operators change a pixel by itself and not by its place.
BY_VALUE = {"adjustment", "evaluate", "color", "grading", "alpha", "colour management"}


def _digest(value: Any) -> str:
    """A parameter of any type as text that tells it from every other."""
    if isinstance(value, np.ndarray):
        whole = np.ascontiguousarray(value)
        return f"{whole.dtype.str}{whole.shape}{hashlib.sha256(whole.tobytes()).hexdigest()}"
    if isinstance(value, np.generic):
        return f"{value.dtype.str}{value.item()!r}"
    if isinstance(value, Bound):
        return value.key()
    return f"{type(value).__qualname__}{hashlib.sha256(pickle.dumps(value)).hexdigest()}"


def _plan_of(df: DataFrame) -> str:
    """What a DataFrame computes: its canonical plan, and the hash of it that knows its leaves."""
    return f"{df._jdf.queryExecution().analyzed().canonicalized().toString()}#{df.semanticHash()}"


@dataclass(frozen=True)
class Step:
    op: Operator
    params: dict[str, Any]
    others: tuple[Any, ...] = ()

    @property
    def bound(self) -> bool:
        return any(isinstance(v, Bound) for v in self.params.values())

    def key(self) -> str:
        return f"{self.op.name}{json.dumps(self.params, sort_keys=True, default=_digest)}"


@dataclass(frozen=True)
class Pipeline:
    """A source of pixels or whole images and the steps recorded on it. Every step gives a new pipeline, so branches share what is before them."""

    source: DataFrame
    steps: tuple[Step, ...] = ()
    space: str = "linear"
    #: Whether steps that aren't safe under ACES colour management are refused.
    strict: bool = False

    def __getattr__(self, name: str) -> Callable[..., Pipeline]:
        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(name)
        return lambda *others, **params: self.then(name, *others, **params)

    def then(self, name: str, *others: Pipeline | DataFrame, **params: Any) -> Pipeline:
        """The pipeline with one more operator; further inputs come first, the pipeline is the background."""
        op = OPERATORS[name]
        if len(others) != op.inputs - 1:
            raise TypeError(f"{name} takes {op.inputs - 1} further inputs")
        return replace(self, steps=(*self.steps, Step(op, staged.check(op, params), others)))

    def proxy(self, scale: float) -> Pipeline:
        """The pipeline for a source at another scale: sizes in pixels are multiplied."""
        moved = [replace(s, params={k: _scaled(s.op, k, v, scale) for k, v in s.params.items()}) for s in self.steps]
        return replace(self, steps=tuple(moved))

    def cropped_by(self, boxes: DataFrame) -> DataFrame:
        """Pixels inside each image's own box (image_id, x, y, w, h): an analysis that decides a later step, joined without a stop at the driver."""
        return boxed(self.pixels(), boxes)

    def trace(self) -> list[tuple[str, str]]:
        """(form, operators) of each pass over the images, in order; forms are plan, tiles and images."""
        packed, out = run.is_packed(self.source), []
        for s in self.planned():
            kernel = s.op.kernel is not None and (packed or not s.op.narrow)
            form = "plan" if not kernel else "images" if packed or not s.op.halo else "tiles"
            packed = packed and kernel
            if out and out[-1][0] == form:
                out[-1] = (form, f"{out[-1][1]}, {s.op.name}")
            elif kernel and out and out[-1][0] in ("tiles", "images") and form != "plan":
                out[-1] = ("images", f"{out[-1][1]}, {s.op.name}")
            else:
                out.append((form, s.op.name))
        return out

    def audit(self) -> staged.Audit:
        """Compliance of the steps with ACES colour management."""
        return staged.Audit(tuple((s.op.name, staged.level_of(s.op)) for s in self.steps))

    def waves(self) -> list[list[int]]:
        """Steps with bound parameters in the order in which their analyses can run."""
        return staged.waves(self.steps)

    def compare(self, metric: str, other: Pipeline | DataFrame) -> DataFrame:
        """A registered measure of each image beside the other's of the same image_id."""
        return METRICS[metric](SparkRel(self.pixels()), SparkRel(other.pixels() if isinstance(other, Pipeline) else other)).df

    def explain(self) -> None:
        self.frame().explain("formatted")

    def hash(self) -> str:
        """Key of the result: of the source's plan and of all steps."""
        text = _plan_of(self.source) + self.space
        for s in self.steps:
            text = hashlib.sha256((text + s.key() + "".join(o.hash() if isinstance(o, Pipeline) else _plan_of(o) for o in s.others)).encode()).hexdigest()
        return text

    def sources(self) -> list[DataFrame]:
        """All DataFrames that the pipeline reads, in order."""
        return [self.source, *(d for s in self.steps for o in s.others for d in (o.sources() if isinstance(o, Pipeline) else [o]))]

    def planned(self) -> list[Step]:
        """Steps with colour conversions put in, inverse pairs and identities left out, and crops moved forward."""
        convert = OPERATORS["convert_color_space"]
        out: list[Step] = []
        for s in self.steps:
            wrap = s.op.space if s.op.space and s.op.space != self.space else None
            if wrap:
                out.append(Step(convert, {"source": self.space, "target": wrap}))
            out.append(s)
            if wrap:
                out.append(Step(convert, {"source": wrap, "target": self.space}))
        kept: list[Step] = []
        for s in out:
            last = kept[-1] if kept else None
            if s.op is convert and last and last.op is convert and (last.params["source"], last.params["target"]) == (s.params["target"], s.params["source"]):
                kept.pop()
            elif not _identity(s):
                kept.append(s)
        for i in range(len(kept)):
            j = i
            while kept[j].op.name == "crop" and not kept[j].bound and j and not kept[j - 1].bound and kept[j - 1].op.category in BY_VALUE and kept[j - 1].op.narrow and not _uses_statistics(kept[j - 1].op):
                kept[j - 1], kept[j] = kept[j], kept[j - 1]
                j -= 1
        return kept

    def frame(self) -> DataFrame:
        """The result as a DataFrame, of pixels, or of whole images where only kernels ran on such."""
        if self.strict and not self.audit().safe:
            raise ValueError(str(self.audit()))
        self.waves()  # raises where an analysis comes too late
        df, at = self.source, 0
        todo = self.planned()
        while at < len(todo):
            s = todo[at]
            if s.bound:
                df = df if run.is_packed(df) else run.to_images(df)
                own = next(i for i, t in enumerate(self.steps) if t is s)
                df = staged.bound_images(df, s.op, s.params, lambda n, own=own: replace(self, steps=self.steps[: own if n is None else n], strict=False).images())
                at += 1
                continue
            if not run.uses_kernel(s.op, df):
                if run.is_packed(df):
                    df = run.to_pixels(df)
                others = [o.pixels() if isinstance(o, Pipeline) else o for o in s.others]
                df = run.apply(*((others[0], s.op, s.params, df) if others else (df, s.op, s.params)))
                at += 1
                continue
            end = at
            while end < len(todo) and not todo[end].bound and run.uses_kernel(todo[end].op, df):
                end += 1
            chain = [(lambda img, f=t.op.kernel, p=t.params: f(img, **p)) for t in todo[at:end]]
            if run.is_packed(df):
                df = run.packed_images(df, chain, all(t.op.single for t in todo[at:end]))
            elif all(t.op.halo for t in todo[at:end]):
                df = run.tiles(df, chain, sum(t.op.halo(**t.params) for t in todo[at:end]))
            else:
                df = run.whole_images(df, chain)
            at = end
        return df

    def pixels(self) -> DataFrame:
        df = self.frame()
        return run.to_pixels(df) if run.is_packed(df) else df.select(*PIXEL)

    def images(self) -> DataFrame:
        df = self.frame()
        return df if run.is_packed(df) else run.to_images(df)


#: Parameters that count pixels.
PIXELS = {"radius", "length", "blur_radius", "sigma", "block_size", "size", "dot_size", "amplitude", "wavelength", "tile_w", "tile_h", "x", "y", "w", "h", "stroke_width", "shift_amount", "channel_offset", "band_height", "patch_radius", "search_radius", "diameter", "scope_size"}


def _scaled(op: Operator, name: str, value: Any, scale: float) -> Any:
    if name not in PIXELS or isinstance(value, bool) or not isinstance(value, int | float):
        return value
    p = op.params[name]
    moved = value * scale if isinstance(value, float) else max(round(value * scale), 0)
    return moved if p.low is None else type(value)(min(max(moved, p.low), p.high))


def boxed(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each image cut to its box (image_id, x, y, w, h)."""
    b = boxes.selectExpr("image_id", "x _x", "y _y", "w _w", "h _h")
    kept = pixels.join(b, "image_id").where("x >= _x AND x < _x + _w AND y >= _y AND y < _y + _h")
    size = {"width": F.least("_w", F.col("width") - F.col("_x")), "height": F.least("_h", F.col("height") - F.col("_y"))}
    return kept.withColumns({"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y"), **size}).select(*PIXEL)


def crop_boxes(images: DataFrame, ratio: float = 0.75) -> DataFrame:
    """(image_id, x, y, w, h): for each whole image the window that smart_crop takes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *kernels.crop_box(run.unpacked(d, int(w), int(h)), ratio)) for i, w, h, d in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "x", "y", "w", "h"])

    return images.select("image_id", "width", "height", "data").mapInPandas(work, "image_id long, x long, y long, w long, h long")


def _uses_statistics(op: Operator) -> bool:
    return op.plan is not None and op.plan.__module__ == stats.__name__


#: Parameters at which an operator changes nothing.
NEUTRAL = {
    "brightness": {"amount": 0.0}, "contrast": {"amount": 0.0}, "exposure": {"ev": 0.0}, "gamma": {"gamma": 1.0}, "evaluate_add": {"value": 0.0}, "evaluate_subtract": {"value": 0.0},
    "evaluate_multiply": {"value": 1.0}, "evaluate_divide": {"value": 1.0}, "saturate_hsl": {"factor": 1.0}, "hue_rotate": {"degrees": 0.0}, "gaussian_blur": {"radius": 0.0}, "box_blur": {"radius": 0},
    "rotate": {"degrees": 0}, "auto_orient": {"orientation": 1}, "sharpen": {"amount": 0.0}, "vibrance": {"amount": 0.0}, "colorize": {"amount": 0.0}, "sepia": {"intensity": 0.0},
}


def _identity(s: Step) -> bool:
    if s.bound:
        return False
    if s.op.name == "convert_color_space":
        return s.params["source"] == s.params["target"]
    neutral = NEUTRAL.get(s.op.name)
    return bool(neutral) and all(s.params[k] == v for k, v in neutral.items())


class Cache:
    """Persisted results by the hash of their pipeline; the oldest go when there are more than `most`."""

    def __init__(self, most: int = 16):
        self.most, self.held = most, {}

    def get(self, pipeline: Pipeline) -> DataFrame:
        key = pipeline.hash()
        if key in self.held and not all(a.sameSemantics(b) for a, b in zip(pipeline.sources(), self.held[key][0].sources(), strict=True)):
            self.held.pop(key)[1].unpersist()
        if key not in self.held:
            while len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))[1].unpersist()
            self.held[key] = pipeline, pipeline.frame().persist()
        self.held[key] = self.held.pop(key)
        return self.held[key][1]
