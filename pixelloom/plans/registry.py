"""Registry of image operators: name, category, parameters with bounds, and the forms in which an operator runs.

`plan` is a declarative form over Rel, `kernel` a numpy form over one image of
shape (height, width, 4). Where an operator has both, images run through the
kernel and the plan is its independent statement in SQL. `halo` is how far a
kernel looks around a pixel, as a function of its parameters: with it, large
images are cut into tiles; without it a kernel sees whole images. `narrow` marks
plans that move no rows, which run on rows of pixels although there is a kernel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pixelloom.functions import evaluate
from pixelloom.plans.rel import Rel

PIXEL = ("image_id", "width", "height", "y", "x", "r", "g", "b", "a")


@dataclass(frozen=True)
class Param:
    """Default and bounds of a parameter; the default's type is the parameter's."""

    default: Any
    low: float | None = None
    high: float | None = None

    def check(self, name: str, value: Any) -> Any:
        if isinstance(self.default, bool):
            return bool(value)
        if isinstance(self.default, str) or not isinstance(self.default, int | float):
            return value
        value = type(self.default)(value)
        if self.low is not None and not self.low <= value <= self.high:
            raise ValueError(f"{name} is {value}, not within [{self.low}, {self.high}]")
        return value


@dataclass
class Operator:
    name: str
    category: str
    params: dict[str, Param]
    plan: Callable[..., Rel] | None = None
    kernel: Callable[..., Any] | None = None
    halo: Callable[..., int] | None = None
    space: str | None = None
    inputs: int = 1
    narrow: bool = False
    #: Whether the kernel may compute in 32-bit floats, the precision in which whole images are stored.
    single: bool = False
    example: dict[str, Any] = field(default_factory=dict)
    doc: str = ""
    #: Compliance with ACES colour management as declared: compliant, log, non-compliant, or unknown.
    aces: str | None = None
    #: Layout that a mapper's result is for, where it isn't that of its input.
    output: str | None = None

    def bind(self, given: dict[str, Any]) -> dict[str, Any]:
        """All parameters, checked."""
        if unknown := set(given) - set(self.params):
            raise TypeError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        return {k: p.check(k, given.get(k, p.default)) for k, p in self.params.items()}


OPERATORS: dict[str, Operator] = {}


def _params(spec: dict[str, Any]) -> dict[str, Param]:
    return {k: v if isinstance(v, Param) else Param(*v) if isinstance(v, tuple) else Param(v) for k, v in spec.items()}


def register(op: Operator) -> None:
    if op.name in OPERATORS:
        raise ValueError(f"{op.name} is registered twice")
    OPERATORS[op.name] = op


def plan(name: str, category: str, example: dict[str, Any] | None = None, space: str | None = None, inputs: int = 1, **spec: Any):
    """Registers a function (rel, ..., **params) -> rel as an operator."""

    def wrap(f):
        if name in OPERATORS:
            OPERATORS[name].plan = f
        else:
            register(Operator(name, category, _params(spec), plan=f, example=example or {}, space=space, inputs=inputs, doc=(f.__doc__ or "").strip()))
        return f

    return wrap


def point(name: str, category: str, example: dict[str, Any] | None = None, space: str | None = None, **spec: Any):
    """Registers a function (**params) -> stages of expressions, each a dict of columns, as an operator on single pixels."""

    def wrap(f):
        def run(rel: Rel, **params: Any) -> Rel:
            stages = f(**params)
            out = rel.steps(*([stages] if isinstance(stages, dict) else stages))
            return out.pick(*(c for c in out.cols if not c.startswith("_"))) if any(c.startswith("_") for c in out.cols) else out

        def on_image(img: Any, **params: Any) -> Any:
            stages = f(**params)
            return evaluate.run(img, [stages] if isinstance(stages, dict) else list(stages))

        run.__doc__ = f.__doc__
        plan(name, category, example, space, **spec)(run)
        # on whole images the same expressions run as numpy, in one pass with kernels
        OPERATORS[name].kernel, OPERATORS[name].narrow, OPERATORS[name].halo = on_image, True, None
        return run

    return wrap


def kernel(name: str, category: str, example: dict[str, Any] | None = None, halo: Callable[..., int] | None = None, single: bool = False, **spec: Any):
    """Registers a function (image, **params) -> image as an operator."""

    def wrap(f):
        if name in OPERATORS:
            raise ValueError(f"{name} is registered twice")
        register(Operator(name, category, _params(spec), kernel=f, halo=halo, single=single, example=example or {}, doc=(f.__doc__ or "").strip()))
        return f

    return wrap


def mapper(name: str, category: str, output: str, example: dict[str, Any] | None = None, **spec: Any):
    """Registers a function (image, **params) -> image whose result is meant for another layout of raw pixels."""

    def wrap(f):
        kernel(name, category, example, **spec)(f)
        OPERATORS[name].output = output
        return f

    return wrap


def composite(name: str, category: str, example: dict[str, Any] | None = None, **spec: Any):
    """Registers a function (**params) -> [(operator, parameters), ...] of operators with one input that run one after another."""

    def wrap(f):
        def steps(params: dict[str, Any]) -> list[tuple[Operator, dict[str, Any]]]:
            return [(OPERATORS[step], OPERATORS[step].bind(given)) for step, given in f(**params)]

        def on_rows(rel: Rel, **params: Any) -> Rel:
            for op, own in steps(params):
                if op.plan is None:
                    raise NotImplementedError(f"{op.name} has no plan")
                rel = op.plan(rel, **own)
            return rel

        def on_image(img: Any, **params: Any) -> Any:
            for op, own in steps(params):
                img = op.kernel(img, **own)
            return img

        register(Operator(name, category, _params(spec), plan=on_rows, kernel=on_image, example=example or {}, doc=(f.__doc__ or "").strip()))
        return f

    return wrap


#: Measures of two images, (rel, rel) -> rel with a row for each image.
METRICS: dict[str, Callable[[Rel, Rel], Rel]] = {}


def metric(name: str):
    """Registers a measure of two images."""

    def wrap(f):
        if name in METRICS:
            raise ValueError(f"{name} is registered twice")
        METRICS[name] = f
        return f

    return wrap
