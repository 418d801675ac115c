"""Parameters that an analysis of the images decides, and the audit of colour management.

A step may take a Bound in place of a number: an analysis, a function of whole images
that gives rows (image_id, field, ...), and the field that becomes the parameter of
each image. The rows are joined to the images, so nothing stops at the driver, and
each image has its own parameters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans import run
from pixelloom.plans.registry import Operator

#: Fields of analyses, by what they find.
FIELDS = {"scalar": ("value",), "rect": ("x", "y", "width", "height"), "matrix": ("a", "b", "tx", "c", "d", "ty")}


@dataclass(frozen=True)
class Bound:
    """A field of an analysis of the images as they are after a number of steps (None: just before the step that takes it)."""

    analysis: Callable[[DataFrame], DataFrame]
    field: str = "value"
    after: int | None = None

    def __post_init__(self):
        if not any(self.field in names for names in FIELDS.values()):
            raise ValueError(f"analyses have no field {self.field}")

    def key(self) -> str:
        return f"{self.analysis.__module__}.{self.analysis.__qualname__}.{self.field}.{self.after}"


def check(op: Operator, given: dict[str, Any]) -> dict[str, Any]:
    """All parameters of a step, bound ones as they are. A bound parameter must be a number, and its operator have a kernel."""
    bound = {k: v for k, v in given.items() if isinstance(v, Bound)}
    params = op.bind({k: v for k, v in given.items() if k not in bound})
    for k in bound:
        if k not in op.params:
            raise TypeError(f"{op.name} has no parameter {k}")
        if isinstance(op.params[k].default, bool) or not isinstance(op.params[k].default, int | float):
            raise TypeError(f"{k} of {op.name} isn't a number")
    if bound and op.kernel is None:
        raise TypeError(f"parameters of {op.name} can't be bound")
    return params | bound


def waves(steps) -> list[list[int]]:
    """Indexes of the steps with bound parameters, in groups whose analyses need only what earlier groups have bound."""
    found: dict[int, int] = {}
    for i, s in enumerate(steps):
        ends = [i if b.after is None else b.after for b in s.params.values() if isinstance(b, Bound)]
        if any(e > i for e in ends):
            raise ValueError(f"{s.op.name} is bound to an analysis of what comes after it")
        if ends:
            found[i] = 1 + max((w for j, w in found.items() if j < max(ends)), default=-1)
    return [[i for i, w in found.items() if w == k] for k in range(max(found.values(), default=-1) + 1)]


def bound_images(images: DataFrame, op: Operator, params: dict[str, Any], analysed: Callable[[int | None], DataFrame]) -> DataFrame:
    """An operator on rows of whole images, with each image's own parameters. Images for which the analysis has no row, or a null, stay as they are."""
    bound = {k: v for k, v in params.items() if isinstance(v, Bound)}
    names = images.columns
    joined = images
    for b in dict.fromkeys((b.analysis, b.after) for b in bound.values()):
        wanted = {k: v.field for k, v in bound.items() if (v.analysis, v.after) == b}
        rows = b[0](analysed(b[1])).select("image_id", *(F.col(f).cast("double").alias(f"_bound_{k}") for k, f in wanted.items()))
        joined = joined.join(rows, "image_id", "left")
    at = {c: names.index(c) for c in ("width", "height", "data")}
    fixed, own_names = {k: v for k, v in params.items() if k not in bound}, tuple(bound)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                own = {p: row.column(len(names) + i)[0].as_py() for i, p in enumerate(own_names)}
                columns = row.columns[: len(names)]
                data = columns[at["data"]][0]
                if data.is_valid and None not in own.values():
                    w, h = (columns[at[c]][0].as_py() for c in ("width", "height"))
                    own = {p: op.params[p].check(p, round(v) if isinstance(op.params[p].default, int) else v) for p, v in own.items()}
                    out = op.kernel(run.unpacked(data.as_buffer(), w, h), **fixed, **own)
                    for c, v in (("width", out.shape[1]), ("height", out.shape[0]), ("data", run.packed(out))):
                        columns[at[c]] = pa.array([v], batch.schema.field(at[c]).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*names, *(f"_bound_{k}" for k in bound)).mapInArrow(work, images.schema)


# colour management

#: Levels of compliance; the first two are safe in an ACES pipeline.
LEVELS = ("compliant", "log", "non-compliant", "unknown")


@dataclass(frozen=True)
class Audit:
    """Steps of a pipeline by their level of compliance."""

    steps: tuple[tuple[str, str], ...]

    def count(self, level: str) -> int:
        return sum(x == level for _, x in self.steps)

    @property
    def violations(self) -> list[tuple[int, str, str]]:
        """(index, operator, reason) of the steps that aren't safe."""
        reasons = {"non-compliant": "the operator is declared not to be compliant", "unknown": "nothing is declared about the operator"}
        return [(i, name, reasons[level]) for i, (name, level) in enumerate(self.steps) if level in reasons]

    @property
    def safe(self) -> bool:
        return not self.violations

    def __str__(self) -> str:
        head = f"{self.count('compliant') + self.count('log')} of {len(self.steps)} steps are safe"
        return "\n".join([head, *(f"  step {i}, {name}: {reason}" for i, name, reason in self.violations)])


def level_of(op: Operator) -> str:
    """What is declared about an operator; those that work in an ACES log space, and conversions between spaces, are safe by that."""
    by_kind = "log" if op.space in ("acescct", "acescc") else "compliant" if op.category == "colour management" else "unknown"
    return op.aces or by_kind
