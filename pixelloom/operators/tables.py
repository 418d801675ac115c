"""Operators made into tables: of levels for those on single channels, lattices for those on colours, and what is composed of them."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.registry import OPERATORS
from pixelloom.sources.looks import Lut


def level_table(name: str, bits: int = 8, **params: Any) -> np.ndarray:
    """What a point operator makes of each gray level of 8 or 16 bits, clipped and rounded."""
    op, top = OPERATORS[name], (1 << bits) - 1
    ramp = np.ones((1, top + 1, 4))
    ramp[0, :, :3] = (np.arange(top + 1) / top)[:, None]
    return np.floor(np.clip(op.kernel(ramp, **op.bind(params))[0, :, 0] * top + 0.5, 0, top)).astype(np.uint8 if bits == 8 else np.uint16)


def composed(*tables: np.ndarray) -> np.ndarray:
    """One table for several of the same depth, one after another."""
    out = tables[0]
    for t in tables[1:]:
        if t.shape != out.shape:
            raise ValueError("tables of different depths")
        out = t[out]
    return out


def with_levels(pixels: DataFrame, table: np.ndarray) -> DataFrame:
    """Pixels with their colours rounded to levels and looked up; a table has 256 or 65,536 rows, which are broadcast."""
    top = len(table) - 1
    spark = pixels.sparkSession
    rows = spark.createDataFrame([(list(map(float, table / top)),)], "_table array<double>")
    level = lambda c: F.floor(F.least(F.greatest(F.col(c) * top, F.lit(0.0)), F.lit(float(top))) + 0.5).cast("int") + 1
    # one row
    return pixels.join(F.broadcast(rows)).withColumns({c: F.element_at("_table", level(c)) for c in "rgb"}).drop("_table")


def lattice(name: str, n: int = 33, **params: Any) -> Lut:
    """The lattice of a colour operator."""
    op = OPERATORS[name]
    bound = op.bind(params)

    def f(v: np.ndarray) -> np.ndarray:
        flat = np.concatenate([v, np.ones((*v.shape[:-1], 1))], -1).reshape(1, -1, 4)
        return np.clip(op.kernel(flat, **bound)[0, :, :3], 0, 1).reshape(v.shape)

    return Lut.of(f, n)


def _levels(v: np.ndarray) -> np.ndarray:
    return np.clip(v * 255 + 0.5, 0, 255).astype(np.uint8)


def absorbed_before(table: np.ndarray, lut: Lut) -> Lut:
    """A lattice that looks its input up in a table of 8-bit levels first."""
    return Lut.of(lambda v: lut(table[_levels(v)] / 255), len(lut.grid))


def absorbed_after(lut: Lut, table: np.ndarray) -> Lut:
    """A lattice whose entries are looked up in a table of 8-bit levels."""
    return Lut(table[_levels(lut.grid)] / 255, lut.curve)
