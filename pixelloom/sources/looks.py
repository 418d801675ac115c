"""Look-up tables and colour decision lists as text: .cube, .3dl, .csp, CLF, CDL, and Hald images."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass

import numpy as np


@dataclass
class Lut:
    """Colours of a lattice over [0, 1]^3 as an array [b, g, r, channel], and one-dimensional curves [i, channel] that come first."""

    grid: np.ndarray | None = None
    curve: np.ndarray | None = None

    def __call__(self, rgb: np.ndarray) -> np.ndarray:
        """Colours of pixels: linear along curves, trilinear in the lattice."""
        if self.curve is not None:
            x = np.linspace(0, 1, len(self.curve))
            rgb = np.stack([np.interp(rgb[..., c], x, self.curve[:, c]) for c in range(3)], -1)
        if self.grid is None:
            return rgb
        n = len(self.grid)
        at = np.clip(rgb * (n - 1), 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        part = at - low
        out = 0
        for corner in range(8):
            pick = [corner >> c & 1 for c in range(3)]
            r, g, b = (np.where(k, high[..., c], low[..., c]) for c, k in enumerate(pick))
            weight = np.prod([part[..., c] if k else 1 - part[..., c] for c, k in enumerate(pick)], axis=0)
            out = out + weight[..., None] * self.grid[b, g, r]
        return out

    @classmethod
    def of(cls, f, n: int = 33) -> Lut:
        """Lattice of a function on colours."""
        b, g, r = np.meshgrid(*[np.linspace(0, 1, n)] * 3, indexing="ij")
        return cls(f(np.stack([r, g, b], -1)))

    def then(self, other: Lut) -> Lut:
        """One lattice for both in a row."""
        return Lut.of(lambda v: other(self(v)), max(len(x.grid) for x in (self, other) if x.grid is not None))


def _rows(lines, n: int = 3) -> np.ndarray:
    out = []
    for line in lines:
        parts = line.split()
        if len(parts) == n and re.fullmatch(r"[-+0-9.eE]+", parts[0]):
            out.append([float(p) for p in parts])
    return np.array(out).reshape(-1, n)


def parse_cube(text: str) -> Lut:
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    head = {m[1]: m[2].split() for x in lines if (m := re.match(r"(LUT_3D_SIZE|LUT_1D_SIZE|DOMAIN_MIN|DOMAIN_MAX)\s+(.*)", x))}
    lo, hi = (np.array([float(v) for v in head.get(k, d)]) for k, d in (("DOMAIN_MIN", "000"), ("DOMAIN_MAX", "111")))
    rows = (_rows(lines) - lo) / np.maximum(hi - lo, 1e-6)
    if "LUT_3D_SIZE" in head:
        n = int(head["LUT_3D_SIZE"][0])
        if len(rows) != n**3:
            raise ValueError(f"a lattice of {n} has {n**3} entries, not {len(rows)}")
        return Lut(rows.reshape(n, n, n, 3))
    n = int(head["LUT_1D_SIZE"][0])
    if len(rows) != n:
        raise ValueError(f"{n} entries are declared, {len(rows)} are there")
    return Lut(curve=rows)


def format_cube(lut: Lut, title: str = "lut") -> str:
    n = len(lut.grid)
    return f'TITLE "{title}"\nLUT_3D_SIZE {n}\n' + "".join(" ".join(f"{v:.6f}" for v in row) + "\n" for row in lut.grid.reshape(-1, 3))


def parse_3dl(text: str) -> Lut:
    """Integer lattice with blue fastest; its range is the power of two that holds the greatest entry."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    rows = _rows(lines)
    n = round(len(rows) ** (1 / 3))
    top = 2 ** max(1, math.ceil(math.log2(max(rows.max(), 1) + 1))) - 1
    return Lut((rows / top).reshape(n, n, n, 3).transpose(2, 1, 0, 3))


def format_3dl(lut: Lut, bits: int = 12) -> str:
    n, top = len(lut.grid), (1 << bits) - 1
    mesh = " ".join(str(round(i * 1023 / (n - 1))) for i in range(n))
    levels = np.clip(np.floor(lut.grid.transpose(2, 1, 0, 3) * top + 0.5), 0, top).astype(int)
    return mesh + "\n" + "".join(" ".join(map(str, row)) + "\n" for row in levels.reshape(-1, 3))


def parse_csp(text: str) -> Lut:
    """Pre-curves of the header are read as pairs of inputs and outputs; the lattice has red fastest."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    at = 2
    if "BEGIN METADATA" in lines:
        at = lines.index("END METADATA") + 1
    curves = []
    for _ in range(3):
        n = int(lines[at])
        curves.append(([float(v) for v in lines[at + 1].split()], [float(v) for v in lines[at + 2].split()]))
        assert len(curves[-1][0]) == n
        at += 3
    size = [int(v) for v in lines[at].split()]
    if lines[1].strip() == "1D":
        return Lut(curve=_rows(lines[at + 1 :]))
    x = np.linspace(0, 1, 1025)
    curve = np.stack([np.interp(x, *c) for c in curves], -1)
    grid = _rows(lines[at + 1 :]).reshape(size[2], size[1], size[0], 3)
    return Lut(grid, None if np.allclose(curve, x[:, None]) else curve)


def format_csp(lut: Lut) -> str:
    n = len(lut.grid)
    return "CSPLUTV100\n3D\n\n" + "2\n0.0 1.0\n0.0 1.0\n" * 3 + f"\n{n} {n} {n}\n" + "".join(" ".join(f"{v:.6f}" for v in row) + "\n" for row in lut.grid.reshape(-1, 3))


def parse_hald(img: np.ndarray) -> Lut:
    """Lattice of a square image whose side is the cube of its level."""
    level = round(img.shape[0] ** (1 / 3))
    if level**3 != img.shape[0] or img.shape[0] != img.shape[1]:
        raise ValueError("a Hald image is a square with a cube as its side")
    n = level * level
    return Lut(img[..., :3].reshape(n, n, n, 3))


def format_hald(lut: Lut, level: int) -> np.ndarray:
    grid = Lut.of(lut, level * level).grid
    flat = grid.reshape(level**3, level**3, 3)
    return np.concatenate([flat, np.ones((*flat.shape[:2], 1))], -1)


@dataclass
class Cdl:
    slope: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    power: tuple[float, float, float] = (1.0, 1.0, 1.0)
    saturation: float = 1.0

    def params(self) -> dict[str, float]:
        """Parameters of the operator asc_cdl."""
        return {f"{k}_{c}": v for k in ("slope", "offset", "power") for c, v in zip("rgb", getattr(self, k), strict=True)} | {"saturation": self.saturation}


def _tag(node) -> str:
    return node.tag.rpartition("}")[2]


def parse_cdl(text: str) -> list[Cdl]:
    """Every correction of an ASC CDL document, in order."""
    out = []
    for node in ElementTree.fromstring(text).iter():
        if _tag(node) == "SOPNode":
            out.append(Cdl(**{_tag(x).lower(): tuple(float(v) for v in x.text.split()) for x in node if _tag(x) in ("Slope", "Offset", "Power")}))
        elif _tag(node) == "SatNode":
            value = float(next(x for x in node if _tag(x) == "Saturation").text)
            if not out:
                out.append(Cdl())
            out[-1].saturation = value
    return out


def format_cdl(cdl: Cdl) -> str:
    three = lambda v: " ".join(f"{x:g}" for x in v)
    return f'<ColorDecisionList xmlns="urn:ASC:CDL:v1.01"><ColorDecision><ColorCorrection><SOPNode><Slope>{three(cdl.slope)}</Slope><Offset>{three(cdl.offset)}</Offset><Power>{three(cdl.power)}</Power></SOPNode><SatNode><Saturation>{cdl.saturation:g}</Saturation></SatNode></ColorCorrection></ColorDecision></ColorDecisionList>'


def parse_clf(text: str):
    """Function on colours of a process list: Matrix, Range, LUT1D, LUT3D, ASC_CDL, and gamma Exponent nodes."""
    steps = []
    for node in ElementTree.fromstring(text):
        kind = _tag(node)
        array = next((x for x in node if _tag(x) == "Array"), None)
        if array is not None:
            dims, values = [int(v) for v in array.get("dim").split()], np.array([float(v) for v in array.text.split()])
        if kind == "Matrix":
            m = values.reshape(dims[0], dims[1])
            steps.append(lambda v, m=m: v @ m[:, :3].T + (m[:, 3] if m.shape[1] > 3 else 0))
        elif kind == "LUT1D":
            curve = values.reshape(dims[0], dims[1])
            steps.append(Lut(curve=np.repeat(curve, 3, 1) if dims[1] == 1 else curve))
        elif kind == "LUT3D":
            n = dims[0]
            steps.append(Lut(values.reshape(n, n, n, 3).transpose(2, 1, 0, 3)))
        elif kind == "Range":
            given = {_tag(x): float(x.text) for x in node}
            lo, hi, a, b = (given.get(k, d) for k, d in (("minInValue", 0.0), ("maxInValue", 1.0), ("minOutValue", 0.0), ("maxOutValue", 1.0)))
            clamp = node.get("style", "Clamp") != "noClamp"
            steps.append(lambda v, lo=lo, hi=hi, a=a, b=b, clamp=clamp: np.clip((v - lo) * (b - a) / (hi - lo) + a, a, b) if clamp else (v - lo) * (b - a) / (hi - lo) + a)
        elif kind == "ASC_CDL":
            body = ElementTree.tostring(node, "unicode")
            cdl = parse_cdl(f"<x>{body}</x>")[0]
            steps.append(lambda v, c=cdl: _graded(v, c))
        elif kind == "Exponent":
            power = [float(x.get("exponent", 1)) for x in node if _tag(x) == "ExponentParams"]
            power = np.array(power * 3 if len(power) == 1 else power)
            sign = -1 if "Rev" in node.get("style", "") else 1
            steps.append(lambda v, p=power**sign: np.maximum(v, 0) ** p)

    def run(rgb: np.ndarray) -> np.ndarray:
        for f in steps:
            rgb = f(rgb)
        return rgb

    return run


def _graded(v: np.ndarray, c: Cdl) -> np.ndarray:
    v = np.maximum(v * np.array(c.slope) + np.array(c.offset), 0) ** np.array(c.power)
    luma = (v @ np.array([0.2126, 0.7152, 0.0722]))[..., None]
    return luma + (v - luma) * c.saturation
