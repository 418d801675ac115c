"""Look-up tables, rendering transforms and further colour spaces."""

from __future__ import annotations

import numpy as np

from pixelloom.functions import matrices as mx
from pixelloom.functions.sql import clamp, each, linear, n, smoothstep
from pixelloom.operators.kernels import painted
from pixelloom.operators.points import _LAB_F, to_lab, transfer
from pixelloom.plans.registry import OPERATORS, Param, kernel, point
from pixelloom.plans.rel import Rel
from pixelloom.sources.looks import Lut

#: A warm look with crossed channels, as an example.
EXAMPLE = Lut.of(lambda v: np.stack([v[..., 0] ** 0.8, 0.9 * v[..., 1] + 0.1 * v[..., 2], v[..., 2] * (1 - 0.3 * v[..., 0])], -1), 5)


def _looked_up(img, clut):
    return painted(img, clut(img[..., :3])) if clut is not None else img


for _name in ("apply_cube_lut", "apply_hald_lut"):
    kernel(_name, "grading", {"clut": EXAMPLE}, halo=lambda clut: 0, clut=Param(None))(_looked_up)


def lattice_plan(rel: Rel, clut: Lut | None) -> Rel:
    """The lattice as a table, joined once for each corner of a pixel's cell."""
    if clut is None or clut.grid is None:
        return rel
    size = len(clut.grid)
    cells = [(b, g, r, *map(float, clut.grid[b, g, r])) for b in range(size) for g in range(size) for r in range(size)]
    out = rel.let(**{f"_t{c}": f"least(greatest({c} * {n(size - 1)}, 0e0), {n(size - 1)})" for c in "rgb"})
    out = out.let(**{f"_l{c}": f"cast(floor(_t{c}) as bigint)" for c in "rgb"}).let(**{f"_h{c}": f"least(_l{c} + 1, {size - 1})" for c in "rgb"}, **{f"_d{c}": f"_t{c} - _l{c}" for c in "rgb"})
    total = dict.fromkeys("rgb", "0e0")
    for corner in range(8):
        keys = [f"_{'h' if corner >> k & 1 else 'l'}{c}" for k, c in enumerate("rgb")]
        table = rel.values([keys[2], keys[1], keys[0], *(f"_v{corner}{c}" for c in "rgb")], cells)
        out = out.join(table, keys)
        weight = " * ".join(f"_d{c}" if corner >> k & 1 else f"(1e0 - _d{c})" for k, c in enumerate("rgb"))
        total = {c: f"{e} + {weight} * _v{corner}{c}" for c, e in total.items()}
    out = out.let(**total)
    return out.pick(*(c for c in out.cols if not c.startswith("_")))


OPERATORS["apply_cube_lut"].plan = OPERATORS["apply_hald_lut"].plan = lattice_plan

# reference rendering: glow, reds, saturation, tone curve, then a display

# Weights of luma and matrices from the rendering space to displays.
AP1_LUMA = (0.27222872, 0.67408177, 0.05368952)
TO_DISPLAY = {
    "srgb": np.array([[1.70505100, -0.62179212, -0.08325888], [-0.13025700, 1.14080290, -0.01054589], [-0.02400328, -0.12896886, 1.15297214]]),
    "p3": np.array([[1.37792090, -0.30886400, -0.06905690], [-0.06933190, 1.08229380, -0.01296190], [-0.00215832, -0.04578580, 1.04794420]]),
}


def _ap1() -> dict[str, str]:
    return {"_y": linear([AP1_LUMA], "rgb")[0]}


def _faded(k: float) -> list[dict[str, str]]:
    return [_ap1(), each(f"_y * {n(1 - k)} + {{v}} * {n(k)}")]


def rendering() -> list[dict[str, str]]:
    """ACEScg to scene-referred output before a display. The constants of the glow, of the red modifier and of the tone curve."""
    return [
        each("greatest({v}, 0e0)"),
        _ap1(),
        {"_g": "CASE WHEN _y <= 0e0 THEN 0.05e0 WHEN _y < 0.36e0 THEN 0.05e0 * (1e0 - _y / 0.36e0 * _y / 0.36e0) ELSE 0e0 END"},
        each("{v} * (1e0 + _g)"),
        _ap1(),
        {"_q": f"CASE WHEN _y > 1e-3 AND r > _y THEN {smoothstep('1e0', '3e0', 'r / greatest(_y, 1e-3)')} * least(_y * 2e0, 1e0) * 0.2e0 ELSE 0e0 END"},
        {"r": "r * (1e0 - _q) + _y * _q"},
        *_faded(0.96),
        each("greatest({v} * (2.51e0 * {v} + 0.03e0) / ({v} * (2.43e0 * {v} + 0.59e0) + 0.14e0), 0e0)"),
    ]


@point("aces_output", "colour management", {"display": "srgb"}, display="srgb")
def _(display):
    """ACEScg rendered for srgb, rec709 (gamma 2.4) or p3 (gamma 2.6)."""
    last = {"srgb": each(transfer("linear_to_srgb")), "rec709": each(f"pow({{v}}, {n(1 / 2.4)})"), "p3": each(f"pow({{v}}, {n(1 / 2.6)})")}[display]
    matrix = TO_DISPLAY["p3" if display == "p3" else "srgb"]
    return [*rendering(), *_faded(0.93), dict(zip("rgb", linear(matrix, "rgb"), strict=True)), each(clamp("{v}")), last]


# further spaces: the channels hold the space's components

# Primaries of wide spaces, to and from CIE XYZ (ProPhoto at D50).
FROM_XYZ = {
    "prophoto": np.array([[1.3459433, -0.2556075, -0.0511118], [-0.5445989, 1.5081673, 0.0205351], [0.0, 0.0, 1.2118128]]),
    "adobe_rgb": np.array([[2.0413690, -0.5649464, -0.3446944], [-0.9692660, 1.8760108, 0.0415560], [0.0134474, -0.1183897, 1.0154096]]),
}
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])
WHITE = {"d50": (0.96422, 1.0, 0.82521), "d65": (0.95047, 1.0, 1.08883), "a": (1.09850, 1.0, 0.35585)}


def bradford(source: str, target: str) -> np.ndarray:
    """Adaptation of XYZ between illuminants."""
    gain = (BRADFORD @ WHITE[target]) / (BRADFORD @ WHITE[source])
    return np.linalg.inv(BRADFORD) @ np.diag(gain) @ BRADFORD


def _wide(space: str) -> np.ndarray:
    adapt = bradford("d65", "d50") if space == "prophoto" else np.eye(3)
    return FROM_XYZ[space] @ adapt @ mx.SRGB_TO_XYZ_SHORT


GAMMA = {"prophoto": 1.8, "adobe_rgb": 2.19921875}


@point("encode_space", "colour spaces", {"to": "lab"}, to="lab")
def _(to):
    """Linear sRGB to lab, lch, luv, oklab, prophoto, adobe_rgb, xyz or cmyk (in r, g, b, a)."""
    space = to
    if space in GAMMA:
        return [dict(zip("rgb", linear(_wide(space), "rgb"), strict=True)), each(f"pow(greatest({{v}}, 0e0), {n(1 / GAMMA[space])})")]
    if space == "xyz":
        return dict(zip("rgb", linear(mx.SRGB_TO_XYZ_SHORT, "rgb"), strict=True))
    if space in ("lab", "lch"):
        polar = {"g": "sqrt(_aa * _aa + _bb * _bb)", "b": f"atan2(_bb, _aa) * {n(180 / np.pi)}"} if space == "lch" else {"g": "_aa", "b": "_bb"}
        return [*to_lab(), {"r": "_ll", **polar}]
    if space == "oklab":
        return [
            dict(zip(("_lc", "_mc", "_sc"), (f"cbrt(greatest({e}, 0e0))" for e in linear(mx.OKLAB_TO_CONES, "rgb")), strict=True)),
            dict(zip("rgb", linear(mx.OKLAB_FROM_CONES, ("_lc", "_mc", "_sc")), strict=True)),
        ]
    if space == "luv":
        xw, yw, zw = mx.D65_WHITE
        uw, vw = 4 * xw / (xw + 15 * yw + 3 * zw), 9 * yw / (xw + 15 * yw + 3 * zw)
        return [
            dict(zip(("_x", "_y", "_z"), linear(mx.SRGB_TO_XYZ_SHORT, "rgb"), strict=True)),
            {"_d": "_x + 15e0 * _y + 3e0 * _z", "_fy": _LAB_F.replace("{v}", "_y")},
            {"r": "116e0 * _fy - 16e0"},
            {"g": f"CASE WHEN _d > 1e-12 THEN 13e0 * r * (4e0 * _x / nullif(_d, 0e0) - {n(uw)}) ELSE 0e0 END", "b": f"CASE WHEN _d > 1e-12 THEN 13e0 * r * (9e0 * _y / nullif(_d, 0e0) - {n(vw)}) ELSE 0e0 END"},
        ]
    if space == "cmyk":
        ink = lambda c: f"CASE WHEN _k < 1e0 THEN (1e0 - {c} - _k) / nullif(1e0 - _k, 0e0) ELSE 0e0 END"
        return [{"_k": "1e0 - greatest(r, g, b)"}, {c: ink(c) for c in "rgb"} | {"a": "_k"}]
    raise ValueError(f"unknown space {space}")


@point("decode_space", "colour spaces", {"of": "adobe_rgb"}, of="lab")
def _(of):
    """The reverse of encode_space for lab, prophoto, adobe_rgb, xyz, oklab and cmyk."""
    from pixelloom.operators.points import from_lab

    space = of
    if space in GAMMA:
        return [each(f"pow(greatest({{v}}, 0e0), {n(GAMMA[space])})"), dict(zip("rgb", linear(np.linalg.inv(_wide(space)), "rgb"), strict=True))]
    if space == "xyz":
        return dict(zip("rgb", linear(mx.XYZ_TO_SRGB_SHORT, "rgb"), strict=True))
    if space == "lab":
        return from_lab("r", "g", "b")
    if space == "oklab":
        return [
            dict(zip(("_lc", "_mc", "_sc"), linear(mx.CONES_FROM_OKLAB, "rgb"), strict=True)),
            each("{v} * {v} * {v}", "_lc", "_mc", "_sc"),
            dict(zip("rgb", linear(mx.SRGB_FROM_CONES, ("_lc", "_mc", "_sc")), strict=True)),
        ]
    if space == "cmyk":
        return each("(1e0 - {v}) * (1e0 - a)") | {"a": "1e0"}
    raise ValueError(f"unknown space {space}")


@point("levels_to_depth", "conversion", {"bits": 4}, bits=(8, 1, 16))
def _(bits):
    """Channels clipped and rounded to the levels of a bit depth, as encoders store them."""
    top = float((1 << bits) - 1)
    return each(f"floor({clamp('{v}')} * {n(top)} + 0.5e0) / {n(top)}", "r", "g", "b", "a")


@point("gray", "conversion")
def _():
    return [{"_y": "0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b"}, each("_y")]


def delta_e_94(l1: str, a1: str, b1: str, l2: str, a2: str, b2: str) -> str:
    """CIE 1994 difference of two Lab colours, for graphic arts."""
    c1, c2 = f"sqrt({a1} * {a1} + {b1} * {b1})", f"sqrt({a2} * {a2} + {b2} * {b2})"
    dc, dl = f"({c1} - {c2})", f"({l1} - {l2})"
    dh2 = f"greatest(({a1} - {a2}) * ({a1} - {a2}) + ({b1} - {b2}) * ({b1} - {b2}) - {dc} * {dc}, 0e0)"
    sc, sh = f"(1e0 + 0.045e0 * {c1})", f"(1e0 + 0.015e0 * {c1})"
    return f"sqrt({dl} * {dl} + {dc} * {dc} / ({sc} * {sc}) + {dh2} / ({sh} * {sh}))"


def delta_e_2000(lab1: np.ndarray, lab2: np.ndarray) -> np.ndarray:
    """CIEDE2000 difference of Lab colours."""
    (l1, a1, b1), (l2, a2, b2) = np.moveaxis(lab1, -1, 0), np.moveaxis(lab2, -1, 0)
    mean = (np.hypot(a1, b1) + np.hypot(a2, b2)) / 2
    g = 0.5 * (1 - np.sqrt(mean**7 / (mean**7 + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = np.degrees(np.arctan2(b1, a1)) % 360, np.degrees(np.arctan2(b2, a2)) % 360
    flat = c1 * c2 == 0
    turn = (h2 - h1 + 180) % 360 - 180
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(np.where(flat, 0, turn)) / 2)
    hm = np.where(flat, h1 + h2, np.where(np.abs(h1 - h2) <= 180, (h1 + h2) / 2, np.where(h1 + h2 < 360, (h1 + h2 + 360) / 2, (h1 + h2 - 360) / 2)))
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    r = np.radians
    t = 1 - 0.17 * np.cos(r(hm - 30)) + 0.24 * np.cos(r(2 * hm)) + 0.32 * np.cos(r(3 * hm + 6)) - 0.20 * np.cos(r(4 * hm - 63))
    sl = 1 + 0.015 * (lm - 50) ** 2 / np.sqrt(20 + (lm - 50) ** 2)
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    rt = -np.sin(r(60 * np.exp(-(((hm - 275) / 25) ** 2)))) * 2 * np.sqrt(cm**7 / (cm**7 + 25.0**7))
    dl, dc = (l2 - l1) / sl, (c2 - c1) / sc
    return np.sqrt(dl**2 + dc**2 + (dh / sh) ** 2 + rt * dc * dh / sh)
