"""Declarative forms of operators that run as kernels.

They say in relations what a kernel computes: a table of taps is joined with the
pixels, each tap finds its neighbour by place, and an aggregate puts the
neighbours together. That costs a row for each pixel and tap, so images run
through the kernels; these forms check them on another engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from pixelloom.functions.sql import LUMA, clamp, each, half_up, n
from pixelloom.operators import kernels as k
from pixelloom.operators.geometry import reflected, tidy
from pixelloom.operators.points import from_lab, to_lab
from pixelloom.operators.stats import auto_level
from pixelloom.plans.registry import OPERATORS
from pixelloom.plans.rel import Rel

PLACE = ("image_id", "y", "x")
RGB, RGBA = ("r", "g", "b"), ("r", "g", "b", "a")


def form(*names: str):
    def wrap(f):
        for name in names:
            OPERATORS[name].plan = f
        return f

    return wrap


def at_border(e: str, size: str, border: str) -> str:
    return reflected(e, size) if border == "mirror" else f"least(greatest({e}, 0), {size} - 1)"


def neighbours(rel: Rel, taps: Sequence[tuple[int, int, float]], cols: Sequence[str], border: str = "mirror", keep: Sequence[str] = ()) -> Rel:
    """(image_id, y, x, kept columns, _dy, _dx, _k, _{col} of the neighbour) for each pixel and tap."""
    base = rel.pick(*PLACE, *keep, _w="width", _h="height")
    out = base.join(rel.values(["_dy", "_dx", "_k"], [(dy, dx, float(w)) for dy, dx, w in taps]), [])
    out = out.let(_sy=f"cast({at_border('(y + _dy)', '_h', border)} as bigint)", _sx=f"cast({at_border('(x + _dx)', '_w', border)} as bigint)")
    return out.join(rel.pick("image_id", _sy="y", _sx="x", **{f"_{c}": c for c in cols}), ["image_id", "_sy", "_sx"])


def gathered(rel: Rel, taps, cols: Sequence[str] = RGB, border: str = "mirror", f: str = "sum(_k * {v})") -> Rel:
    """rel with columns replaced by an aggregate over their neighbours."""
    sums = neighbours(rel, taps, cols, border).agg(PLACE, **{f"_o{c}": f.replace("{v}", "_" + c) for c in cols})
    return tidy(rel.join(sums, PLACE).let(**{c: f"_o{c}" for c in cols}))


def rows_and_columns(rel: Rel, weights: np.ndarray, cols: Sequence[str] = RGBA, border: str = "mirror") -> Rel:
    r = len(weights) // 2
    rel = gathered(rel, [(0, i - r, w) for i, w in enumerate(weights)], cols, border)
    return gathered(rel, [(i - r, 0, w) for i, w in enumerate(weights)], cols, border)


def blurred(rel: Rel, sigma: float, cols: Sequence[str] = RGBA) -> Rel:
    return rows_and_columns(rel, k.bell(sigma), cols) if sigma > 0 else rel


def with_blur(rel: Rel, sigma: float, cols: Sequence[str] = RGB) -> Rel:
    """rel with columns _s{c} of its blurred channels."""
    return rel.join(blurred(rel, sigma, cols).pick(*PLACE, **{f"_s{c}": c for c in cols}), PLACE)


def grid_taps(weights: np.ndarray) -> list[tuple[int, int, float]]:
    h, w = weights.shape
    return [(y - h // 2, x - w // 2, float(weights[y, x])) for y in range(h) for x in range(w) if weights[y, x]]


def square(r: int) -> list[tuple[int, int, float]]:
    return [(dy, dx, 1.0) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


@form("gaussian_blur")
def _(rel, radius):
    return blurred(rel, radius)


@form("frequency_low")
def _(rel, sigma):
    return blurred(rel, sigma)


@form("box_blur")
def _(rel, radius):
    return rows_and_columns(rel, np.full(2 * radius + 1, 1 / (2 * radius + 1)))


@form("high_pass", "frequency_high")
def _(rel, **p):
    return tidy(with_blur(rel, next(iter(p.values()))).let(**{c: f"{c} - _s{c} + 0.5e0" for c in RGB}))


@form("sharpen")
def _(rel, radius, amount):
    return tidy(with_blur(rel, radius).let(**{c: f"{c} + {n(amount)} * ({c} - _s{c})" for c in RGB}))


@form("clarity")
def _(rel, amount, radius):
    out = with_blur(rel, radius).let(_q=f"{n(4 * amount)} * {LUMA} * (1e0 - {LUMA})")
    return tidy(out.let(**{c: f"{c} + _q * ({c} - _s{c})" for c in RGB}))


@form("convolve")
def _(rel, weights, divisor):
    return gathered(rel, grid_taps(np.array(weights, float) / divisor), RGBA)


@form("bokeh_blur")
def _(rel, radius, shape):
    area = k.polygon(radius, 6, 0.0) if shape else k.disc(radius)
    return gathered(rel, grid_taps(area / area.sum()), RGBA)


@form("lens_blur")
def _(rel, radius, blade_count, rotation):
    area = k.polygon(radius, blade_count, rotation) if blade_count > 2 else k.disc(radius)
    return gathered(rel, grid_taps(area / area.sum()), RGBA) if radius else rel


@form("motion_blur")
def _(rel, angle, length):
    steps = math.ceil(length)
    places = [((s - steps / 2) * math.sin(math.radians(angle)), (s - steps / 2) * math.cos(math.radians(angle))) for s in range(steps + 1)]
    return gathered(rel, [(math.floor(a + 0.5), math.floor(b + 0.5), 1.0 / (steps + 1)) for a, b in places], RGBA) if length > 0 else rel


@form("median")
def _(rel, radius):
    out = rel
    middle = (2 * radius + 1) ** 2 // 2 + 1
    for c in RGB:
        ranked = neighbours(rel, square(radius), [c]).let(_rank=f"row_number() OVER (PARTITION BY image_id, y, x ORDER BY _{c}, _dy, _dx)")
        out = out.join(ranked.where(f"_rank = {middle}").pick(*PLACE, **{f"_m{c}": f"_{c}"}), PLACE)
    return tidy(out.let(**{c: f"_m{c}" for c in RGB}))


def edges(rel: Rel, weights: np.ndarray, scale: float, border: str = "edge") -> Rel:
    taps = [(dy - 1, dx - 1, float(dy * 3 + dx)) for dy in range(3) for dx in range(3)]
    pick = lambda m: "CASE " + " ".join(f"WHEN _k = {i}e0 THEN {n(v)}" for i, v in enumerate(m.ravel())) + " ELSE 0e0 END"
    near = neighbours(rel.let(_y=LUMA), taps, ["_y"], border)
    sums = near.agg(PLACE, _gx=f"sum({pick(weights)} * __y)", _gy=f"sum({pick(weights.T)} * __y)")
    return rel.join(sums, PLACE).let(_e=f"sqrt(_gx * _gx + _gy * _gy) * {n(scale)}")


@form("sobel")
def _(rel, scale):
    return tidy(edges(rel, k.SOBEL, scale).let(**each("_e")))


@form("scharr")
def _(rel, scale):
    return tidy(edges(rel, k.SCHARR, scale / 32).let(**each("_e")))


@form("charcoal")
def _(rel, radius, sigma):
    drawn = tidy(edges(rel, k.SOBEL, 1.0, "mirror").let(**each("least(_e, 1e0)")))
    return blurred(drawn, sigma).let(**each("1e0 - {v}"))


@form("laplacian")
def _(rel, scale):
    taps = grid_taps(np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))
    sums = neighbours(rel.let(_y=LUMA), taps, ["_y"], "edge").agg(PLACE, _e=f"abs(sum(_k * __y)) * {n(scale)}")
    return tidy(rel.join(sums, PLACE).let(**each("_e")))


@form("emboss")
def _(rel):
    return gathered(rel, grid_taps(np.array([[-2, -1, 0], [-1, 1, 1], [0, 1, 2]], float))).let(**each("{v} + 0.5e0"))


@form("adaptive_threshold")
def _(rel, radius, offset):
    lit = rel.let(_y=LUMA)
    base = lit.pick(*PLACE).join(rel.values(["_dy", "_dx"], [t[:2] for t in square(radius)]), []).let(_sy="y + _dy", _sx="x + _dx")
    means = base.join(lit.pick("image_id", _sy="y", _sx="x", _v="_y"), ["image_id", "_sy", "_sx"]).agg(PLACE, _m="avg(_v)")
    return tidy(lit.join(means, PLACE).let(**each(f"CASE WHEN _y >= _m - {n(offset)} THEN 1e0 ELSE 0e0 END")))


def extreme(rel: Rel, radius: int, f: str) -> Rel:
    return gathered(rel, square(radius), RGB, "edge", f + "({v})")


@form("dilate")
def _(rel, radius):
    return extreme(rel, radius, "max")


@form("erode")
def _(rel, radius):
    return extreme(rel, radius, "min")


@form("morph_open")
def opened(rel, radius):
    return extreme(extreme(rel, radius, "min"), radius, "max")


@form("morph_close")
def closed(rel, radius):
    return extreme(extreme(rel, radius, "max"), radius, "min")


def against(rel: Rel, other: Rel, e: str) -> Rel:
    both = rel.join(other.pick(*PLACE, **{f"_o{c}": c for c in RGB}), PLACE)
    return tidy(both.let(**{c: e.replace("{o}", f"_o{c}").replace("{v}", c) for c in RGB}))


@form("morph_gradient")
def _(rel, radius):
    return against(extreme(rel, radius, "max"), extreme(rel, radius, "min"), "abs({v} - {o})")


@form("morph_tophat")
def _(rel, radius):
    return against(rel, opened(rel, radius), "greatest({v} - {o}, 0e0)")


@form("morph_blackhat")
def _(rel, radius):
    return against(rel, closed(rel, radius), "greatest({o} - {v}, 0e0)")


def log_ratio(rel: Rel, sigmas: Sequence[float]) -> Rel:
    """Columns _q{c}: sum over scales of the logarithm of a channel against its blur."""
    out = rel
    for i, s in enumerate(sigmas):
        out = out.join(blurred(rel, s, RGB).pick(*PLACE, **{f"_s{i}{c}": c for c in RGB}), PLACE)
    return out.let(**{f"_q{c}": " + ".join(f"ln(greatest({c}, 1e-10)) - ln(greatest(_s{i}{c}, 1e-10))" for i in range(len(sigmas))) for c in RGB})


def stretched(rel: Rel) -> Rel:
    return auto_level(tidy(rel))


@form("retinex_ssr")
def _(rel, sigma):
    return stretched(log_ratio(rel, [sigma]).let(**{c: f"_q{c}" for c in RGB}))


@form("retinex_msr")
def _(rel, **sigmas):
    return stretched(log_ratio(rel, list(sigmas.values())).let(**{c: f"(_q{c}) / 3e0" for c in RGB}))


@form("retinex_msrcr")
def _(rel, alpha, beta, **sigmas):
    share = lambda c: f"CASE WHEN r + g + b > 1e-10 THEN {c} / nullif(r + g + b, 0e0) ELSE {n(1 / 3)} END"
    return stretched(log_ratio(rel, list(sigmas.values())).let(**{c: f"{n(beta)} * greatest(ln(greatest({n(alpha)} * ({share(c)}), 1e-300)), -1e1) * _q{c} / 3e0" for c in RGB}))


@form("shadow_highlight")
def _(rel, shadows, highlights, whitepoint, radius, compress, shadows_ccorrect, highlights_ccorrect):
    lit = rel.let(_y=LUMA)
    soft = blurred(lit.pick(*PLACE, "width", "height", l0="_y"), radius, ["l0"]).pick(*PLACE, _bl="l0")
    mid = f"(1e0 - {n(compress / 100 * 4)} * _bl * (1e0 - _bl))" if compress > 0 else "1e0"
    out = lit.join(soft, PLACE).let(_dk=f"(1e0 - _bl) * (1e0 - _bl) * {mid}", _lt=f"_bl * _bl * {mid}", _old="greatest(_y, 1e-10)")
    out = out.let(_new=f"greatest(_old + {n(shadows / 100)} * _dk - {n(highlights / 100)} * _lt + {n(whitepoint * 0.01)}, 0e0)")
    gain = f"(_dk * {n(shadows_ccorrect / 100 - 1)} + _lt * {n(highlights_ccorrect / 100 - 1)})"
    return tidy(out.let(**{c: f"_new + ({c} - _old) * greatest(1e0 + CASE WHEN {c} - _old < 0e0 THEN -{gain} ELSE {gain} END, 0e0) * _new / _old" for c in RGB}))


@form("vignette")
def _(rel, sigma, x_inset, y_inset):
    u, v = f"((x - width / 2e0) / greatest(width / 2e0 - {x_inset}, 1e0))", f"((y - height / 2e0) / greatest(height / 2e0 - {y_inset}, 1e0))"
    mask = rel.pick(*PLACE, "width", "height", m0=f"CASE WHEN {u} * {u} + {v} * {v} <= 1e0 THEN 1e0 ELSE 0e0 END")
    mask = blurred(mask, sigma, ["m0"]).pick(*PLACE, _m="m0")
    return tidy(rel.join(mask, PLACE).let(**each("{v} * _m")))


@form("tilt_shift")
def _(rel, focus_position, band_size, blur_radius, angle):
    if blur_radius <= 0 or band_size >= 1:
        return rel
    s, c = math.sin(math.radians(angle)), math.cos(math.radians(angle))
    far = f"abs((x * 1e0 / width - 0.5e0) * {n(s)} + (y * 1e0 / height - {n(focus_position)}) * {n(c)})"
    d = clamp(f"({far} - {n(band_size / 2)}) / {n(max(band_size / 2, 0.05))}")
    out = with_blur(rel, blur_radius, RGBA).let(_d=d).let(_t="_d * _d * (3e0 - 2e0 * _d)")
    return tidy(out.let(**{c: f"{c} + _t * (_s{c} - {c})" for c in RGBA}))


def edge_kept(rel: Rel, diameter: int, sigma_color: float, sigma_space: float) -> Rel:
    """(image_id, y, x, _f{c}): channels averaged over neighbours that are near in place and in Lab."""
    r = diameter // 2
    lab = rel.steps(*to_lab())
    taps = [(dy, dx, math.exp(-0.5 * (dx * dx + dy * dy) / sigma_space**2)) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    near = neighbours(lab, taps, [*RGB, "_ll", "_aa", "_bb"], keep=["_ll", "_aa", "_bb"])
    d2 = " + ".join(f"(_{c} - {c}) * (_{c} - {c})" for c in ("_ll", "_aa", "_bb"))
    near = near.let(_wt=f"_k * exp(-0.5e0 * ({d2}) / {n(sigma_color**2)})")
    return near.agg(PLACE, **{f"_f{c}": f"sum(_wt * _{c}) / sum(_wt)" for c in RGB})


@form("bilateral")
def _(rel, diameter, sigma_color, sigma_space):
    return tidy(rel.join(edge_kept(rel, diameter, sigma_color, sigma_space), PLACE).let(**{c: f"_f{c}" for c in RGB}))


@form("smart_sharpen")
def _(rel, amount, radius, threshold):
    return tidy(rel.join(edge_kept(rel, 2 * radius + 1, threshold, radius), PLACE).let(**{c: f"{c} + {n(amount)} * ({c} - _f{c})" for c in RGB}))


@form("lab_sharpen")
def _(rel, amount, radius):
    r = math.ceil(radius * 3)
    w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * radius**2))
    lab = rel.steps(*to_lab())
    soft = rows_and_columns(lab.pick(*PLACE, "width", "height", l0="_ll"), w / w.sum(), ["l0"], "edge").pick(*PLACE, _s0="l0")
    out = lab.join(soft, PLACE).let(_ll=clamp(f"_ll + {n(amount)} * (_ll - _s0)", 0, 100))
    return tidy(out.steps(*from_lab()))


@form("feather")
def _(rel, radius):
    w = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * (radius / 2) ** 2))
    return rows_and_columns(rel, w / w.sum(), ["a"], "edge")


@form("harris_corners")
def _(rel, k, radius):
    lit = rel.let(_y=LUMA)
    cross = [(0, 1, 0.0), (0, -1, 1.0), (1, 0, 2.0), (-1, 0, 3.0)]
    # gradients at places up to `radius` outside the image too: taps add up before the border extends it
    near = lit.pick(*PLACE, _w="width", _h="height").join(lit.values(["_oy", "_ox"], [t[:2] for t in square(radius)]), [])
    near = near.join(lit.values(["_ty", "_tx", "_k"], cross), [])
    near = near.let(_sy="cast(least(greatest(y + _oy + _ty, 0), _h - 1) as bigint)", _sx="cast(least(greatest(x + _ox + _tx, 0), _w - 1) as bigint)")
    near = near.join(lit.pick("image_id", _sy="y", _sx="x", _v="_y"), ["image_id", "_sy", "_sx"])
    slopes = near.agg([*PLACE, "_oy", "_ox"], _gx="sum(CASE WHEN _k = 0e0 THEN _v WHEN _k = 1e0 THEN -_v ELSE 0e0 END)", _gy="sum(CASE WHEN _k = 2e0 THEN _v WHEN _k = 3e0 THEN -_v ELSE 0e0 END)")
    sums = slopes.agg(PLACE, _xx="sum(_gx * _gx)", _yy="sum(_gy * _gy)", _xy="sum(_gx * _gy)")
    return tidy(rel.join(sums, PLACE).let(**each(clamp(f"(_xx * _yy - _xy * _xy - {n(k)} * (_xx + _yy) * (_xx + _yy)) * 1e3"))))


@form("hough_lines")
def _(rel, threshold):
    lit = rel.let(_y=LUMA)
    inner = "x > 0 AND y > 0 AND x < width - 1 AND y < height - 1"
    span = "(PARTITION BY image_id, y ORDER BY x)"
    out = lit.let(_l=f"lag(_y) OVER {span}", _r=f"lead(_y) OVER {span}")
    return tidy(out.let(**each(f"CASE WHEN {inner} AND abs(_r - _l) > {n(threshold)} THEN 1e0 ELSE 0e0 END"), a=f"CASE WHEN {inner} THEN a ELSE 0e0 END"))


@form("template_match")
def _(rel, template_size):
    t = template_size
    lit = rel.let(_y=LUMA)
    top, left = f"(cast(floor(height / 2e0) as bigint) - {t // 2})", f"(cast(floor(width / 2e0) as bigint) - {t // 2})"
    patch = lit.where(f"y >= {top} AND y < {top} + {t} AND x >= {left} AND x < {left} + {t}").pick("image_id", _dy=f"y - {top}", _dx=f"x - {left}", _p="_y")
    base = lit.where(f"y < height - {t} AND x < width - {t}").pick(*PLACE).join(patch, ["image_id"]).let(_sy="y + _dy", _sx="x + _dx")
    sums = base.join(lit.pick("image_id", _sy="y", _sx="x", _v="_y"), ["image_id", "_sy", "_sx"]).agg(PLACE, _s=f"least(sum(_v * _p) / {n(t * t)}, 1e0)")
    return tidy(rel.join(sums, PLACE, "left").let(**each("coalesce(_s, 0e0)"), a="CASE WHEN _s IS NULL THEN 0e0 ELSE 1e0 END"))


@form("dehaze")
def _(rel, patch_radius, omega, t_min):
    lit = rel.let(_m="least(r, g, b)")
    dark = neighbours(lit, square(patch_radius), ["_m"], "edge").agg(PLACE, _d="min(__m)")
    ranked = lit.join(dark, PLACE).let(_rank="row_number() OVER (PARTITION BY image_id ORDER BY _d DESC, y, x)", _n="greatest(ceil(width * height * 0.001e0), 1)")
    air = ranked.where("_rank <= _n").agg(["image_id"], **{f"_a{c}": f"avg({c})" for c in RGB})
    clear = lit.join(air, ["image_id"]).let(_q="least(r / greatest(_ar, 1e-10), g / greatest(_ag, 1e-10), b / greatest(_ab, 1e-10))")
    hazy = neighbours(clear, square(patch_radius), ["_q"], "edge").agg(PLACE, _t=f"1e0 - {n(omega)} * min(__q)")
    return tidy(clear.join(hazy, PLACE).let(**{c: f"({c} - _a{c}) / greatest(_t, {n(t_min)}) + _a{c}" for c in RGB}))


@form("nlm_denoise")
def _(rel, h, patch_radius, search_radius):
    """Patches are compared tap by tap: both ends mirror at the border on their own, the far one after the near."""
    p = square(patch_radius)
    base = rel.pick(*PLACE, _w="width", _h="height").join(rel.values(["_ty", "_tx"], [t[:2] for t in square(search_radius)]), [])
    base = base.let(_ny=f"cast({reflected('(y + _ty)', '_h')} as bigint)", _nx=f"cast({reflected('(x + _tx)', '_w')} as bigint)")
    pairs = base.join(rel.values(["_py", "_px"], [t[:2] for t in p]), [])
    for side, y0, x0 in (("1", "y", "x"), ("2", "_ny", "_nx")):
        pairs = pairs.let(_sy=f"cast({reflected(f'({y0} + _py)', '_h')} as bigint)", _sx=f"cast({reflected(f'({x0} + _px)', '_w')} as bigint)")
        pairs = pairs.join(rel.pick("image_id", _sy="y", _sx="x", **{f"_{c}{side}": c for c in RGB}), ["image_id", "_sy", "_sx"]).drop("_sy", "_sx")
    gap = " + ".join(f"(_{c}1 - _{c}2) * (_{c}1 - _{c}2)" for c in RGB)
    weights = pairs.agg([*PLACE, "_ty", "_tx", "_ny", "_nx"], _wt=f"exp(-sum({gap}) / {n(3 * len(p) * h * h)})")
    near = weights.rename(_sy="_ny", _sx="_nx").join(rel.pick("image_id", _sy="y", _sx="x", **{f"_{c}": c for c in RGB}), ["image_id", "_sy", "_sx"])
    means = near.agg(PLACE, **{f"_f{c}": f"sum(_wt * _{c}) / sum(_wt)" for c in RGB})
    return tidy(rel.join(means, PLACE).let(**{c: f"_f{c}" for c in RGB}))


@form("halftone")
def _(rel, dot_size, angle_offset):
    cell = n(2 * max(dot_size, 1))
    out = rel
    for i, degrees in enumerate((15, 75, 0, 45)):
        c, s = n(math.cos(math.radians(degrees + angle_offset))), n(math.sin(math.radians(degrees + angle_offset)))
        out = out.let(_u=f"x * {c} + y * {s}", _v=f"y * {c} - x * {s}").let(_cu=f"{half_up(f'_u / {cell}')} * {cell}", _cv=f"{half_up(f'_v / {cell}')} * {cell}")
        at = lambda e, size: f"cast(floor(least(greatest({e}, 0e0), {size} - 1e0)) as bigint)"
        out = out.let(_sx=at(f"_cu * {c} + _cv * {s}", "width"), _sy=at(f"_cu * {s} + _cv * {c}", "height"))
        out = out.join(rel.pick("image_id", _sy="y", _sx="x", _r="r", _g="g", _b="b"), ["image_id", "_sy", "_sx"]).let(_bk="1e0 - greatest(_r, _g, _b)")
        density = "_bk" if i == 3 else f"CASE WHEN _bk < 1e0 THEN (1e0 - {('_r', '_g', '_b')[i]} - _bk) / nullif(1e0 - _bk, 0e0) ELSE 0e0 END"
        far = "sqrt((_u - _cu) * (_u - _cu) + (_v - _cv) * (_v - _cv))"
        out = out.let(**{f"_i{i}": f"CASE WHEN {far} <= {n(max(dot_size, 1))} * sqrt(greatest({density}, 0e0)) - 0.5e0 THEN 1e0 ELSE 0e0 END"})
        out = out.drop("_u", "_v", "_cu", "_cv", "_sx", "_sy", "_r", "_g", "_b", "_bk")
    return tidy(out.let(**{c: f"(1e0 - _i{i}) * (1e0 - _i3)" for i, c in enumerate(RGB)}))


@form("smart_crop")
def _(rel, ratio):
    size = rel.agg(["image_id"], _w="max(width)", _h="max(height)")
    size = size.let(_cw=f"cast(least(greatest(floor(_w * {n(ratio)}), 1), _w) as bigint)", _ch=f"cast(least(greatest(floor(_h * {n(ratio)}), 1), _h) as bigint)")
    size = size.let(_st="greatest(4, cast(floor(_cw / 1e1) as bigint))")
    spots = size.series("_i", "0", "floor((_h - _ch) * 1e0 / _st)").series("_j", "0", "floor((_w - _cw) * 1e0 / _st)").let(_y0="_i * _st", _x0="_j * _st")
    contrast = rel.let(_c="coalesce(abs(r - lead(r) OVER (PARTITION BY image_id, y ORDER BY x)), 0e0)").pick("image_id", _py="y", _px="x", _c="_c")
    inside = spots.join(contrast, ["image_id"]).where("_py >= _y0 AND _py < _y0 + _ch AND _px >= _x0 AND _px < _x0 + _cw AND (_py - _y0) % 4 = 0 AND (_px - _x0) % 4 = 0")
    energy = inside.agg(["image_id", "_y0", "_x0", "_cw", "_ch"], _e="round(sum(_c), 9)")
    best = energy.let(_rank="row_number() OVER (PARTITION BY image_id ORDER BY _e DESC, _y0, _x0)").where("_rank = 1")
    kept = rel.join(best, ["image_id"]).where("y >= _y0 AND y < _y0 + _ch AND x >= _x0 AND x < _x0 + _cw")
    return tidy(kept.let(y="y - _y0", x="x - _x0", width="_cw", height="_ch"))


# looked up at computed places


def with_places(rel: Rel, source: Rel) -> Rel:
    """rel joined with the channels _r, _g, _b, _a of source at its places _sy, _sx."""
    return rel.let(_sy="cast(_sy as bigint)", _sx="cast(_sx as bigint)").join(source.pick("image_id", _sy="y", _sx="x", **{f"_{c}": c for c in RGBA}), ["image_id", "_sy", "_sx"])


def averaged(rel: Rel, source: Rel) -> Rel:
    """The mean of the channels of source at the places (_px, _py), nearest pixel inside the image, of each pixel's rows in rel."""
    inside = lambda e, size: f"least(greatest({half_up(e)}, 0e0), {size} - 1e0)"
    found = with_places(rel.let(_sx=inside("_px", "width"), _sy=inside("_py", "height")), source)
    return tidy(found.agg([*PLACE, "width", "height"], **{c: f"avg(_{c})" for c in RGBA}))


@form("spin_blur")
def _(rel, center_x, center_y, angle):
    if abs(angle) < 1e-6:
        return rel
    turn = math.radians(angle)
    out = rel.let(_dx=f"x - {n(center_x)} * width", _dy=f"y - {n(center_y)} * height", _n=f"cast(ceil({n(abs(turn))} * sqrt(cast(width * width + height * height as double))) as bigint) + 2")
    out = out.let(_n="least(greatest(_n + 1 - _n % 2, 3), 129)").series("_i", "0", "_n - 1").let(_t=f"{n(turn)} * (_i - floor(_n / 2e0)) / _n")
    return averaged(out.let(_px=f"{n(center_x)} * width + _dx * cos(_t) - _dy * sin(_t)", _py=f"{n(center_y)} * height + _dx * sin(_t) + _dy * cos(_t)"), rel)


@form("zoom_blur")
def _(rel, center_x, center_y, factor):
    if abs(factor) < 1e-6:
        return rel
    out = rel.let(_dx=f"{n(center_x)} * width - x", _dy=f"{n(center_y)} * height - y")
    out = out.let(_n=f"least(greatest(ceil(sqrt(_dx * _dx + _dy * _dy) * {n(abs(factor))}), 3), 64)").series("_i", "0", "_n - 1").let(_t=f"_i * {n(factor)} / _n")
    return averaged(out.let(_px="x + _dx * _t", _py="y + _dy * _t"), rel)


@form("mirror_kaleidoscope")
def _(rel, segments, angle, mode):
    if mode < 2:
        at, size = ("y", "height") if mode else ("x", "width")
        out = rel.let(_part=f"floor({size} / {n(segments)})").let(_k=f"floor({at} / greatest(_part, 1e0))").let(_in=f"{at} - _k * _part")
        place = f"CASE WHEN _part < 1e0 THEN {at} WHEN _k - 2e0 * floor(_k / 2e0) = 0e0 THEN _in ELSE _part - 1e0 - _in END"
        out = out.let(_sy=place if mode else "y", _sx="x" if mode else place)
    else:
        base, part = math.radians(angle), 2 * math.pi / segments
        out = rel.let(_dx="x - width / 2e0", _dy="y - height / 2e0").let(_turn=f"atan2(_dy, _dx) - {n(base)}", _far="sqrt(_dx * _dx + _dy * _dy)")
        out = out.let(_turn=f"CASE WHEN _turn < 0e0 THEN _turn + {n(2 * math.pi)} ELSE _turn END").let(_k=f"greatest(floor(_turn / {n(part)}), 0e0)").let(_in=f"_turn - _k * {n(part)}")
        out = out.let(_to=f"CASE WHEN _k - 2e0 * floor(_k / 2e0) = 0e0 THEN _in ELSE {n(part)} - _in END + {n(base)}")
        out = out.let(_sx=half_up("(width / 2e0 + _far * cos(_to))"), _sy=half_up("(height / 2e0 + _far * sin(_to))"))
        fold = lambda v, size: f"CASE WHEN {v} < 0e0 THEN least(-{v}, {size} - 1e0) WHEN {v} >= {size} THEN greatest(2e0 * {size} - {v} - 2e0, 0e0) ELSE {v} END"
        out = out.let(_sx=fold("_sx", "width"), _sy=fold("_sy", "height"))
    return tidy(with_places(out, rel).let(**{c: f"_{c}" for c in RGBA}))


@form("oil_paint")
def _(rel, radius):
    level = "least(greatest(0.212656e0 * r + 0.715158e0 * g + 0.072186e0 * b, 0e0) * 255e0 + 0.5e0, 255e0)"
    side = 2 * radius + 1
    near = neighbours(rel.let(_level=f"floor({level})"), [(dy, dx, float((dy + radius) * side + dx + radius)) for dy, dx, _ in square(radius)], ["r", "g", "b", "_level"], "edge")
    # the level that a pixel's neighbours reach the most often, at the neighbour that brings it there first
    near = near.let(_seen="row_number() OVER (PARTITION BY image_id, y, x, __level ORDER BY _k)").let(_rank=f"_seen * {side * side} - _k")
    best = near.agg(PLACE, **{f"_o{c}": f"max_by(_{c}, _rank)" for c in RGB})
    return tidy(rel.join(best, PLACE).let(**{c: f"_o{c}" for c in RGB}))


def half_even(e: str) -> str:
    """Nearest integer, halves to the even one, of a value that isn't negative."""
    return f"CASE WHEN {e} - floor({e}) = 0.5e0 THEN 2e0 * floor({e} / 2e0 + 0.5e0) ELSE floor({e} + 0.5e0) END"


@form("clahe")
def _(rel, tile_grid, clip_limit):
    g = tile_grid
    y = clamp(LUMA)
    out = rel.let(_y=y, _th=f"floor(height / {n(g)})", _tw=f"floor(width / {n(g)})").let(_level="cast(floor(least(_y * 255e0 + 0.5e0, 255e0)) as bigint)")
    out = out.where("_th > 0e0 AND _tw > 0e0")
    sizes = ["image_id", "_th", "_tw"]
    tiled = out.where(f"y < _th * {g} AND x < _tw * {g}").let(_ty="cast(floor(y / _th) as bigint)", _tx="cast(floor(x / _tw) as bigint)")
    found = tiled.agg([*sizes, "_ty", "_tx", "_level"], _n="count(*)")
    full = out.agg(sizes, _one="count(*)").series("_ty", "0", str(g - 1)).series("_tx", "0", str(g - 1)).series("_level", "0", "255")
    full = full.join(found, [*sizes, "_ty", "_tx", "_level"], "left").let(_n="coalesce(_n, 0)", _clip=f"floor(greatest({n(clip_limit)} * _th * _tw / 256e0, 1e0))")
    tile = "PARTITION BY image_id, _ty, _tx"
    full = full.let(_over=f"sum(greatest(_n - _clip, 0e0)) OVER ({tile})").let(_rest="_over - 256e0 * floor(_over / 256e0)")
    full = full.let(_step="greatest(floor(256e0 / greatest(_rest, 1e0)), 1e0)")
    extra = "CASE WHEN _rest > 0e0 AND _level - _step * floor(_level / _step) = 0e0 AND _level / _step < _rest THEN 1e0 ELSE 0e0 END"
    full = full.let(_n=f"least(_n, _clip) + floor(_over / 256e0) + {extra}")
    full = full.let(_sum=f"sum(_n) OVER ({tile} ORDER BY _level ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    table = full.pick("image_id", "_ty", "_tx", "_level", _v=clamp(half_even("(_sum * (255e0 / (_th * _tw)))"), 0, 255))
    low = lambda at: f"cast(least(greatest(floor({at}), 0e0), {n(g - 1)}) as bigint)"
    out = out.let(_py="y / _th - 0.5e0", _px="x / _tw - 0.5e0").let(_y0=low("_py"), _x0=low("_px"))
    out = out.let(_y1=f"least(_y0 + 1, {g - 1})", _x1=f"least(_x0 + 1, {g - 1})", _fv=clamp("(_py - _y0)"), _fu=clamp("(_px - _x0)"))
    for a in "01":
        for b in "01":
            out = out.join(table.pick("image_id", "_level", **{f"_y{a}": "_ty", f"_x{b}": "_tx", f"_t{a}{b}": "_v"}), ["image_id", f"_y{a}", f"_x{b}", "_level"])
    new = "((_t00 * (1e0 - _fu) + _t01 * _fu) * (1e0 - _fv) + (_t10 * (1e0 - _fu) + _t11 * _fu) * _fv)"
    return tidy(out.let(_gain=f"{new} / 255e0 / greatest(_y, 1e-10)").let(**{c: f"{c} * _gain" for c in RGB}))


# scopes: dots that add up on a square of their own


def scope_of(rel: Rel, size: int, dots: Rel) -> Rel:
    """A picture of each image, `size` by `size`, of the light (r, g, b) of the dots (image_id, y, x) on black."""
    light = dots.where(f"x >= 0 AND y >= 0 AND x < {size} AND y < {size}").agg(PLACE, **{f"_{c}": f"sum({c})" for c in RGB})
    grid = rel.agg(["image_id"], _one="count(*)").series("y", "0", str(size - 1)).series("x", "0", str(size - 1))
    lit = {c: clamp(f"coalesce(_{c}, 0e0)") for c in RGB}
    return tidy(grid.join(light, PLACE, "left").let(width=f"cast({size} as bigint)", height=f"cast({size} as bigint)", a="1e0", **lit))


def _dots(rel: Rel, x: str, y: str, rgb: Sequence[float], light: str) -> Rel:
    return rel.pick("image_id", _x=f"cast({x} as bigint)", _y=f"cast({y} as bigint)", **{c: f"{n(v)} * {light}" for c, v in zip(RGB, rgb, strict=True)}).pick("image_id", "r", "g", "b", y="_y", x="_x")


_FAINT = "least(greatest(4e0 / height, 0.02e0), 0.5e0)"


@form("scope_waveform")
def _(rel, scope_size, log_scale):
    return scope_of(rel, scope_size, _dots(rel, f"floor(x / cast(width as double) * {n(scope_size - 1)})", f"floor((1e0 - {clamp(LUMA)}) * {n(scope_size - 1)})", (0.2, 0.8, 0.2), _FAINT))


@form("scope_parade")
def _(rel, scope_size, log_scale):
    third = scope_size // 3
    dots = None
    for k, c in enumerate(RGB):
        own = _dots(rel, f"floor(x / cast(width as double) * {n(third - 2)}) + {k * third}", f"floor((1e0 - {clamp(c)}) * {n(scope_size - 1)})", [0.9 if c == o else 0.15 for o in RGB], _FAINT)
        dots = own if dots is None else dots.union(own)
    column = rel.agg(["image_id"], _one="count(*)").series("_row", "0", str(scope_size - 1))
    for k in (1, 2):
        dots = dots.union(_dots(column, str(k * third), "_row", (0.3, 0.3, 0.3), "1e0"))
    return scope_of(rel, scope_size, dots)


@form("scope_histogram")
def _(rel, scope_size, log_scale):
    top = n(scope_size - 1)
    bins = None
    for k, e in enumerate((*RGB, LUMA)):
        own = rel.pick("image_id", _c=f"cast({k} as bigint)", _k=f"cast(floor(least({clamp(e)} * 255e0, 255e0)) as bigint)").agg(["image_id", "_c", "_k"], _n="count(*)")
        bins = own if bins is None else bins.union(own)
    most = bins.where("_c < 3").agg(["image_id"], _most="max(_n)")
    size = "ln(_n + 1e0) / ln(_most + 1e0)" if log_scale else "_n / cast(_most as double)"
    bins = bins.join(most, ["image_id"]).let(_x=f"floor(_k / 255e0 * {top})", _size=f"cast(floor({size} * {top}) as bigint)").where("_size > 0")
    bars = bins.where("_c < 3").series("_up", "1", "_size")
    light = lambda k: f"CASE WHEN _c = {k} THEN 0.9e0 ELSE 0.1e0 END * 0.5e0"
    dots = bars.pick("image_id", _px="cast(_x as bigint)", _py=f"{scope_size} - _up", **{c: light(k) for k, c in enumerate(RGB)}).pick("image_id", "r", "g", "b", y="_py", x="_px")
    marks = _dots(bins.where("_c = 3"), "_x", f"{scope_size - 1} - _size", (0.7, 0.7, 0.7), "0.6e0")
    return scope_of(rel, scope_size, dots.union(marks))


@form("scope_vectorscope")
def _(rel, scope_size, log_scale):
    # the grid and its marks, which no image changes, are a table; hue and saturation place the dots
    lines = k.vectorscope_grid(scope_size).out
    y, x = np.nonzero(lines[..., :3].any(-1))
    fixed = rel.agg(["image_id"], _one="count(*)")
    fixed = fixed.join(fixed.values(["y", "x", "r", "g", "b"], [(int(i), int(j), *map(float, lines[i, j, :3])) for i, j in zip(y, x, strict=True)]), []).pick("image_id", "r", "g", "b", "y", "x")
    bright = rel.let(**{c: clamp(c) for c in RGB}).let(_hi="greatest(r, g, b)", _lo="least(r, g, b)")
    bright = bright.let(_gap="_hi - _lo", _both="_hi + _lo").where("_gap > 0e0")
    bright = bright.let(_sat="_gap / CASE WHEN _both <= 1e0 THEN _both ELSE 2e0 - _both END").where("_sat >= 0.001e0")
    hue = "CASE WHEN r = _hi THEN (g - b) / _gap WHEN g = _hi THEN 2e0 + (b - r) / _gap ELSE 4e0 + (r - g) / _gap END"
    bright = bright.let(_turn=f"{hue} * {n(math.pi / 3)}", _far=f"_sat * {n(scope_size / 2 - 2)}")
    spots = bright.pick(
        "image_id", _py=f"cast(floor({n(scope_size / 2)} - _far * sin(_turn)) as bigint)", _px=f"cast(floor({n(scope_size / 2)} + _far * cos(_turn)) as bigint)",
        **{c: f"({c} * 0.6e0 + 0.2e0) * least(greatest(8e0 / (width * height), 0.005e0), 0.3e0)" for c in RGB},
    )
    return scope_of(rel, scope_size, fixed.union(spots.pick("image_id", "r", "g", "b", y="_py", x="_px")))


@form("pyramid_detail_remap")
def _(rel, sigma, levels):
    corners = rel.join(rel.values(["_dy", "_dx"], [(0, 0), (0, 1), (1, 0), (1, 1)]), [])
    corners = corners.let(_sy="least(floor(y / 2e0) * 2e0 + _dy, height - 1e0)", _sx="least(floor(x / 2e0) * 2e0 + _dx, width - 1e0)")
    means = with_places(corners, rel).agg(PLACE, **{f"_m{c}": f"sum(_{c}) / 4e0" for c in RGB})
    detail = lambda c: f"({c} - _m{c})"
    return tidy(rel.join(means, PLACE).let(**{c: f"_m{c} + {detail(c)} * {n(sigma)} / ({n(sigma)} + abs{detail(c)})" if abs(sigma) > 1e-10 else f"_m{c}" for c in RGB}))
