"""Geometric operators: coordinates change, and with them the size of images."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pixelloom.functions.sql import half_up, lerp, n, smoothstep, whole
from pixelloom.operators.points import SPOT, TO_RAD, spot
from pixelloom.plans.registry import OPERATORS, plan
from pixelloom.plans.rel import Rel

CHANNELS = "rgba"


def tidy(rel: Rel) -> Rel:
    return rel.pick(*(c for c in rel.cols if not c.startswith("_")))


def nearest(rel: Rel, source: Rel, sx: str, sy: str, channels: str = CHANNELS) -> Rel:
    """rel with the channels of source's pixels at integer expressions (sx, sy)."""
    keyed = rel.let(_sx=f"cast({sx} as bigint)", _sy=f"cast({sy} as bigint)")
    there = source.pick("image_id", **{"_sy": "y", "_sx": "x"}, **{f"_n{c}": c for c in channels})
    return keyed.join(there, ["image_id", "_sy", "_sx"]).let(**{c: f"_n{c}" for c in channels})


def bilinear(rel: Rel, source: Rel, sx: str, sy: str, channels: str = CHANNELS, into: str = "") -> Rel:
    """rel with the channels of source at real (sx, sy), its border extended; into names the columns that get them."""
    edge = lambda e, size: f"least(greatest({e}, 0), {size} - 1)"
    out = rel.let(_u=sx, _v=sy).let(_iu=whole("_u"), _iv=whole("_v")).let(_du="_u - _iu", _dv="_v - _iv")
    out = out.let(_u0=edge("_iu", "width"), _u1=edge("_iu + 1", "width"), _v0=edge("_iv", "height"), _v1=edge("_iv + 1", "height"))
    for k in range(4):
        there = source.pick("image_id", **{f"_v{k // 2}": "y", f"_u{k % 2}": "x"}, **{f"_p{k}{c}": c for c in channels})
        out = out.join(there, ["image_id", f"_v{k // 2}", f"_u{k % 2}"])
    return out.let(**{into + c: lerp(lerp(f"_p0{c}", f"_p1{c}", "_du"), lerp(f"_p2{c}", f"_p3{c}", "_du"), "_dv") for c in channels})


def grid(rel: Rel, width: str, height: str) -> Rel:
    """All places (y, x) of each image at a new size; expressions over width and height as they were."""
    sizes = rel.agg(["image_id"], _w="max(width)", _h="max(height)").pick("image_id", **{k: v.replace("{w}", "_w").replace("{h}", "_h") for k, v in (("width", width), ("height", height), ("_ow", "{w}"), ("_oh", "{h}"))})
    return sizes.series("y", "0", "height - 1").series("x", "0", "width - 1")


# dimension-changing transforms


@plan("crop", "geometry", {"x": 3, "y": 2, "w": 9, "h": 7}, x=(0, 0, 1 << 30), y=(0, 0, 1 << 30), w=(1, 1, 1 << 30), h=(1, 1, 1 << 30))
def crop(rel: Rel, x: int, y: int, w: int, h: int) -> Rel:
    inside = rel.where(f"x >= {x} AND x < {x + w} AND y >= {y} AND y < {y + h}")
    return inside.let(x=f"x - {x}", y=f"y - {y}", width=f"cast(least(width - {x}, {w}) as bigint)", height=f"cast(least(height - {y}, {h}) as bigint)")


@plan("flip", "geometry", {"vertical": True}, vertical=False)
def flip(rel: Rel, vertical: bool) -> Rel:
    return rel.let(y="height - 1 - y") if vertical else rel.let(x="width - 1 - x")


@plan("rotate", "geometry", {"degrees": 90}, degrees=(90, 0, 270))
def rotate(rel: Rel, degrees: int) -> Rel:
    """Clockwise by 0, 90, 180 or 270 degrees."""
    if degrees % 90:
        raise ValueError("rotate takes multiples of 90 degrees; rotate_arbitrary takes any")
    moves = [{}, {"x": "height - 1 - y", "y": "x"}, {"x": "width - 1 - x", "y": "height - 1 - y"}, {"x": "y", "y": "width - 1 - x"}]
    move = moves[degrees // 90 % 4]
    return rel.let(**move, **({"width": "height", "height": "width"} if degrees // 90 % 2 else {})) if move else rel


#: EXIF orientations 1 to 8 as (flip, then clockwise degrees).
ORIENTATIONS = {1: (False, 0), 2: (True, 0), 3: (False, 180), 4: (True, 180), 5: (True, 270), 6: (False, 90), 7: (True, 90), 8: (False, 270)}


@plan("auto_orient", "geometry", {"orientation": 5}, orientation=(1, 1, 8))
def auto_orient(rel: Rel, orientation: int) -> Rel:
    mirrored, degrees = ORIENTATIONS[orientation]
    return rotate(flip(rel, False) if mirrored else rel, degrees)


@plan("pad", "geometry", {"top": 1, "right": 2, "bottom": 3, "left": 4, "fill_r": 0.5}, top=(0, 0, 8192), right=(0, 0, 8192), bottom=(0, 0, 8192), left=(0, 0, 8192), **{f"fill_{c}": (0.0, 0.0, 1.0) for c in CHANNELS})
def pad(rel: Rel, top: int, right: int, bottom: int, left: int, **fill: float) -> Rel:
    base = grid(rel, f"{{w}} + {left + right}", f"{{h}} + {top + bottom}")
    moved = rel.pick("image_id", y=f"y + {top}", x=f"x + {left}", **{f"_{c}": c for c in CHANNELS})
    return tidy(base.join(moved, ["image_id", "y", "x"], "left").let(**{c: f"coalesce(_{c}, {n(fill['fill_' + c])})" for c in CHANNELS}))


@plan("trim", "geometry", {"threshold": 0.2}, threshold=(0.0, 0.0, 1.0))
def trim(rel: Rel, threshold: float) -> Rel:
    """Cuts borders whose pixels are all within the threshold of the top-left pixel; an image of that colour alone stays."""
    corner = rel.where("x = 0 AND y = 0").pick("image_id", **{f"_{c}": c for c in CHANNELS})
    differs = rel.join(corner, ["image_id"]).where(" OR ".join(f"abs({c} - _{c}) > {n(threshold)}" for c in CHANNELS))
    box = differs.agg(["image_id"], _x0="min(x)", _x1="max(x)", _y0="min(y)", _y1="max(y)")
    kept = rel.join(box, ["image_id"], "left").where("_x0 IS NULL OR (x BETWEEN _x0 AND _x1 AND y BETWEEN _y0 AND _y1)")
    return tidy(kept.let(x="x - coalesce(_x0, 0)", y="y - coalesce(_y0, 0)", width="coalesce(_x1 - _x0 + 1, width)", height="coalesce(_y1 - _y0 + 1, height)"))


def _taps(size_from: str, size_to: str, method: str, place: str) -> tuple[str, str, str]:
    """(first, last, weight) of the source places that make a destination place along one axis; weights sum up to 1 after division."""
    scale = f"({size_from} * 1e0 / {size_to})"
    center = f"(({place} + 0.5e0) * {scale} - 0.5e0)"
    if method == "nearest":
        at = f"least({whole(f'({place} + 0.5e0) * {scale}')}, {size_from} - 1)"
        return at, at, "1e0"
    support = {"bilinear": 1.0, "bicubic": 2.0, "lanczos3": 3.0}[method]
    wide = f"greatest({scale}, 1e0)"
    d = f"abs((_s - {center}) / {wide})"
    weight = {
        "bilinear": f"greatest(1e0 - {d}, 0e0)",
        "bicubic": f"CASE WHEN {d} < 1e0 THEN (1.5e0 * {d} - 2.5e0) * {d} * {d} + 1e0 WHEN {d} < 2e0 THEN ((-0.5e0 * {d} + 2.5e0) * {d} - 4e0) * {d} + 2e0 ELSE 0e0 END",
        "lanczos3": f"CASE WHEN {d} < 1e-9 THEN 1e0 WHEN {d} < 3e0 THEN 3e0 * sin({n(math.pi)} * {d}) * sin({n(math.pi / 3)} * {d}) / ({n(math.pi**2)} * {d} * {d}) ELSE 0e0 END",
    }[method]
    return f"greatest(ceil({center} - {n(support)} * {wide}), 0)", f"least(floor({center} + {n(support)} * {wide}), {size_from} - 1)", weight


@plan("resize", "geometry", {"w": 11, "h": 7, "method": "bilinear"}, w=(64, 1, 65536), h=(64, 1, 65536), method="lanczos3")
def resize(rel: Rel, w: int, h: int, method: str) -> Rel:
    """Separable resampling, one axis at a time; where an image shrinks the filter widens."""
    sizes = rel.agg(["image_id"], _ow="max(width)", _oh="max(height)")
    out = rel
    for axis, size, target in (("x", "_ow", w), ("y", "_oh", h)):
        first, last, weight = _taps(size, str(target), method, "_to")
        taps = sizes.series("_to", "0", str(target - 1)).series("_s", first, last).let(_wt=weight).pick("image_id", "_to", "_wt", **{axis: "_s"})
        keys = ["image_id", "_to", "y" if axis == "x" else "x"]
        joined = out.join(taps, ["image_id", axis])
        out = joined.agg(keys, **{c: f"sum({c} * _wt) / sum(_wt)" for c in CHANNELS}).rename(**{axis: "_to"})
    return out.let(width=f"cast({w} as bigint)", height=f"cast({h} as bigint)").pick("image_id", "width", "height", "y", "x", *CHANNELS)


def _inverse(rel: Rel, width: str, height: str, sx: str, sy: str, background: Sequence[float]) -> Rel:
    """New images whose pixel is the old one at (sx, sy), bilinear; the background outside."""
    out = grid(rel, width, height).let(_x=sx, _y=sy)
    inside = "_x >= -0.5e0 AND _y >= -0.5e0 AND _x <= _ow - 0.5e0 AND _y <= _oh - 0.5e0"
    sized = out.let(_nw="width", _nh="height").let(width="_ow", height="_oh")
    got = bilinear(sized.let(_in=f"CASE WHEN {inside} THEN 1 ELSE 0 END"), rel, "CASE WHEN _in = 1 THEN _x ELSE 0e0 END", "CASE WHEN _in = 1 THEN _y ELSE 0e0 END")
    return tidy(got.let(width="_nw", height="_nh", **{c: f"CASE WHEN _in = 1 THEN {c} ELSE {n(v)} END" for c, v in zip(CHANNELS, background, strict=True)}))


FILL = {f"fill_{c}": (0.0, 0.0, 1.0) for c in CHANNELS}


@plan("affine", "geometry", {"a": 0.9, "b": 0.1, "tx": 1.0, "c": -0.1, "d": 1.1, "ty": 0.5, "w": 12, "h": 10}, a=1.0, b=0.0, tx=0.0, c=0.0, d=1.0, ty=0.0, w=(64, 1, 65536), h=(64, 1, 65536), **FILL)
def affine(rel: Rel, a: float, b: float, tx: float, c: float, d: float, ty: float, w: int, h: int, **fill: float) -> Rel:
    """Forward matrix [[a, b, tx], [c, d, ty]] from old to new places."""
    det = a * d - b * c
    if abs(det) < 1e-12:
        raise ValueError("the matrix has no inverse")
    x, y = f"(x - {n(tx)})", f"(y - {n(ty)})"
    return _inverse(rel, f"cast({w} as bigint)", f"cast({h} as bigint)", f"({n(d)} * {x} - {n(b)} * {y}) / {n(det)}", f"({n(a)} * {y} - {n(c)} * {x}) / {n(det)}", [fill[f"fill_{k}"] for k in CHANNELS])


@plan("rotate_arbitrary", "geometry", {"degrees": 25.0}, degrees=(0.0, -360.0, 360.0), **FILL)
def rotate_arbitrary(rel: Rel, degrees: float, **fill: float) -> Rel:
    """Clockwise about the centre, on a canvas that holds the turned image."""
    cos, sin = math.cos(degrees * TO_RAD), math.sin(degrees * TO_RAD)
    new_w = f"cast(ceil({{w}} * {n(abs(cos))} + {{h}} * {n(abs(sin))} - 1e-6) as bigint)"
    new_h = f"cast(ceil({{w}} * {n(abs(sin))} + {{h}} * {n(abs(cos))} - 1e-6) as bigint)"
    x, y = "(x - (width - 1) / 2e0)", "(y - (height - 1) / 2e0)"
    return _inverse(rel, new_w, new_h, f"{n(cos)} * {x} + {n(sin)} * {y} + (_ow - 1) / 2e0", f"{n(-sin)} * {x} + {n(cos)} * {y} + (_oh - 1) / 2e0", [fill[f"fill_{k}"] for k in CHANNELS])


@plan("undistort", "geometry", {"k1": 0.1, "p1": 0.01, "focal": 0.9}, focal=(1.0, 0.1, 10.0), k1=0.0, k2=0.0, k3=0.0, p1=0.0, p2=0.0)
def undistort(rel: Rel, focal: float, k1: float, k2: float, k3: float, p1: float, p2: float) -> Rel:
    """Lens distortion (radial k, tangential p) taken out; focal length in image widths, the centre in the middle."""
    f = f"({n(focal)} * width)"
    out = rel.let(_x=f"(x - (width - 1) / 2e0) / {f}", _y=f"(y - (height - 1) / 2e0) / {f}").let(_r="_x * _x + _y * _y")
    out = out.let(_k=f"1e0 + _r * ({n(k1)} + _r * ({n(k2)} + _r * {n(k3)}))")
    sx = f"(_x * _k + 2e0 * {n(p1)} * _x * _y + {n(p2)} * (_r + 2e0 * _x * _x)) * {f} + (width - 1) / 2e0"
    sy = f"(_y * _k + {n(p1)} * (_r + 2e0 * _y * _y) + 2e0 * {n(p2)} * _x * _y) * {f} + (height - 1) / 2e0"
    return tidy(bilinear(out, rel, sx, sy))


def concat(images: Sequence[Rel], columns: int | None = None, gap: int = 0, background: Sequence[float] = (0.0, 0.0, 0.0, 1.0)) -> Rel:
    """Images of one id side by side (columns=None), or in a grid row by row; each is centred in its cell, which is as large as the largest image."""
    columns = columns or len(images)
    rows = -(-len(images) // columns)
    sizes = images[0].agg(["image_id"], _w0="max(width)", _h0="max(height)")
    for i, img in enumerate(images[1:], 1):
        sizes = sizes.join(img.agg(["image_id"], **{f"_w{i}": "max(width)", f"_h{i}": "max(height)"}), ["image_id"])
    most = lambda k: f"greatest({', '.join(f'_{k}{i}' for i in range(len(images)))})" if len(images) > 1 else f"_{k}0"
    sizes = sizes.let(_cw=most("w"), _ch=most("h"))
    canvas = sizes.pick("image_id", width=f"_cw * {columns} + {gap * (columns - 1)}", height=f"_ch * {rows} + {gap * (rows - 1)}").series("y", "0", "height - 1").series("x", "0", "width - 1")
    placed = None
    for i, img in enumerate(images):
        row, column = divmod(i, columns)
        cells = sizes.pick("image_id", "_cw", "_ch")
        part = img.join(cells, ["image_id"]).let(_x=f"x + (_cw + {gap}) * {column} + {whole('(_cw - width) / 2e0')}", _y=f"y + (_ch + {gap}) * {row} + {whole('(_ch - height) / 2e0')}")
        part = part.pick("image_id", x="_x", y="_y", **{f"_{c}": c for c in CHANNELS})
        placed = part if placed is None else placed.union(part)
    return tidy(canvas.join(placed, ["image_id", "y", "x"], "left").let(**{c: f"coalesce(_{c}, {n(v)})" for c, v in zip(CHANNELS, background, strict=True)}))


def composite_over(foreground: Rel, background: Rel, dx: int = 0, dy: int = 0) -> Rel:
    """A foreground of any size laid over a background with its corner at (dx, dy)."""
    front = foreground.pick("image_id", y=f"y + {dy}", x=f"x + {dx}", **{f"_f{c}": c for c in CHANNELS})
    both = background.join(front, ["image_id", "y", "x"], "left").let(**{f"_f{c}": f"coalesce(_f{c}, 0e0)" for c in CHANNELS})
    both = both.steps({"_k": "a * (1e0 - _fa)"}, {"_oa": "_fa + _k"})
    return tidy(both.let(**{c: f"CASE WHEN _oa > 1e-7 THEN (_f{c} * _fa + {c} * _k) / nullif(_oa, 0e0) ELSE 0e0 END" for c in "rgb"}, a="_oa"))


# distortions: places as expressions, for both forms

CENTER = {"_cx": "width * 0.5e0", "_cy": "height * 0.5e0"}
TAU = n(2 * math.pi)


def _radial(cx: str, cy: str) -> list[dict[str, str]]:
    return [{"_dx": f"x - {cx}", "_dy": f"y - {cy}"}, {"_d": "sqrt(_dx * _dx + _dy * _dy)"}]


def places(name: str, p: dict) -> tuple[list[dict[str, str]], str, str]:
    """(stages, sx, sy) of a distortion: where the pixel at (x, y) comes from."""
    if name == "barrel":
        unit = [CENTER, {"_nx": "(x - _cx) / _cx", "_ny": "(y - _cy) / _cy"}, {"_r": "_nx * _nx + _ny * _ny"}, {"_k": f"1e0 + {n(p['k1'])} * _r + {n(p['k2'])} * _r * _r"}]
        return unit, "_nx * _k * _cx + _cx", "_ny * _k * _cy + _cy"
    if name == "spherize":
        unit = [CENTER, {"_nx": "(x - _cx) / _cx", "_ny": "(y - _cy) / _cy"}, {"_r": "sqrt(_nx * _nx + _ny * _ny)"}]
        k = f"CASE WHEN _r < 1e0 AND _r > 0e0 THEN 1e0 + {n(p['amount'])} * (asin(least(_r, 1e0)) / nullif(_r, 0e0) - 1e0) ELSE 1e0 END"
        return [*unit, {"_k": k}], "_nx * _k * _cx + _cx", "_ny * _k * _cy + _cy"
    if name == "polar":
        stages = [CENTER, {"_t": f"(x + 0.5e0 - _cx) / width * {TAU}", "_r": "(y + 0.5e0) / height * least(_cx, _cy)"}]
        return stages, "_cx + _r * sin(_t) - 0.5e0", "_cy + _r * cos(_t) - 0.5e0"
    if name == "depolar":
        stages = [CENTER, {"_dx": "x + 0.5e0 - _cx", "_dy": "y + 0.5e0 - _cy"}, {"_t": f"atan2(_dx, _dy) / {TAU}", "_r": "sqrt(_dx * _dx + _dy * _dy)"}]
        return stages, f"(_t - {half_up('_t')}) * width + _cx - 0.5e0", "_r * height / least(_cx, _cy) - 0.5e0"
    if name == "ripple":
        stages = [*_radial(f"{n(p['center_x'])} * width", f"{n(p['center_y'])} * height"), {"_k": f"CASE WHEN _d > 0e0 THEN {n(p['amplitude'])} * sin({TAU} * _d / {n(p['wavelength'])}) / nullif(_d, 0e0) ELSE 0e0 END"}]
        return stages, "x + _k * _dx", "y + _k * _dy"
    if name == "swirl":
        t = f"(1e0 - _d / {n(p['radius'])})"
        stages = [CENTER, *_radial("_cx", "_cy"), {"_t": f"CASE WHEN _d < {n(p['radius'])} THEN {n(p['angle'])} * {t} * {t} ELSE 0e0 END"}]
        return stages, "_dx * cos(_t) - _dy * sin(_t) + _cx", "_dx * sin(_t) + _dy * cos(_t) + _cy"
    if name == "wave":
        turn = f"{n(p['amplitude'])} * sin({TAU} * {'y' if p['vertical'] else 'x'} / {n(p['wavelength'])})"
        return [], f"x + {turn}" if p["vertical"] else "x * 1e0", "y * 1e0" if p["vertical"] else f"y + {turn}"
    if name == "mesh_warp":
        return [], f"x + {n(p['strength'])} * sin({TAU} * y / {n(p['frequency'])})", f"y + {n(p['strength'])} * sin({TAU} * x / {n(p['frequency'])})"
    if name == "displacement_map":
        return [], f"x + (r - 0.5e0) * {n(p['scale'])}", f"y + (g - 0.5e0) * {n(p['scale'])}"
    if name in ("liquify", "smudge"):
        t = f"(_d / {n(p['radius'])})"
        push = f"CASE WHEN _d < {n(p['radius'])} THEN exp(-2e0 * {t} * {t}) * {n(p['strength'] * p['radius'])} ELSE 0e0 END"
        return [spot(p["center_x"], p["center_y"]), {"_k": push}], f"x - {n(p['direction_x'])} * _k", f"y - {n(p['direction_y'])} * _k"
    if name == "perspective_warp":
        w = f"({n(p['h31'])} * x + {n(p['h32'])} * y + 1e0)"
        at = lambda a, b, c: f"CASE WHEN abs(_w) > 1e-4 THEN ({n(p[a])} * x + {n(p[b])} * y + {n(p[c])}) / nullif(_w, 0e0) ELSE 0e0 END"
        return [{"_w": w}], at("h11", "h12", "h13"), at("h21", "h22", "h23")
    raise KeyError(name)


def _warp(name: str, category: str, example: dict, **spec) -> None:
    def run(rel: Rel, **p) -> Rel:
        stages, sx, sy = places(name, p)
        return tidy(bilinear(rel.steps(*stages), rel, sx, sy))

    plan(name, category, example, **spec)(run)


UNIT, SIGNED = (0.0, 1.0), (-1.0, 1.0)
_warp("barrel", "distortion", {"k1": 0.2, "k2": 0.1}, k1=(0.3, *SIGNED), k2=(0.0, *SIGNED))
_warp("depolar", "distortion", {})
_warp("displacement_map", "distortion", {"scale": 6.0}, scale=(10.0, 0.0, 100.0))
_warp("liquify", "distortion", {"radius": 7.0, "direction_y": 0.5}, center_x=(0.5, *UNIT), center_y=(0.5, *UNIT), radius=(100.0, 1.0, 500.0), strength=(0.5, *UNIT), direction_x=(1.0, *SIGNED), direction_y=(0.0, *SIGNED))
_warp("mesh_warp", "distortion", {"strength": 2.5, "frequency": 9.0}, strength=(10.0, 0.0, 50.0), frequency=(40.0, 1.0, 200.0))
_warp("polar", "distortion", {})
_warp("ripple", "distortion", {"amplitude": 2.0, "wavelength": 7.0}, amplitude=(10.0, 0.0, 50.0), wavelength=(50.0, 1.0, 500.0), center_x=(0.5, *UNIT), center_y=(0.5, *UNIT))
_warp("spherize", "distortion", {"amount": 0.7}, amount=(0.5, *UNIT))
_warp("swirl", "distortion", {"radius": 9.0}, angle=(2.0, -10.0, 10.0), radius=(300.0, 1.0, 2000.0))
_warp("wave", "distortion", {"amplitude": 2.0, "wavelength": 6.0}, amplitude=(10.0, 0.0, 50.0), wavelength=(50.0, 1.0, 500.0), vertical=False)
_warp("smudge", "tool", {"radius": 6.0}, center_x=(0.5, *UNIT), center_y=(0.5, *UNIT), radius=(50.0, 1.0, 500.0), strength=(0.5, *UNIT), direction_x=(0.5, *SIGNED), direction_y=(0.0, *SIGNED))
HOMOGRAPHY = {f"h{i}{j}": (float(i == j), -1000.0, 1000.0) if j == 3 else (float(i == j), -2.0, 2.0) for i in (1, 2) for j in (1, 2, 3)} | {"h31": (0.0, -0.01, 0.01), "h32": (0.0, -0.01, 0.01)}
_warp("perspective_warp", "transform", {"h12": 0.1, "h13": 1.0, "h31": 0.005}, **HOMOGRAPHY)


@plan("perspective_correct", "transform", {"vertical": 0.003}, vertical=(0.0, -0.005, 0.005), horizontal=(0.0, -0.005, 0.005))
def perspective_correct(rel: Rel, vertical: float, horizontal: float) -> Rel:
    warp = OPERATORS["perspective_warp"]
    return warp.plan(rel, **warp.bind({"h31": horizontal, "h32": vertical}))


def homography(source: Sequence[tuple[float, float]], target: Sequence[tuple[float, float]]) -> list[float]:
    """h11 to h32 of the map that takes four target points to four source points, for perspective_warp."""
    import numpy as np

    rows, values = [], []
    for (u, v), (x, y) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    return np.linalg.solve(np.array(rows, float), np.array(values, float)).tolist()


def displace(rel: Rel, places_: Rel) -> Rel:
    """Pixels at the absolute places (image_id, y, x, map_x, map_y) of another relation, bilinear; zero outside the image."""
    out = rel.join(places_.pick("image_id", "y", "x", _x="map_x", _y="map_y"), ["image_id", "y", "x"])
    out = out.let(_in="CASE WHEN _x >= 0e0 AND _y >= 0e0 AND _x <= width - 1 AND _y <= height - 1 THEN 1 ELSE 0 END")
    got = bilinear(out, rel, "CASE WHEN _in = 1 THEN _x ELSE 0e0 END", "CASE WHEN _in = 1 THEN _y ELSE 0e0 END")
    return tidy(got.let(**{c: f"CASE WHEN _in = 1 THEN {c} ELSE 0e0 END" for c in CHANNELS}))


@plan("chromatic_aberration", "effect", {"strength": 3.0}, strength=(5.0, 0.0, 50.0))
def chromatic_aberration(rel: Rel, strength: float) -> Rel:
    """Red is taken from farther out, blue from farther in."""
    far = "greatest(sqrt(width * width / 4e0 + height * height / 4e0), 1e0)"
    out = rel.steps(CENTER, *_radial("_cx", "_cy"), {"_k": f"_d * {n(strength)} / {far} / greatest(_d, 1e0)"})
    out = bilinear(out, rel, "x + _k * _dx", "y + _k * _dy", "r", "_1").drop("_u", "_v")
    return tidy(bilinear(_clear(out), rel, "x - _k * _dx", "y - _k * _dy", "b", "_1").let(r="_1r", b="_1b"))


def _clear(rel: Rel) -> Rel:
    """Without the helper columns of a gather, so that another may follow."""
    return rel.pick(*(c for c in rel.cols if not (c.startswith(("_p", "_u", "_v", "_iu", "_iv", "_du", "_dv")))))


@plan("ca_remove", "tool", {"red_shift": 1.5, "blue_shift": -2.0}, red_shift=(0.0, -5.0, 5.0), blue_shift=(0.0, -5.0, 5.0))
def ca_remove(rel: Rel, red_shift: float, blue_shift: float) -> Rel:
    out = rel.steps(CENTER, *_radial("_cx", "_cy"), {"_k": "_d / sqrt(_cx * _cx + _cy * _cy) / greatest(_d, 1e-3)"})
    out = bilinear(out, rel, f"x + _k * _dx * {n(red_shift)}", f"y + _k * _dy * {n(red_shift)}", "r", "_1")
    return tidy(bilinear(_clear(out), rel, f"x + _k * _dx * {n(blue_shift)}", f"y + _k * _dy * {n(blue_shift)}", "b", "_1").let(r="_1r", b="_1b"))


def _stamp(rel: Rel, center_x: float, center_y: float, offset_x: float, offset_y: float) -> Rel:
    """Columns _d, the distance from the spot, and _1r to _1a, the pixel at the offset."""
    return bilinear(rel.let(**spot(center_x, center_y)), rel, f"x + {n(offset_x)} * width", f"y + {n(offset_y)} * height", CHANNELS, "_1")


OFFSET = {"offset_x": (0.1, *SIGNED), "offset_y": (0.0, *SIGNED)}


@plan("clone_stamp", "tool", {"radius": 7.0, "offset_x": 0.3, "opacity": 0.8}, **SPOT, **OFFSET, opacity=(1.0, *UNIT))
def clone_stamp(rel: Rel, center_x: float, center_y: float, offset_x: float, offset_y: float, radius: float, opacity: float) -> Rel:
    k = f"CASE WHEN _d < {n(radius)} THEN {n(opacity)} * (1e0 - {smoothstep(n(radius * 0.7), n(radius), '_d')}) ELSE 0e0 END"
    return tidy(_stamp(rel, center_x, center_y, offset_x, offset_y).let(_k=k).let(**{c: f"{c} * (1e0 - _k) + _1{c} * _k" for c in "rgb"}))


@plan("healing_brush", "tool", {"radius": 7.0, "offset_x": 0.3}, **SPOT, **OFFSET)
def healing_brush(rel: Rel, center_x: float, center_y: float, offset_x: float, offset_y: float, radius: float) -> Rel:
    luma = lambda p: f"({p}r * 0.2126e0 + {p}g * 0.7152e0 + {p}b * 0.0722e0)"
    k = f"CASE WHEN _d < {n(radius)} THEN 1e0 - {smoothstep(n(radius * 0.5), n(radius), '_d')} ELSE 0e0 END"
    out = _stamp(rel, center_x, center_y, offset_x, offset_y).let(_k=k, _q=f"{luma('')} / greatest({luma('_1')}, 1e-3)")
    return tidy(out.let(**{c: f"{c} * (1e0 - _k) + _1{c} * _q * _k" for c in "rgb"}))


def reflected(e: str, size: str) -> str:
    """An integer place mirrored at the border without repeating it."""
    return f"CASE WHEN {e} < 0 THEN least(-({e}), {size} - 1) WHEN {e} >= {size} THEN greatest(2 * {size} - ({e}) - 2, 0) ELSE {e} END"


@plan("chromatic_split", "effect", {"red_dx": 2.0, "blue_dy": -3.0}, **{f"{c}_{d}": (0.0, -100.0, 100.0) for c in ("red", "green", "blue") for d in ("dx", "dy")})
def chromatic_split(rel: Rel, **p: float) -> Rel:
    out = rel
    for c, name in zip("rgb", ("red", "green", "blue"), strict=True):
        step = {k: int(math.copysign(math.floor(abs(p[f"{name}_{k}"]) + 0.5), p[f"{name}_{k}"])) for k in ("dx", "dy")}
        out = nearest(out, rel, reflected(f"(x + {step['dx']})", "width"), reflected(f"(y + {step['dy']})", "height"), c).drop("_sx", "_sy", f"_n{c}")
    return out


@plan("pattern_fill", "generator", {"tile_w": 5.0, "tile_h": 4.0, "offset_x": 0.5}, tile_w=(64.0, 4.0, 512.0), tile_h=(64.0, 4.0, 512.0), offset_x=(0.0, *UNIT), offset_y=(0.0, *UNIT))
def pattern_fill(rel: Rel, tile_w: float, tile_h: float, offset_x: float, offset_y: float) -> Rel:
    u, v = f"(x + {n(offset_x * tile_w)})", f"(y + {n(offset_y * tile_h)})"
    sx, sy = (f"least({whole(f'{e} - {n(t)} * floor({e} / {n(t)})')}, {size} - 1)" for e, t, size in ((u, tile_w, "width"), (v, tile_h, "height")))
    return tidy(nearest(rel, rel, sx, sy))


