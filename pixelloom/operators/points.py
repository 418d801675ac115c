"""Operators on single pixels."""

from __future__ import annotations

import colorsys
import math

from pixelloom.functions import matrices as mx
from pixelloom.functions.curves import hermite, hue_points, tone_points
from pixelloom.functions.sql import HSL, LUMA, clamp, each, from_hsl, half_up, lerp, linear, mod, n, power, smoothstep
from pixelloom.plans.registry import Param, plan, point
from pixelloom.plans.rel import Rel

UNIT, SIGNED = (0.0, 1.0), (-1.0, 1.0)
TO_RAD = math.pi / 180

# adjustment


@point("brightness", "adjustment", {"amount": 0.1}, space="acescct", amount=(0.0, *SIGNED))
def _(amount):
    return each(f"{{v}} + {n(amount)}")


@point("burn", "adjustment", {"amount": 0.7}, amount=(0.5, 0.0, 2.0))
def _(amount):
    return each(f"1e0 - (1e0 - {{v}}) / {n(max(amount, 1e-6))}")


@point("contrast", "adjustment", {"amount": 0.3}, amount=(0.0, *SIGNED))
def _(amount):
    return each(f"({{v}} - 0.5e0) * {n(1 + amount)} + 0.5e0")


@point("dodge", "adjustment", {"amount": 0.3}, amount=(0.5, *UNIT))
def _(amount):
    return each(f"{{v}} / {n(max(1 - amount, 1e-6))}")


@point("exposure", "adjustment", {"ev": 0.7}, ev=(0.0, -10.0, 10.0))
def _(ev):
    return each(f"{{v}} * {n(2.0**ev)}")


@point("gamma", "adjustment", {"gamma": 2.2}, gamma=(1.0, 0.1, 10.0))
def _(gamma):
    return each(power("{v}", n(1 / gamma)))


@point("invert", "adjustment")
def _():
    return each("1e0 - {v}")


@point("levels", "adjustment", {"black": 0.1, "white": 0.9, "gamma": 1.5}, black=(0.0, *UNIT), white=(1.0, *UNIT), gamma=(1.0, 0.1, 10.0))
def _(black, white, gamma):
    return each(power(f"({{v}} - {n(black)}) / {n(max(white - black, 1e-6))}", n(1 / gamma)))


@point("posterize", "adjustment", {"levels": 5}, levels=(4, 2, 255))
def _(levels):
    return each(f"least(floor({{v}} * {n(levels)}), {n(levels - 1)}) / {n(max(levels - 1, 1))}")


@point("sigmoidal_contrast", "adjustment", {"strength": 4.0, "midpoint": 0.4}, strength=(3.0, 0.0, 20.0), midpoint=(0.5, *UNIT), sharpen=True)
def _(strength, midpoint, sharpen):
    if strength < 1e-6:
        return each("{v}")
    sig = lambda v: 1 / (1 + math.exp(-strength * (v - midpoint)))
    low, span = sig(0.0), sig(1.0) - sig(0.0)
    if sharpen:
        return each(f"(1e0 / (1e0 + exp({n(-strength)} * ({{v}} - {n(midpoint)}))) - {n(low)}) / {n(span)}")
    scaled = clamp(f"{{v}} * {n(span)} + {n(low)}", 1e-7, 1 - 1e-7)
    return each(f"{n(midpoint)} - ln(1e0 / {scaled} - 1e0) / {n(strength)}")


@point("solarize", "adjustment", {"threshold": 0.6}, threshold=(0.5, *UNIT))
def _(threshold):
    return each(f"CASE WHEN {{v}} - {n(threshold)} > 0e0 THEN 1e0 - {{v}} ELSE {{v}} END")


@point("threshold_binary", "adjustment", {"threshold": 0.4}, threshold=(0.5, *UNIT))
def _(threshold):
    return each(f"CASE WHEN {LUMA} >= {n(threshold)} THEN 1e0 ELSE 0e0 END")


# evaluate

for _name, _form, _spec, _example in (
    ("abs", "abs({v})", None, None),
    ("add", "{v} + {p}", (0.0, *SIGNED), 0.2),
    ("divide", "{v} / {p}", (1.0, 0.01, 4.0), 1.7),
    ("log", "ln(1e0 + greatest({v}, 0e0)) * {p}", (1.0, 0.1, 10.0), 1.4),
    ("max", "greatest({v}, {p})", (0.0, *UNIT), 0.3),
    ("min", "least({v}, {p})", (1.0, *UNIT), 0.6),
    ("multiply", "{v} * {p}", (1.0, 0.0, 4.0), 1.3),
    ("pow", "pow(greatest({v}, 0e0), {p})", (1.0, 0.1, 5.0), 1.8),
    ("subtract", "{v} - {p}", (0.0, *SIGNED), 0.2),
):
    _key = {"log": "scale", "max": "threshold", "min": "threshold", "pow": "exponent"}.get(_name, "value")

    def _one(_form=_form, **params):
        return each(_form.replace("{p}", n(next(iter(params.values()), 0.0))))

    point(f"evaluate_{_name}", "evaluate", {_key: _example} if _spec else None, **({_key: _spec} if _spec else {}))(_one)


# colour spaces


def transfer(kind: str) -> str:
    """Transfer curves by name, {v} standing for the channel."""
    log2 = lambda e: f"(ln({e}) / {n(math.log(2))})"
    exp2 = "pow(2e0, {v} * 17.52e0 - 9.72e0)"
    cc = lambda e: f"({log2(e)} + 9.72e0) / 17.52e0"
    return {
        "srgb_to_linear": "CASE WHEN {v} <= 0.04045e0 THEN {v} / 12.92e0 ELSE pow(greatest(({v} + 0.055e0) / 1.055e0, 0e0), 2.4e0) END",
        "linear_to_srgb": f"CASE WHEN {{v}} <= 0.0031308e0 THEN {{v}} * 12.92e0 ELSE 1.055e0 * pow(greatest({{v}}, 0e0), {n(1 / 2.4)}) - 0.055e0 END",
        "linear_to_acescct": f"CASE WHEN {{v}} <= 0.0078125e0 THEN 10.540237e0 * {{v}} + 0.07290553e0 ELSE {cc('greatest({v}, 0.0078125e0)')} END",
        "acescct_to_linear": f"CASE WHEN {{v}} <= 0.15525115e0 THEN ({{v}} - 0.07290553e0) / 10.540237e0 ELSE {exp2} END",
        "linear_to_acescc": f"CASE WHEN {{v}} <= 0e0 THEN {n((9.72 - 16) / 17.52)} WHEN {{v}} < {n(2.0**-15)} THEN {cc(f'greatest({n(2.0**-16)} + {{v}} * 0.5e0, 1e-30)')} ELSE {cc(f'greatest({{v}}, {n(2.0**-15)})')} END",
        "acescc_to_linear": f"CASE WHEN {{v}} <= {n((9.72 - 15) / 17.52)} THEN ({exp2} - {n(2.0**-16)}) * 2e0 ELSE {exp2} END",
        "rec709_display": f"pow(greatest({{v}}, 0e0), {n(1 / 2.4)})",
        "arri-logc3": "CASE WHEN {v} > 0.149658405705e0 THEN (pow(1e1, ({v} - 0.385537e0) / 0.24719e0) - 0.052272e0) / 5.555556e0 ELSE ({v} - 0.092809e0) / 5.367655e0 END",
        "arri-logc4": "CASE WHEN {v} >= 0.01524e0 THEN (pow(2e0, ({v} - 0.074e0) * 7e0) - 64e0) / 2231.826309e0 ELSE ({v} - 0.074e0) * 7e0 / 2231.826309e0 END",
        "red-ipp2": "CASE WHEN {v} < 0e0 THEN {v} / 15.1927e0 - 0.01e0 ELSE (pow(1e1, {v} / 0.224282e0) - 1e0) / 155.975327e0 - 0.01e0 END",
        "bmd-gen5": f"CASE WHEN 0.5e0 + ln(greatest({{v}} * 8.283064e0 + 0.09246575e0, 1e-10)) / {n(math.log(8.283064))} > 0.005e0 THEN 0.5e0 + ln(greatest({{v}} * 8.283064e0 + 0.09246575e0, 1e-10)) / {n(math.log(8.283064))} ELSE ({{v}} - 0.005494e0) / 10.44426e0 END",
        "sony-slog3": f"CASE WHEN {{v}} >= {n(171.2102946929 / 1023)} THEN pow(1e1, ({{v}} * 1023e0 - 420e0) / 261.5e0) * 0.19e0 - 0.01e0 ELSE ({{v}} * 1023e0 - 95e0) * 0.01125e0 / {n(171.2102946929 - 95)} END",
    }[kind]


def times(m) -> dict[str, str]:
    return dict(zip("rgb", linear(m, "rgb"), strict=True))


#: Steps from and to linear sRGB for each managed space; spaces that aren't managed pass through.
FROM_LINEAR = {
    "linear": [], "srgb": ["linear_to_srgb"], "acescg": [mx.SRGB_TO_ACESCG], "acescct": [mx.SRGB_TO_ACESCG, "linear_to_acescct"],
    "acescc": [mx.SRGB_TO_ACESCG, "linear_to_acescc"], "aces2065_1": [mx.AP1_TO_AP0 @ mx.SRGB_TO_ACESCG], "display_p3": [], "rec709": [], "rec2020": [], "unknown": [],
}
TO_LINEAR = {
    "linear": [], "srgb": ["srgb_to_linear"], "acescg": [mx.ACESCG_TO_SRGB], "acescct": ["acescct_to_linear", mx.ACESCG_TO_SRGB],
    "acescc": ["acescc_to_linear", mx.ACESCG_TO_SRGB], "aces2065_1": [mx.ACESCG_TO_SRGB @ mx.AP0_TO_AP1], "display_p3": [], "rec709": [], "rec2020": [], "unknown": [],
}


#: Input transforms by name: colour spaces from which and to which they convert.
INPUTS = {"idt-srgb": ("srgb", "acescg"), "idt-rec709": ("rec709", "acescg"), "idt-rec2020": ("rec2020", "acescg"), "idt-p3": ("display_p3", "acescg"), "csc-acescg-to-cct": ("acescg", "acescct"), "csc-acescct-to-cg": ("acescct", "acescg"), "identity": ("linear", "linear")}


def conversion(source: str, target: str) -> list[dict[str, str]]:
    """Stages from one colour space to another, through linear sRGB."""
    if source == target:
        return []
    return [each(transfer(s)) if isinstance(s, str) else times(s) for s in (*TO_LINEAR[source], *FROM_LINEAR[target])]


@point("convert_color_space", "colour management", {"source": "srgb", "target": "acescc"}, source="linear", target="srgb")
def _(source, target):
    return conversion(source, target)


@point("color_transform", "colour management", {"preset": "idt-rec709"}, preset="identity")
def _(preset):
    """A transform by its name: inputs, conversions, and cameras as idt-<camera>."""
    if preset.removeprefix("idt-") in mx.CAMERA:
        camera = preset.removeprefix("idt-")
        return [each(transfer(camera)), times(mx.CAMERA[camera])]
    return conversion(*INPUTS[preset])


@point("aces_cct_to_cg", "color")
def _():
    return conversion("acescct", "acescg")


@point("aces_cg_to_cct", "color")
def _():
    return conversion("acescg", "acescct")


@point("aces_idt", "color", {"source": 0.0}, source=(0.0, 0.0, 3.0))
def _(source):
    return conversion("linear" if int(source) == 1 else "srgb", "acescct")


@point("aces_odt", "color", {"target": 0.0}, target=(0.0, 0.0, 3.0))
def _(target):
    return conversion("acescct", "linear" if int(target) == 1 else "srgb")


@point("view_transform", "colour management", {"view": "rec709"}, view="srgb")
def _(view):
    """Linear to display: srgb, linear or rec709 (gamma 2.4)."""
    return {"srgb": each(transfer("linear_to_srgb")), "linear": each("{v}"), "rec709": each(transfer("rec709_display"))}[view]


@point("camera_idt", "colour management", {"camera": "sony-slog3"}, camera="arri-logc3")
def _(camera):
    """Camera log to ACEScg."""
    return [each(transfer(camera)), times(mx.CAMERA[camera])]


# Lab and OKLab

_LAB_F = "CASE WHEN {v} > 0.008856451679035631e0 THEN cbrt({v}) ELSE {v} / 0.12841854934601665e0 + 0.13793103448275862e0 END"
_LAB_G = "CASE WHEN {v} > 0.20689655172413793e0 THEN {v} * {v} * {v} ELSE 0.12841854934601665e0 * ({v} - 0.13793103448275862e0) END"


def to_lab() -> list[dict[str, str]]:
    """Columns _L, _A, _B of a linear sRGB pixel."""
    xyz = [f"{e} / {n(w)}" for e, w in zip(linear(mx.SRGB_TO_XYZ_SHORT, "rgb"), mx.D65_WHITE, strict=True)]
    return [
        dict(zip(("_fx", "_fy", "_fz"), xyz, strict=True)),
        each(_LAB_F, "_fx", "_fy", "_fz"),
        {"_ll": "116e0 * _fy - 16e0", "_aa": "500e0 * (_fx - _fy)", "_bb": "200e0 * (_fy - _fz)"},
    ]


def from_lab(l: str = "_ll", a: str = "_aa", b: str = "_bb") -> list[dict[str, str]]:
    return [
        {"_ll": l, "_aa": a, "_bb": b},
        {"_fy": "(_ll + 16e0) / 116e0"},
        {"_fx": "_aa / 500e0 + _fy", "_fz": "_fy - _bb / 200e0"},
        each(_LAB_G, "_fx", "_fy", "_fz"),
        {"_fx": f"_fx * {n(mx.D65_WHITE[0])}", "_fz": f"_fz * {n(mx.D65_WHITE[2])}"},
        dict(zip("rgb", linear(mx.XYZ_TO_SRGB_SHORT, ("_fx", "_fy", "_fz")), strict=True)),
    ]


@point("lab_adjust", "color", {"a_offset": 20.0, "b_offset": -15.0}, a_offset=(0.0, -128.0, 127.0), b_offset=(0.0, -128.0, 127.0))
def _(a_offset, b_offset):
    return [*to_lab(), *from_lab(a=clamp(f"_aa + {n(a_offset)}", -128, 127), b=clamp(f"_bb + {n(b_offset)}", -128, 127))]


@point("saturate", "color", {"factor": 1.6}, factor=(1.0, 0.0, 3.0))
def _(factor):
    """Chroma of OKLCH; scaling a and b keeps the hue."""
    return [
        dict(zip(("_lc", "_mc", "_sc"), (f"cbrt(greatest({e}, 0e0))" for e in linear(mx.OKLAB_TO_CONES, "rgb")), strict=True)),
        dict(zip(("_ol", "_oa", "_ob"), linear(mx.OKLAB_FROM_CONES, ("_lc", "_mc", "_sc")), strict=True)),
        {"_oa": f"_oa * {n(factor)}", "_ob": f"_ob * {n(factor)}"},
        dict(zip(("_lc", "_mc", "_sc"), linear(mx.CONES_FROM_OKLAB, ("_ol", "_oa", "_ob")), strict=True)),
        each("{v} * {v} * {v}", "_lc", "_mc", "_sc"),
        dict(zip("rgb", linear(mx.SRGB_FROM_CONES, ("_lc", "_mc", "_sc")), strict=True)),
    ]


# colour


@point("colorize", "color", {"amount": 0.6}, target_r=(1.0, *UNIT), target_g=(0.8, *UNIT), target_b=(0.6, *UNIT), amount=(0.5, *UNIT))
def _(amount, **target):
    return [{"_y": LUMA}, {c: f"{c} + (_y * {n(target['target_' + c])} - {c}) * {n(amount)}" for c in "rgb"}]


@point("hue_rotate", "color", {"degrees": 100.0}, degrees=(0.0, 0.0, 360.0))
def _(degrees):
    return [*HSL, *from_hsl(h=mod(f"_h + {n(degrees)}", "360e0"))]


@point("modulate", "color", {"brightness": 1.2, "saturation": 0.7, "hue": 40.0}, brightness=(1.0, 0.0, 3.0), saturation=(1.0, 0.0, 3.0), hue=(0.0, 0.0, 360.0))
def _(brightness, saturation, hue):
    return [*HSL, *from_hsl(mod(f"_h + {n(hue)}", "360e0"), clamp(f"_s * {n(saturation)}"), f"_l * {n(brightness)}")]


@point("photo_filter", "color", {"density": 0.4, "preserve_luminosity": True}, color_r=(1.0, *UNIT), color_g=(0.6, *UNIT), color_b=(0.2, *UNIT), density=(0.25, *UNIT), preserve_luminosity=False)
def _(density, preserve_luminosity, **color):
    stages = [{"_y": LUMA}, {c: lerp(c, n(color["color_" + c]), n(density)) for c in "rgb"}]
    if preserve_luminosity:
        stages += [{"_k": f"CASE WHEN {LUMA} > 1e-7 THEN _y / {LUMA} ELSE 1e0 END"}, each("{v} * _k")]
    return stages


def _hue_distance(center: float) -> str:
    d = f"abs(_h - {n(center)})"
    return f"CASE WHEN {d} > 180e0 THEN 360e0 - {d} ELSE {d} END"


@point(
    "replace_color", "color", {"center_hue": 90.0, "hue_range": 120.0, "hue_shift": 40.0, "sat_shift": 0.1, "lum_shift": -0.1},
    center_hue=(0.0, 0.0, 360.0), hue_range=(30.0, 1.0, 180.0), sat_min=(0.0, *UNIT), sat_max=(1.0, *UNIT), lum_min=(0.0, *UNIT), lum_max=(1.0, *UNIT),
    hue_shift=(0.0, -180.0, 180.0), sat_shift=(0.0, *SIGNED), lum_shift=(0.0, *SIGNED),
)
def _(center_hue, hue_range, sat_min, sat_max, lum_min, lum_max, hue_shift, sat_shift, lum_shift):
    half = n(hue_range * 0.5)
    weight = f"CASE WHEN _s < {n(sat_min)} OR _s > {n(sat_max)} OR _l < {n(lum_min)} OR _l > {n(lum_max)} OR _d >= {half} THEN 0e0 ELSE 0.5e0 * (1e0 + cos(_d / {half} * {n(math.pi)})) END"
    shifted = from_hsl(mod(f"_h + {n(hue_shift)} * _w", "360e0"), clamp(f"_s + {n(sat_shift)} * _w"), clamp(f"_l + {n(lum_shift)} * _w"))
    return [*HSL, {"_d": _hue_distance(center_hue), "_r": "r", "_g": "g", "_b": "b"}, {"_w": weight}, *shifted, {c: f"CASE WHEN _w > 0e0 THEN {c} ELSE _{c} END" for c in "rgb"}]


@point(
    "selective_color", "color", {"target_hue": 120.0, "hue_range": 160.0, "hue_shift": 30.0, "saturation": 1.4, "lightness": 0.1},
    target_hue=(0.0, 0.0, 360.0), hue_range=(30.0, 1.0, 180.0), hue_shift=(0.0, -180.0, 180.0), saturation=(1.0, 0.0, 3.0), lightness=(0.0, *SIGNED),
)
def _(target_hue, hue_range, hue_shift, saturation, lightness):
    half = n(hue_range * 0.5)
    weight = f"CASE WHEN _d >= {half} THEN 0e0 ELSE 0.5e0 * (1e0 + cos(_d / {half} * {n(math.pi)})) END"
    shifted = from_hsl(mod(f"_h + {n(hue_shift)} * _w", "360e0"), clamp(f"_s * (1e0 + {n(saturation - 1)} * _w)"), clamp(f"_l + {n(lightness)} * _w"))
    return [*HSL, {"_d": _hue_distance(target_hue), "_r": "r", "_g": "g", "_b": "b"}, {"_w": weight}, *shifted, {c: f"CASE WHEN _w > 0e0 THEN {c} ELSE _{c} END" for c in "rgb"}]


@point("saturate_hsl", "color", {"factor": 1.7}, factor=(1.0, 0.0, 3.0))
def _(factor):
    return [*HSL, *from_hsl(s=clamp(f"_s * {n(factor)}"))]


@point("sepia", "color", {"intensity": 0.8}, intensity=(1.0, *UNIT))
def _(intensity):
    return {c: f"{n(1 - intensity)} * {c} + {n(intensity)} * {e}" for c, e in zip("rgb", linear(mx.SEPIA, "rgb"), strict=True)}


@point("vibrance", "color", {"amount": 60.0}, amount=(0.0, -100.0, 100.0))
def _(amount):
    flat = "CASE WHEN _mx > 1e-7 THEN 1e0 - (_mx - _mn) / _mx ELSE 1e0 END"
    return [*HSL, {"_k": flat}, *from_hsl(s=clamp(f"_s * (1e0 + {n(amount / 100)} * _k)"))]


@point("white_balance_temperature", "color", {"temperature": 4800.0, "tint": 0.2}, temperature=(6500.0, 2000.0, 12000.0), tint=(0.0, *SIGNED))
def _(temperature, tint):
    return times(mx.adaptation(mx.tinted(mx.daylight_xy(temperature), tint), mx.D65_XY))


@point("channel_mixer", "color", {"matrix": ((0.8, 0.1, 0.1), (0.2, 0.7, 0.1), (0.0, 0.3, 0.7))}, matrix=Param(None))
def _(matrix):
    return times(matrix or ((1, 0, 0), (0, 1, 0), (0, 0, 1)))


@point("gradient_map", "color", {"stops": ((0.0, 0.1, 0.0, 0.3), (0.4, 0.9, 0.3, 0.1), (1.0, 1.0, 1.0, 0.8))}, stops=Param(((0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0))))
def _(stops):
    """Luma to the colour of a gradient, at 256 steps."""
    at = f"({half_up(clamp(LUMA) + ' * 255e0')} / 255e0)"
    out = {}
    for k, c in enumerate("rgb", 1):
        parts = [f"WHEN _t <= {n(stops[0][0])} THEN {n(stops[0][k])}"]
        for p, q in zip(stops, stops[1:], strict=False):
            parts.append(f"WHEN _t <= {n(q[0])} THEN {lerp(n(p[k]), n(q[k]), f'((_t - {n(p[0])}) / {n(max(q[0] - p[0], 1e-6))})')}")
        out[c] = f"CASE {' '.join(parts)} ELSE {n(stops[-1][k])} END"
    return [{"_t": at}, out]


# alpha, masks


@point("add_alpha", "alpha", {"alpha": 0.4}, alpha=(1.0, *UNIT))
def _(alpha):
    return {"a": n(alpha)}


@point("remove_alpha", "alpha")
def _():
    return {"a": "1e0"}


@point("flatten", "alpha", {"bg_g": 0.5}, bg_r=(1.0, *UNIT), bg_g=(1.0, *UNIT), bg_b=(1.0, *UNIT))
def _(**bg):
    return {c: f"{n(bg['bg_' + c])} + a * ({c} - {n(bg['bg_' + c])})" for c in "rgb"} | {"a": "1e0"}


@point("color_range", "mask", {"threshold": 0.3}, target_r=(0.5, *UNIT), target_g=(0.5, *UNIT), target_b=(0.5, *UNIT), threshold=(0.2, *UNIT), softness=(0.1, 0.0, 0.5))
def _(threshold, softness, **target):
    d = "sqrt(" + " + ".join(f"({c} - {n(target['target_' + c])}) * ({c} - {n(target['target_' + c])})" for c in "rgb") + ")"
    soft = f"1e0 - {smoothstep(n(threshold), n(threshold + softness), '_d')}"
    return [{"_d": d}, {"a": soft if softness > 0 else f"CASE WHEN _d <= {n(threshold)} THEN 1e0 ELSE 0e0 END"}]


@point("gradient_mask", "mask", {"start": 0.2, "end": 0.9}, start=(0.0, *UNIT), end=(1.0, *UNIT), vertical=False)
def _(start, end, vertical):
    t = "y * 1e0 / greatest(height - 1, 1)" if vertical else "x * 1e0 / greatest(width - 1, 1)"
    return {"a": f"{n(start)} + {t} * {n(end - start)}"}


@point("luminance_range", "mask", {"low": 0.3, "high": 0.7}, low=(0.2, *UNIT), high=(0.8, *UNIT), softness=(0.05, 0.0, 0.5))
def _(low, high, softness):
    step = lambda e: smoothstep(n(e - max(softness, 1e-9)), n(e + max(softness, 1e-9)), "_y")
    return [{"_y": LUMA}, {"a": f"{step(low)} * (1e0 - {step(high)})"}]


@point("mask_apply", "mask")
def _():
    return each("{v} * a")


@point("mask_combine", "mask", {"mode": 1}, mode=(0, 0, 4))
def _(mode):
    return {"a": [f"a * {LUMA}", f"least(a + {LUMA}, 1e0)", f"least(a, {LUMA})", f"greatest(a, {LUMA})", LUMA][mode]}


@point("masked_blend", "mask", {"blend_r": 0.6}, blend_r=(0.0, *UNIT), blend_g=(0.0, *UNIT), blend_b=(0.0, *UNIT))
def _(**blend):
    return {c: f"{n(blend['blend_' + c])} + a * ({c} - {n(blend['blend_' + c])})" for c in "rgb"} | {"a": "1e0"}


# grading


def _by_channel(*names_defaults):
    return {f"{k}_{c}": v for k, v in names_defaults for c in "rgb"}


@point(
    "asc_cdl", "grading", {"slope_r": 1.2, "offset_g": 0.05, "power_b": 1.3, "saturation": 0.8}, space="acescct",
    **_by_channel(("slope", (1.0, 0.0, 4.0)), ("offset", (0.0, *SIGNED)), ("power", (1.0, 0.1, 4.0))), saturation=(1.0, 0.0, 4.0),
)
def _(saturation, **p):
    graded = {c: power(f"{c} * {n(p['slope_' + c])} + {n(p['offset_' + c])}", n(p["power_" + c])) for c in "rgb"}
    return [graded, {"_y": LUMA}, each(f"_y + ({{v}} - _y) * {n(saturation)}")]


@point(
    "lift_gamma_gain", "grading", {"lift_r": 0.1, "gamma_g": 1.4, "gain_b": 0.8},
    **_by_channel(("lift", (0.0, -0.5, 0.5)), ("gamma", (1.0, 0.1, 4.0)), ("gain", (1.0, 0.0, 4.0))),
)
def _(**p):
    return {c: f"{n(p['gain_' + c])} * {power(f'{c} + {n(p["lift_" + c])} * (1e0 - {c})', n(1 / p['gamma_' + c]))}" for c in "rgb"}


TONE = dict.fromkeys(("shadows", "midtones", "highlights"), (0.0, *SIGNED))
for _suffix, _channels in (("master", "rgb"), ("red", "r"), ("green", "g"), ("blue", "b")):

    def _curve(_channels=_channels, **p):
        """A curve through five points, read at 4,096 steps."""
        points = tone_points(**p)
        return [{f"_{c}": f"{half_up(clamp(c) + ' * 4095e0')} / 4095e0" for c in _channels}, {c: hermite(points, "_" + c) for c in _channels}]

    point(f"curves_{_suffix}", "grading", {"shadows": 0.4, "midtones": -0.3, "highlights": 0.2}, space="acescct", **TONE)(_curve)

HUE = {"center": (0.0, 0.0, 360.0), "amount": (0.0, *SIGNED), "width": (60.0, 10.0, 180.0)}


@point("hue_vs_sat", "grading", {"center": 60.0, "amount": -0.7}, **HUE)
def _(center, amount, width):
    return [*HSL, {"_i": f"least({half_up('_h')}, 359e0) / 359e0"}, *from_hsl(s=clamp(f"_s * 2e0 * ({hermite(hue_points(center, amount, width), '_i')})"))]


@point("hue_vs_lum", "grading", {"center": 60.0, "amount": -0.7}, **HUE)
def _(center, amount, width):
    return [*HSL, {"_i": f"least({half_up('_h')}, 359e0) / 359e0"}, *from_hsl(l=clamp(f"_l + 2e0 * (({hermite(hue_points(center, amount, width), '_i')}) - 0.5e0)"))]


for _name, _by in (("lum_vs_sat", "_l"), ("sat_vs_sat", "_s")):

    def _curve(_by=_by, **p):
        return [*HSL, {"_i": f"{half_up(clamp(_by) + ' * 255e0')} / 255e0"}, *from_hsl(s=clamp(f"_s * 2e0 * ({hermite(tone_points(**p), '_i')})"))]

    point(_name, "grading", {"shadows": 0.4, "midtones": -0.3, "highlights": 0.2}, **TONE)(_curve)


@point(
    "split_toning", "grading", {"shadow_hue": 220.0, "highlight_hue": 40.0, "shadow_strength": 0.6, "highlight_strength": 0.4},
    shadow_hue=(220.0, 0.0, 360.0), highlight_hue=(40.0, 0.0, 360.0), shadow_strength=(0.0, *UNIT), highlight_strength=(0.0, *UNIT),
)
def _(shadow_hue, highlight_hue, shadow_strength, highlight_strength):
    """Tints below and above a luma of 0.75; both strengths count as their mean."""
    dark, light = colorsys.hls_to_rgb(shadow_hue / 360 % 1, 0.3, 0.7), colorsys.hls_to_rgb(highlight_hue / 360 % 1, 0.7, 0.7)
    strength = n((shadow_strength + highlight_strength) / 2)
    weights = {"_u": f"{clamp('1e0 - _y / 0.75e0')} * {strength}", "_w": f"{clamp('(_y - 0.75e0) / 0.25e0')} * {strength}"}
    return [{"_y": LUMA}, weights, {c: f"{c} + ({n(dark[k])} - {c}) * _u + ({n(light[k])} - {c}) * _w" for k, c in enumerate("rgb")}]


@point("tonemap_drago", "grading", {"l_max": 4.0, "bias": 0.8}, l_max=(1.0, 0.0, 100.0), bias=(0.85, 0.5, 1.0))
def _(l_max, bias):
    exponent = 1 / max(math.log(bias) / math.log(0.5), 0.01)
    return each(f"CASE WHEN {{v}} <= 0e0 THEN 0e0 ELSE pow(ln(1e0 + greatest({{v}}, 0e0)) / {n(max(math.log(1 + l_max), 1e-30))}, {n(exponent)}) END")


@point("tonemap_filmic", "grading", None, a=(2.51, 0.0, 10.0), b=(0.03, *UNIT), c=(2.43, 0.0, 10.0), d=(0.59, 0.0, 2.0), e=(0.14, *UNIT))
def _(a, b, c, d, e):
    return each(f"{{v}} * ({n(a)} * {{v}} + {n(b)}) / ({{v}} * ({n(c)} * {{v}} + {n(d)}) + {n(e)})")


@point("tonemap_reinhard", "grading")
def _():
    return each("{v} / (1e0 + {v})")


# enhancement, effects and tools by coordinate


@point("vignette_powerlaw", "enhancement", {"strength": 0.7, "falloff": 1.5}, strength=(0.5, *UNIT), falloff=(2.0, 0.5, 5.0))
def _(strength, falloff):
    far = "sqrt((x - width / 2e0) * (x - width / 2e0) + (y - height / 2e0) * (y - height / 2e0)) / sqrt(width * width / 4e0 + height * height / 4e0)"
    return [{"_k": f"greatest(1e0 - {n(strength)} * pow({far}, {n(falloff)}), 0e0)"}, each("{v} * _k")]


@point("light_leak", "effect", {"position_x": 0.2, "radius": 0.8}, intensity=(0.5, *UNIT), position_x=(0.5, *UNIT), position_y=(0.5, *UNIT), radius=(0.5, 0.0, 2.0), warmth=(0.8, *UNIT))
def _(intensity, position_x, position_y, radius, warmth):
    dx, dy = f"(x - {n(position_x)} * width)", f"(y - {n(position_y)} * height)"
    near = f"greatest(1e0 - sqrt({dx} * {dx} + {dy} * {dy}) / ({n(radius)} * greatest(width, height)), 0e0)" if radius > 0 else "1e0"
    warm, cold = {"r": 1.0, "g": 0.6, "b": 0.2}, {"r": 0.8, "g": 0.4, "b": 0.1}
    return [{"_f": near}, {c: f"{c} + {n(warm[c] * warmth + cold[c] * (1 - warmth))} * {n(intensity)} * _f * _f * (1e0 - {c})" for c in "rgb"}]


@point(
    "sparse_color", "effect", {"strength": 0.7}, x1=(0.0, *UNIT), y1=(0.0, *UNIT), r1=(1.0, *UNIT), g1=(0.0, *UNIT), b1=(0.0, *UNIT),
    x2=(1.0, *UNIT), y2=(1.0, *UNIT), r2=(0.0, *UNIT), g2=(0.0, *UNIT), b2=(1.0, *UNIT), strength=(0.5, *UNIT),
)
def _(strength, **p):
    return shepard([(p["x1"], p["y1"], p["r1"], p["g1"], p["b1"]), (p["x2"], p["y2"], p["r2"], p["g2"], p["b2"])], strength)


def shepard(points, strength: float) -> list[dict[str, str]]:
    """Inverse-square interpolation between points (x, y, r, g, b) in unit coordinates."""
    weights = {}
    for i, (px, py, *_) in enumerate(points):
        dx, dy = f"(x * 1e0 / width - {n(px)})", f"(y * 1e0 / height - {n(py)})"
        weights[f"_w{i}"] = f"1e0 / greatest({dx} * {dx} + {dy} * {dy}, 1e-6)"
    total = " + ".join(weights)
    mixed = {c: "(" + " + ".join(f"_w{i} * {n(q[2 + k])}" for i, q in enumerate(points)) + f") / ({total})" for k, c in enumerate("rgb")}
    return [weights, {c: lerp(c, mixed[c], n(strength)) for c in "rgb"}]


@point("sparse_color_points", "color", {"points": ((0.1, 0.2, 1.0, 0.0, 0.0), (0.8, 0.3, 0.0, 1.0, 0.0), (0.5, 0.9, 0.0, 0.0, 1.0))}, points=Param(()), strength=(1.0, *UNIT))
def _(points, strength):
    return shepard(points, strength) if points else each("{v}")


SPOT = {"center_x": (0.5, *UNIT), "center_y": (0.5, *UNIT), "radius": (50.0, 1.0, 500.0)}


def spot(center_x: float, center_y: float) -> dict[str, str]:
    dx, dy = f"(x - {n(center_x)} * width)", f"(y - {n(center_y)} * height)"
    return {"_d": f"sqrt({dx} * {dx} + {dy} * {dy})"}


@point("red_eye_remove", "tool", {"radius": 8.0, "threshold": 0.4}, **SPOT | {"radius": (30.0, 1.0, 200.0)}, threshold=(0.5, *UNIT))
def _(center_x, center_y, radius, threshold):
    ratio = "r / greatest(r + g + b, 1e-3)"
    factor = f"({ratio} - {n(threshold)}) / {n(max(1 - threshold, 1e-9))} * (1e0 - {smoothstep(n(radius * 0.5), n(radius), '_d')})"
    return [spot(center_x, center_y), {"_f": f"CASE WHEN _d < {n(radius)} AND {ratio} > {n(threshold)} THEN {factor} ELSE 0e0 END", "_y": LUMA}, {"r": "r * (1e0 - _f) + _y * _f"}]


@point("sponge", "tool", {"radius": 8.0, "amount": 0.6}, **SPOT, amount=(0.3, *SIGNED))
def _(center_x, center_y, radius, amount):
    gain = f"CASE WHEN _d < {n(radius)} THEN {n(amount)} * (1e0 - {smoothstep(n(radius * 0.5), n(radius), '_d')}) ELSE 0e0 END"
    return [spot(center_x, center_y), {"_k": gain, "_y": LUMA}, each("{v} + _k * ({v} - _y)")]


# generators: colours of the grid of an image


def _grey(e: str) -> dict[str, str]:
    return dict.fromkeys("rgb", e) | {"a": "1e0"}


def _colors(prefix: str, *defaults: float) -> dict:
    return {f"{prefix}_{c}": (d, *UNIT) for c, d in zip("rgb", defaults, strict=True)}


@point("checkerboard", "generator", {"size": 5.0}, size=(32.0, 2.0, 500.0), **_colors("color1", 1.0, 1.0, 1.0), **_colors("color2", 0.2, 0.2, 0.2))
def _(size, **p):
    even = f"(floor(x / {n(size)}) + floor(y / {n(size)})) % 2 = 0"
    return {c: f"CASE WHEN {even} THEN {n(p['color1_' + c])} ELSE {n(p['color2_' + c])} END" for c in "rgb"} | {"a": "1e0"}


@point("gradient_linear", "generator", {"angle": 30.0}, angle=(0.0, 0.0, 360.0), **_colors("start", 1.0, 0.0, 0.0), **_colors("end", 0.0, 0.0, 1.0))
def _(angle, **p):
    t = clamp(f"x * 1e0 / width * {n(math.cos(angle * TO_RAD))} + y * 1e0 / height * {n(math.sin(angle * TO_RAD))}")
    return [{"_t": t}, {c: lerp(n(p["start_" + c]), n(p["end_" + c]), "_t") for c in "rgb"} | {"a": "1e0"}]


@point("gradient_radial", "generator", {"center_x": 0.3}, center_x=(0.5, *UNIT), center_y=(0.5, *UNIT), **_colors("inner", 1.0, 1.0, 1.0), **_colors("outer", 0.0, 0.0, 0.0))
def _(center_x, center_y, **p):
    dx, dy = f"(x * 1e0 / width - {n(center_x)})", f"(y * 1e0 / height - {n(center_y)})"
    return [{"_t": f"least(sqrt({dx} * {dx} + {dy} * {dy}) * 2e0, 1e0)"}, {c: lerp(n(p["inner_" + c]), n(p["outer_" + c]), "_t") for c in "rgb"} | {"a": "1e0"}]


@point("plasma", "generator", {"time": 1.5, "scale": 6.0}, scale=(30.0, 1.0, 200.0), time=(0.0, 0.0, 10.0))
def _(scale, time):
    return [
        {"_x": f"x / {n(scale)}", "_y": f"y / {n(scale)}"},
        {"_v": f"(sin(_x + {n(time)}) + sin(_y + {n(time * 0.7)}) + sin(_x + _y + {n(time * 0.5)}) + sin(sqrt(_x * _x + _y * _y) + {n(time * 0.3)})) * 0.25e0"},
        {c: f"sin(_v * {n(math.pi)} + {n(s)}) * 0.5e0 + 0.5e0" for c, s in zip("rgb", (0.0, 2.094, 4.189), strict=True)} | {"a": "1e0"},
    ]


@point("solid_color", "generator", {"r": 0.2, "a": 0.5}, r=(0.5, *UNIT), g=(0.5, *UNIT), b=(0.5, *UNIT), a=(1.0, *UNIT))
def _(**p):
    return {c: n(p[c]) for c in "rgba"}


# drawing by signed distance


def _painted(stages: list[dict[str, str]], cover: str, p: dict) -> list[dict[str, str]]:
    """Blends the colour of the parameters over the pixel by coverage and alpha."""
    mixed = {c: f"{c} * (1e0 - _c) + {n(p['color_' + c])} * _c" for c in "rgb"}
    return [*stages, {"_c": f"{n(p['color_a'])} * ({cover})"}, mixed | {"a": "a * (1e0 - _c) + _c"}]


def _coverage(distance: str, stroke: float, fill: bool) -> str:
    """Anti-aliased coverage of a filled shape, or of a stroke along its outline."""
    return f"1e0 - {smoothstep('-0.5e0', '0.5e0', distance)}" if fill else f"1e0 - {smoothstep(n(stroke / 2 - 0.5), n(stroke / 2 + 0.5), f'abs({distance})')}"


def _ink(r: float, g: float, b: float) -> dict:
    return {"color_r": (r, *UNIT), "color_g": (g, *UNIT), "color_b": (b, *UNIT), "color_a": (1.0, *UNIT)}


AT, SIZE, STROKE = (0.0, 8192.0), (1.0, 4096.0), (0.0, 50.0)


@point("draw_arc", "draw", {"cx": 8.0, "cy": 7.0, "radius": 5.0, "end_angle": 200.0, "color_a": 0.7}, cx=(200.0, *AT), cy=(200.0, *AT), radius=(80.0, *SIZE), start_angle=(0.0, 0.0, 360.0), end_angle=(270.0, 0.0, 360.0), stroke_width=(3.0, 0.5, 50.0), **_ink(1.0, 1.0, 1.0))
def _(cx, cy, radius, start_angle, end_angle, stroke_width, **p):
    first, last = start_angle * TO_RAD, end_angle * TO_RAD
    inside = f"_t >= {n(first)} {'AND' if first <= last else 'OR'} _t <= {n(last)}"
    stages = [{"_x": f"x - {n(cx)}", "_y": f"y - {n(cy)}"}, {"_t": mod("atan2(_y, _x)", n(2 * math.pi)), "_d": f"abs(sqrt(_x * _x + _y * _y) - {n(radius)})"}]
    return _painted(stages, f"CASE WHEN {inside} THEN {_coverage('_d', stroke_width, False)} ELSE 0e0 END", p)


@point("draw_circle", "draw", {"cx": 8.0, "cy": 7.0, "radius": 5.0, "color_a": 0.8}, cx=(200.0, *AT), cy=(200.0, *AT), radius=(80.0, *SIZE), stroke_width=(0.0, *STROKE), **_ink(0.0, 0.5, 1.0))
def _(cx, cy, radius, stroke_width, **p):
    d = f"sqrt((x - {n(cx)}) * (x - {n(cx)}) + (y - {n(cy)}) * (y - {n(cy)})) - {n(radius)}"
    return _painted([{"_d": d}], _coverage("_d", stroke_width, stroke_width <= 0), p)


@point("draw_ellipse", "draw", {"cx": 8.0, "cy": 7.0, "rx": 6.0, "ry": 3.0, "stroke_width": 2.0}, cx=(200.0, *AT), cy=(200.0, *AT), rx=(120.0, *SIZE), ry=(60.0, *SIZE), stroke_width=(0.0, *STROKE), **_ink(1.0, 0.8, 0.0))
def _(cx, cy, rx, ry, stroke_width, **p):
    u, v = f"((x - {n(cx)}) / {n(rx)})", f"((y - {n(cy)}) / {n(ry)})"
    return _painted([{"_d": f"(sqrt({u} * {u} + {v} * {v}) - 1e0) * {n((rx + ry) / 2)}"}], _coverage("_d", stroke_width, stroke_width <= 0), p)


@point("draw_line", "draw", {"x1": 1.0, "y1": 2.0, "x2": 13.0, "y2": 9.0}, x1=(10.0, *AT), y1=(10.0, *AT), x2=(200.0, *AT), y2=(200.0, *AT), stroke_width=(2.0, 0.5, 50.0), **_ink(1.0, 1.0, 1.0))
def _(x1, y1, x2, y2, stroke_width, **p):
    u, v = x2 - x1, y2 - y1
    stages = [
        {"_x": f"x - {n(x1)}", "_y": f"y - {n(y1)}"},
        {"_t": clamp(f"(_x * {n(u)} + _y * {n(v)}) / {n(u * u + v * v)}") if u or v else "0e0"},
        {"_d": f"sqrt((_x - {n(u)} * _t) * (_x - {n(u)} * _t) + (_y - {n(v)} * _t) * (_y - {n(v)} * _t))"},
    ]
    return _painted(stages, _coverage("_d", stroke_width, False), p)


@point("draw_polygon", "draw", {"cx": 8.3, "cy": 7.2, "radius": 6.0, "sides": 5}, cx=(200.0, *AT), cy=(200.0, *AT), radius=(80.0, *SIZE), sides=(6, 3, 24), stroke_width=(0.0, *STROKE), **_ink(0.0, 0.8, 0.2))
def _(cx, cy, radius, sides, stroke_width, **p):
    sector = 2 * math.pi / sides
    stages = [
        {"_x": f"x - {n(cx)}", "_y": f"y - {n(cy)}"},
        {"_t": f"atan2(_y, _x) % {n(sector)} - {n(sector / 2)}"},
        {"_d": f"sqrt(_x * _x + _y * _y) * cos(_t) - {n(radius * math.cos(math.pi / sides))}"},
    ]
    return _painted(stages, _coverage("_d", stroke_width, stroke_width <= 0), p)


@point("draw_rect", "draw", {"x": 3.0, "y": 2.0, "rect_width": 7.0, "rect_height": 9.0, "color_a": 0.6}, x=(50.0, *AT), y=(50.0, *AT), rect_width=(200.0, 1.0, 8192.0), rect_height=(100.0, 1.0, 8192.0), stroke_width=(0.0, *STROKE), **_ink(1.0, 0.0, 0.0))
def _(x, y, rect_width, rect_height, stroke_width, **p):
    half_w, half_h = rect_width / 2, rect_height / 2
    stages = [
        {"_x": f"abs(x - {n(x + half_w)}) - {n(half_w)}", "_y": f"abs(y - {n(y + half_h)}) - {n(half_h)}"},
        {"_d": "sqrt(greatest(_x, 0e0) * greatest(_x, 0e0) + greatest(_y, 0e0) * greatest(_y, 0e0)) + least(greatest(_x, _y), 0e0)"},
    ]
    return _painted(stages, _coverage("_d", stroke_width, stroke_width <= 0), p)


@point("solid_fill", "draw", {"color_g": 0.5, "color_a": 0.3}, **_ink(0.0, 0.0, 0.0))
def _(**p):
    return _painted([], "1e0", p)


# composition


def _mode(m: int) -> str | None:
    """Separable blend of foreground {f} over background {b}."""
    multiply, screen = "{f} * {b}", "1e0 - (1e0 - {f}) * (1e0 - {b})"
    twice = "2e0 * {f} * {b}", "1e0 - 2e0 * (1e0 - {f}) * (1e0 - {b})"
    root = "CASE WHEN {b} <= 0.25e0 THEN ((16e0 * {b} - 12e0) * {b} + 4e0) * {b} ELSE sqrt(greatest({b}, 0e0)) END"
    dodge, burn = "{b} / greatest(abs(1e0 - {f}), 1e-6)", "1e0 - (1e0 - {b}) / greatest(abs({f}), 1e-6)"
    return {
        0: "{f}", 1: multiply, 2: screen, 3: f"CASE WHEN {{b}} < 0.5e0 THEN {twice[0]} ELSE {twice[1]} END",
        4: f"CASE WHEN {{f}} <= 0.5e0 THEN {{b}} - (1e0 - 2e0 * {{f}}) * {{b}} * (1e0 - {{b}}) ELSE {{b}} + (2e0 * {{f}} - 1e0) * (({root}) - {{b}}) END",
        5: f"CASE WHEN {{f}} < 0.5e0 THEN {twice[0]} ELSE {twice[1]} END", 6: dodge, 7: burn, 8: "least({f}, {b})", 9: "greatest({f}, {b})", 10: "abs({f} - {b})",
        11: "{f} + {b} - 2e0 * {f} * {b}", 12: "{f} + {b} - 1e0", 13: "{f} + {b}",
        14: "CASE WHEN {f} <= 0.5e0 THEN CASE WHEN abs({f}) > 1e-6 THEN 1e0 - (1e0 - {b}) / nullif(2e0 * {f}, 0e0) ELSE 0e0 END ELSE {b} / greatest(abs(2e0 * (1e0 - {f})), 1e-6) END",
        15: "2e0 * {f} + {b} - 1e0", 16: "CASE WHEN {f} < 0.5e0 THEN least({b}, 2e0 * {f}) ELSE greatest({b}, 2e0 * {f} - 1e0) END", 17: "CASE WHEN {f} + {b} >= 1e0 THEN 1e0 ELSE 0e0 END",
    }.get(m)


def _luma(p: str) -> str:
    return f"(0.2126e0 * {p}r + 0.7152e0 * {p}g + 0.0722e0 * {p}b)"


def _set_lum(colour: str, luma: str) -> list[dict[str, str]]:
    """Columns _o{c}: the colour of columns {colour}{c} moved to a luma and clipped around it."""
    out = [{f"_o{c}": f"{colour}{c} + ({luma}) - {_luma(colour)}" for c in "rgb"}]
    out.append({"_ol": _luma("_o"), "_on": "least(_or, _og, _ob)"})
    out.append({f"_o{c}": f"CASE WHEN _on < 0e0 THEN _ol + (_o{c} - _ol) * _ol / greatest(_ol - _on, 1e-7) ELSE _o{c} END" for c in "rgb"})
    out.append({"_ox": "greatest(_or, _og, _ob)"})
    out.append({f"_o{c}": f"CASE WHEN _ox > 1e0 THEN _ol + (_o{c} - _ol) * (1e0 - _ol) / greatest(_ox - _ol, 1e-7) ELSE _o{c} END" for c in "rgb"})
    return out


def _set_sat(colour: str, other: str) -> list[dict[str, str]]:
    """Columns _s{c}: the colour with the saturation of another."""
    low, high = (f"{f}({colour}r, {colour}g, {colour}b)" for f in ("least", "greatest"))
    sat = f"(greatest({other}r, {other}g, {other}b) - least({other}r, {other}g, {other}b))"
    return [{f"_s{c}": f"CASE WHEN {high} - {low} < 1e-7 THEN 0e0 ELSE ({colour}{c} - {low}) * {sat} / nullif({high} - {low}, 0e0) END" for c in "rgb"}]


def blended(mode: int, opacity: float) -> list[dict[str, str]]:
    """Stages over r, g, b (background) and _fr, _fg, _fb (foreground)."""
    keep, take = n(1 - opacity), n(opacity)
    if (form := _mode(mode)) is not None:
        return [{c: f"{c} * {keep} + ({form.replace('{f}', '_f' + c).replace('{b}', c)}) * {take}" for c in "rgb"}]
    if mode in (19, 20):
        test = "<" if mode == 19 else ">"
        return [{"_pick": f"CASE WHEN {_luma('_f')} {test} {LUMA} THEN 1e0 ELSE 0e0 END"}, {c: f"{c} * {keep} + (CASE WHEN _pick > 0e0 THEN _f{c} ELSE {c} END) * {take}" for c in "rgb"}]
    unit = {f"_f{c}": clamp(f"_f{c}") for c in "rgb"} | {f"_b{c}": clamp(c) for c in "rgb"}
    body = {
        21: [*_set_sat("_f", "_b"), *_set_lum("_s", _luma("_b"))],
        22: [*_set_sat("_b", "_f"), *_set_lum("_s", _luma("_b"))],
        23: _set_lum("_f", _luma("_b")),
        24: _set_lum("_b", _luma("_f")),
    }[mode]
    return [unit, *body, {c: f"{c} * {keep} + _o{c} * {take}" for c in "rgb"}]


MODES = (
    "normal", "multiply", "screen", "overlay", "soft_light", "hard_light", "color_dodge", "color_burn", "darken", "lighten", "difference", "exclusion", "linear_burn",
    "linear_dodge", "vivid_light", "linear_light", "pin_light", "hard_mix", "dissolve", "darker_color", "lighter_color", "hue", "saturation", "color", "luminosity",
)


@point("blend", "composite", {"mode": 4, "opacity": 0.8}, mode=(1, 0, 24), opacity=(0.5, *UNIT))
def _(mode, opacity):
    """An image blended with itself."""
    if mode == 18:
        return each("{v}")
    return [{f"_f{c}": c for c in "rgb"}, *blended(mode, opacity)]


@point("blend_if", "composite", {"shadow_threshold": 0.2, "highlight_threshold": 0.8}, shadow_threshold=(0.0, *UNIT), shadow_feather=(0.1, 0.0, 0.5), highlight_threshold=(1.0, *UNIT), highlight_feather=(0.1, 0.0, 0.5))
def _(shadow_threshold, shadow_feather, highlight_threshold, highlight_feather):
    dark = clamp(f"({LUMA} - {n(shadow_threshold)}) / {n(max(shadow_feather, 1e-6))}")
    light = clamp(f"({n(highlight_threshold)} - {LUMA}) / {n(max(highlight_feather, 1e-6))}")
    return {"a": f"a * {dark} * {light}"}


@point("premultiply", "composite")
def _():
    return each("{v} * a")


@point("unpremultiply", "composite")
def _():
    return each("CASE WHEN a > 1e-7 THEN {v} / nullif(a, 0e0) ELSE 0e0 END")


def _pair(foreground: Rel, background: Rel) -> Rel:
    """Background pixels with the foreground's channels at the same place as _fr, _fg, _fb, _fa."""
    front = foreground.pick("image_id", "y", "x", **{f"_f{c}": c for c in "rgba"})
    return background.join(front, ["image_id", "y", "x"])


def _tidy(rel: Rel) -> Rel:
    return rel.pick(*(c for c in rel.cols if not c.startswith("_")))


@plan("blend_dual", "composite", {"mode": 5, "opacity": 0.7}, inputs=2, mode=(1, 0, 24), opacity=(1.0, *UNIT))
def blend_dual(foreground: Rel, background: Rel, mode: int, opacity: float) -> Rel:
    """A foreground blended over a background of the same size; alpha is the background's."""
    both = _pair(foreground, background)
    if mode == 18:
        both = both.steps(*dissolve_mask("y * width + x"))
        return _tidy(both.let(**{c: f"CASE WHEN _low / 255e0 < {n(opacity)} THEN _f{c} ELSE {c} END" for c in "rgb"}))
    return _tidy(both.steps(*blended(mode, opacity)))


def dissolve_mask(index: str) -> list[dict[str, str]]:
    """Column _low: the low byte of the PCG hash of a pixel's index.

    Both engines have shifts and xor only under different names, so they are written out: products modulo 2^32 are
    split such that nothing passes 2^63, and xor is taken bit by bit where a result needs it.
    """
    two32 = 1 << 32
    bit = lambda e, k: f"(cast(floor({e} / {n(2.0**k)}) as bigint) % 2)"
    xor = lambda a, b, bits: " + ".join(f"(({bit(a, k)} + {bit(b, k)}) % 2) * {1 << k}" for k in range(bits))
    return [
        {"_z": f"(((({index}) % {two32}) * 747796405) % {two32} + 2891336453) % {two32}"},
        {"_h": f"cast(floor(_z / pow(2e0, floor(_z / {n(2.0**28)}) + 4e0)) as bigint)"},
        {"_z": xor("_h", "_z", 32)},
        {"_z": f"(_z * 277803737) % {two32}"},
        {"_h": f"cast(floor(_z / {n(2.0**22)}) as bigint)"},
        {"_low": xor("_h", "_z", 8)},
    ]


@plan("porter_duff_over", "composite", {"opacity": 0.8}, inputs=2, opacity=(1.0, *UNIT))
def porter_duff_over(foreground: Rel, background: Rel, opacity: float) -> Rel:
    """Straight-alpha source over destination."""
    both = _pair(foreground, background).steps({"_fa": f"_fa * {n(opacity)}"}, {"_k": "a * (1e0 - _fa)"}, {"_oa": "_fa + _k"})
    return _tidy(both.let(**{c: f"CASE WHEN _oa > 1e-7 THEN (_f{c} * _fa + {c} * _k) / nullif(_oa, 0e0) ELSE 0e0 END" for c in "rgb"}, a="_oa"))
