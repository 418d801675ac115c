"""Building blocks of pixel expressions as SQL text for both engines."""

from __future__ import annotations

from collections.abc import Sequence

LUMA = "(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b)"


def n(x: float | bool) -> str:
    """A double literal."""
    text = repr(float(x))
    text = text if "e" in text or "n" in text else text + "e0"
    return f"({text})" if text.startswith("-") else text


def each(template: str, *channels: str) -> dict[str, str]:
    """The template for each channel, {v} standing for the channel."""
    return {c: template.replace("{v}", c) for c in (channels or ("r", "g", "b"))}


def clamp(e: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least(greatest({e}, {n(lo)}), {n(hi)})"


def lerp(a: str, b: str, t: str) -> str:
    return f"({a} + ({b} - {a}) * {t})"


def smoothstep(lo: str, hi: str, x: str) -> str:
    t = clamp(f"(({x}) - ({lo})) / (({hi}) - ({lo}))")
    return f"({t} * {t} * (3e0 - 2e0 * {t}))"


def linear(m: Sequence[Sequence[float]], v: Sequence[str]) -> list[str]:
    """Matrix times vector."""
    return ["(" + " + ".join(f"{n(x)} * {c}" for x, c in zip(row, v, strict=True)) + ")" for row in m]


def mod(a: str, b: str) -> str:
    """Remainder with the sign of the divisor."""
    return f"(({a}) - ({b}) * floor(({a}) / ({b})))"


def power(base: str, exponent: str) -> str:
    return f"pow(greatest({base}, 0e0), {exponent})"


def half_up(e: str) -> str:
    """Nearest integer, halves away from zero, as a double."""
    return f"(sign({e}) * floor(abs({e}) + 0.5e0))"


def whole(e: str) -> str:
    return f"cast(floor({e}) as bigint)"


#: HSL of r, g, b as columns _h (degrees), _s, _l.
HSL = (
    {"_mx": "greatest(r, g, b)", "_mn": "least(r, g, b)"},
    {
        "_l": "(_mx + _mn) * 0.5e0",
        "_s": "CASE WHEN _mx - _mn < 1e-7 THEN 0e0 WHEN (_mx + _mn) * 0.5e0 > 0.5e0 THEN (_mx - _mn) / (2e0 - _mx - _mn) ELSE (_mx - _mn) / (_mx + _mn) END",
        "_h": "CASE WHEN _mx - _mn < 1e-7 THEN 0e0 WHEN abs(_mx - r) < 1e-7 THEN ((g - b) / (_mx - _mn) + CASE WHEN g < b THEN 6e0 ELSE 0e0 END) * 60e0 "
        "WHEN abs(_mx - g) < 1e-7 THEN ((b - r) / (_mx - _mn) + 2e0) * 60e0 ELSE ((r - g) / (_mx - _mn) + 4e0) * 60e0 END",
    },
)


def _hue(t: str) -> str:
    return f"CASE WHEN {t} < 1e0 / 6e0 THEN _p + (_q - _p) * 6e0 * {t} WHEN {t} < 0.5e0 THEN _q WHEN {t} < 2e0 / 3e0 THEN _p + (_q - _p) * (2e0 / 3e0 - {t}) * 6e0 ELSE _p END"


def from_hsl(h: str = "_h", s: str = "_s", l: str = "_l") -> tuple[dict[str, str], ...]:
    """r, g, b of an HSL colour."""
    return (
        {"_h": h, "_s": s, "_l": l},
        {"_q": "CASE WHEN _l < 0.5e0 THEN _l * (1e0 + _s) ELSE _l + _s - _l * _s END"},
        {"_p": "2e0 * _l - _q"} | {f"_t{c}": mod(f"_h / 360e0 + {n(k / 3)}", "1e0") for c, k in (("r", 1), ("g", 0), ("b", -1))},
        {c: f"CASE WHEN abs(_s) < 1e-7 THEN _l ELSE {_hue('_t' + c)} END" for c in "rgb"},
    )
