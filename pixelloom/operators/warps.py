"""Kernels of geometric operators: each image, or tile, is moved at once instead of joined pixel by pixel."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from pixelloom.operators import geometry
from pixelloom.operators.kernels import mirror, painted, places, rounded
from pixelloom.plans.registry import OPERATORS, kernel

Map = Callable[..., tuple[np.ndarray, np.ndarray]]


def bilinear(img: np.ndarray, sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
    """Pixels at real places, the border extended."""
    h, w = img.shape[:2]
    x0, y0 = np.floor(sx), np.floor(sy)
    u, v = (sx - x0)[..., None], (sy - y0)[..., None]
    xs = [np.clip(x0 + k, 0, w - 1).astype(np.int64) for k in (0, 1)]
    ys = [np.clip(y0 + k, 0, h - 1).astype(np.int64) for k in (0, 1)]
    top, low = (img[ys[k], xs[0]] + (img[ys[k], xs[1]] - img[ys[k], xs[0]]) * u for k in (0, 1))
    return top + (low - top) * v


def _with_kernel(name: str):
    def wrap(f):
        OPERATORS[name].kernel = f
        return f

    return wrap


def _center(img):
    return img.shape[1] * 0.5, img.shape[0] * 0.5


def _unit(img):
    x, y = places(img)
    cx, cy = _center(img)
    return (x - cx) / cx, (y - cy) / cy, cx, cy


def barrel(img, k1, k2):
    u, v, cx, cy = _unit(img)
    r = u * u + v * v
    k = 1 + k1 * r + k2 * r * r
    return u * k * cx + cx, v * k * cy + cy


def spherize(img, amount):
    u, v, cx, cy = _unit(img)
    r = np.hypot(u, v)
    inside = (r < 1) & (r > 0)
    safe = np.where(inside, r, 0.5)
    k = np.where(inside, 1 + amount * (np.arcsin(safe) / safe - 1), 1)
    return u * k * cx + cx, v * k * cy + cy


def polar(img):
    x, y = places(img)
    cx, cy = _center(img)
    turn, far = (x + 0.5 - cx) / img.shape[1] * 2 * np.pi, (y + 0.5) / img.shape[0] * min(cx, cy)
    return cx + far * np.sin(turn) - 0.5, cy + far * np.cos(turn) - 0.5


def depolar(img):
    x, y = places(img)
    cx, cy = _center(img)
    dx, dy = x + 0.5 - cx, y + 0.5 - cy
    turn = np.arctan2(dx, dy) / (2 * np.pi)
    return (turn - rounded(turn)) * img.shape[1] + cx - 0.5, np.hypot(dx, dy) * img.shape[0] / min(cx, cy) - 0.5


def ripple(img, amplitude, wavelength, center_x, center_y):
    x, y = places(img)
    dx, dy = x - center_x * img.shape[1], y - center_y * img.shape[0]
    d = np.hypot(dx, dy)
    k = np.where(d > 0, amplitude * np.sin(2 * np.pi * d / wavelength) / np.where(d > 0, d, 1), 0)
    return x + k * dx, y + k * dy


def swirl(img, angle, radius):
    x, y = places(img)
    cx, cy = _center(img)
    dx, dy = x - cx, y - cy
    d = np.hypot(dx, dy)
    t = np.where(d < radius, angle * (1 - d / radius) ** 2, 0)
    return dx * np.cos(t) - dy * np.sin(t) + cx, dx * np.sin(t) + dy * np.cos(t) + cy


def wave(img, amplitude, wavelength, vertical):
    x, y = places(img)
    move = amplitude * np.sin(2 * np.pi * (y if vertical else x) / wavelength)
    return (x + move, y) if vertical else (x, y + move)


def mesh_warp(img, strength, frequency):
    x, y = places(img)
    return x + strength * np.sin(2 * np.pi * y / frequency), y + strength * np.sin(2 * np.pi * x / frequency)


def displacement_map(img, scale):
    x, y = places(img)
    return x + (img[..., 0] - 0.5) * scale, y + (img[..., 1] - 0.5) * scale


def push(img, center_x, center_y, radius, strength, direction_x, direction_y):
    x, y = places(img)
    d = np.hypot(x - center_x * img.shape[1], y - center_y * img.shape[0])
    k = np.where(d < radius, np.exp(-2 * (d / radius) ** 2) * strength * radius, 0)
    return x - direction_x * k, y - direction_y * k


def perspective_warp(img, h11, h12, h13, h21, h22, h23, h31, h32):
    x, y = places(img)
    w = h31 * x + h32 * y + 1
    good = np.abs(w) > 1e-4
    safe = np.where(good, w, 1)
    return np.where(good, (h11 * x + h12 * y + h13) / safe, 0), np.where(good, (h21 * x + h22 * y + h23) / safe, 0)


MAPS: dict[str, Map] = {
    "barrel": barrel, "spherize": spherize, "polar": polar, "depolar": depolar, "ripple": ripple, "swirl": swirl, "wave": wave, "mesh_warp": mesh_warp,
    "displacement_map": displacement_map, "liquify": push, "smudge": push, "perspective_warp": perspective_warp,
}
for _name, _map in MAPS.items():

    def _moved(img, _map=_map, **p):
        return bilinear(img, *_map(img, **p))

    OPERATORS[_name].kernel = _moved


@_with_kernel("perspective_correct")
def _(img, vertical, horizontal):
    return bilinear(img, *perspective_warp(img, 1, 0, 0, 0, 1, 0, horizontal, vertical))


@_with_kernel("undistort")
def _(img, focal, k1, k2, k3, p1, p2):
    x, y = places(img)
    h, w = img.shape[:2]
    f = focal * w
    u, v = (x - (w - 1) / 2) / f, (y - (h - 1) / 2) / f
    r = u * u + v * v
    k = 1 + r * (k1 + r * (k2 + r * k3))
    su, sv = u * k + 2 * p1 * u * v + p2 * (r + 2 * u * u), v * k + p1 * (r + 2 * v * v) + 2 * p2 * u * v
    return bilinear(img, su * f + (w - 1) / 2, sv * f + (h - 1) / 2)


def _channel_moved(img, moves):
    out = img.copy()
    for c, (sx, sy) in moves.items():
        out[..., c] = bilinear(img[..., c : c + 1], sx, sy)[..., 0]
    return out


@_with_kernel("chromatic_aberration")
def _(img, strength):
    x, y = places(img)
    cx, cy = _center(img)
    dx, dy = x - cx, y - cy
    d = np.hypot(dx, dy)
    k = d * strength / max(math.hypot(cx, cy), 1) / np.maximum(d, 1)
    return _channel_moved(img, {0: (x + k * dx, y + k * dy), 2: (x - k * dx, y - k * dy)})


@_with_kernel("ca_remove")
def _(img, red_shift, blue_shift):
    x, y = places(img)
    cx, cy = _center(img)
    dx, dy = x - cx, y - cy
    d = np.hypot(dx, dy)
    k = d / math.hypot(cx, cy) / np.maximum(d, 1e-3)
    return _channel_moved(img, {0: (x + k * dx * red_shift, y + k * dy * red_shift), 2: (x + k * dx * blue_shift, y + k * dy * blue_shift)})


def _brush(img, center_x, center_y, offset_x, offset_y, radius, inner):
    """(weight, pixels at the offset) of a soft round spot."""
    h, w = img.shape[:2]
    x, y = places(img)
    d = np.hypot(x - center_x * w, y - center_y * h)
    t = np.clip((d - radius * inner) / (radius * (1 - inner)), 0, 1)
    return np.where(d < radius, 1 - t * t * (3 - 2 * t), 0), bilinear(img, x + offset_x * w, y + offset_y * h)[..., :3]


@_with_kernel("clone_stamp")
def _(img, center_x, center_y, offset_x, offset_y, radius, opacity):
    k, source = _brush(img, center_x, center_y, offset_x, offset_y, radius, 0.7)
    return painted(img, img[..., :3] + (source - img[..., :3]) * (k * opacity)[..., None])


@_with_kernel("healing_brush")
def _(img, center_x, center_y, offset_x, offset_y, radius):
    k, source = _brush(img, center_x, center_y, offset_x, offset_y, radius, 0.5)
    luma = np.array([0.2126, 0.7152, 0.0722])
    ratio = (img[..., :3] @ luma) / np.maximum(source @ luma, 1e-3)
    return painted(img, img[..., :3] + (source * ratio[..., None] - img[..., :3]) * k[..., None])


@_with_kernel("chromatic_split")
def _(img, **p):
    h, w = img.shape[:2]
    out = img.copy()
    for c, name in enumerate(("red", "green", "blue")):
        dx, dy = (int(rounded(np.float64(p[f"{name}_{k}"]))) for k in ("dx", "dy"))
        cols, rows = mirror(w, max(-dx, 0), max(dx, 0)), mirror(h, max(-dy, 0), max(dy, 0))
        cols, rows = cols[dx if dx > 0 else 0 :][:w], rows[dy if dy > 0 else 0 :][:h]
        out[..., c] = img[rows][:, cols, c]
    return out


@_with_kernel("pattern_fill")
def _(img, tile_w, tile_h, offset_x, offset_y):
    h, w = img.shape[:2]
    cols = np.minimum(((np.arange(w) + offset_x * tile_w) % tile_w).astype(int), w - 1)
    rows = np.minimum(((np.arange(h) + offset_y * tile_h) % tile_h).astype(int), h - 1)
    return img[rows][:, cols]


# transforms that change the size


def _weights(n: int, to: int, method: str) -> np.ndarray:
    """Matrix that resamples n places to `to`."""
    scale = n / to
    if method == "nearest":
        out = np.zeros((to, n))
        out[np.arange(to), np.minimum(((np.arange(to) + 0.5) * scale).astype(int), n - 1)] = 1
        return out
    support, wide = {"bilinear": 1, "bicubic": 2, "lanczos3": 3}[method], max(scale, 1.0)
    center = (np.arange(to) + 0.5) * scale - 0.5
    s = np.arange(n)[None, :]
    d = np.abs((s - center[:, None]) / wide)
    near = (s >= np.ceil(center - support * wide)[:, None]) & (s <= np.floor(center + support * wide)[:, None])
    if method == "bilinear":
        k = np.maximum(1 - d, 0)
    elif method == "bicubic":
        k = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2, 0))
    else:
        k = np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0)
    k = np.where(near, k, 0)
    return k / k.sum(1, keepdims=True)


@_with_kernel("resize")
def _(img, w, h, method):
    across, down = _weights(img.shape[1], w, method), _weights(img.shape[0], h, method)
    lines = (down @ img.reshape(img.shape[0], -1)).reshape(h, -1, 4).swapaxes(0, 1)
    return (across @ lines.reshape(img.shape[1], -1)).reshape(w, h, 4).swapaxes(0, 1)


def _placed(img, w, h, sx, sy, fill):
    oh, ow = img.shape[:2]
    inside = (sx >= -0.5) & (sy >= -0.5) & (sx <= ow - 0.5) & (sy <= oh - 0.5)
    got = bilinear(img, np.where(inside, sx, 0), np.where(inside, sy, 0))
    return np.where(inside[..., None], got, np.array([fill[f"fill_{c}"] for c in "rgba"]))


def _canvas(w, h):
    return np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))


@_with_kernel("affine")
def _(img, a, b, tx, c, d, ty, w, h, **fill):
    x, y = _canvas(w, h)
    back = np.linalg.inv([[a, b], [c, d]])
    return _placed(img, w, h, back[0, 0] * (x - tx) + back[0, 1] * (y - ty), back[1, 0] * (x - tx) + back[1, 1] * (y - ty), fill)


@_with_kernel("rotate_arbitrary")
def _(img, degrees, **fill):
    oh, ow = img.shape[:2]
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    w, h = (math.ceil(p * abs(cos) + q * abs(sin) - 1e-6) for p, q in ((ow, oh), (oh, ow)))
    x, y = _canvas(w, h)
    x, y = x - (w - 1) / 2, y - (h - 1) / 2
    return _placed(img, w, h, cos * x + sin * y + (ow - 1) / 2, cos * y - sin * x + (oh - 1) / 2, fill)


@_with_kernel("pad")
def _(img, top, right, bottom, left, **fill):
    out = np.empty((img.shape[0] + top + bottom, img.shape[1] + left + right, 4))
    out[:] = [fill[f"fill_{c}"] for c in "rgba"]
    out[top : top + img.shape[0], left : left + img.shape[1]] = img
    return out


@_with_kernel("trim")
def _(img, threshold):
    differs = (np.abs(img - img[0, 0]) > threshold).any(-1)
    if not differs.any():
        return img
    rows, cols = np.flatnonzero(differs.any(1)), np.flatnonzero(differs.any(0))
    return img[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


@_with_kernel("crop")
def _(img, x, y, w, h):
    return img[y : y + h, x : x + w]


@_with_kernel("flip")
def _(img, vertical):
    return img[::-1] if vertical else img[:, ::-1]


def turned(img, degrees):
    return np.rot90(img, -(degrees // 90) % 4)


@_with_kernel("rotate")
def _(img, degrees):
    if degrees % 90:
        raise ValueError("rotate takes multiples of 90 degrees; rotate_arbitrary takes any")
    return turned(img, degrees)


@_with_kernel("auto_orient")
def _(img, orientation):
    mirrored, degrees = geometry.ORIENTATIONS[orientation]
    return turned(img[:, ::-1] if mirrored else img, degrees)


#: On rows of pixels these only rename places, so they stay projections and filters there.
for _name in ("crop", "flip", "rotate", "auto_orient"):
    OPERATORS[_name].narrow = True

# elliptical weighted averages


def robidoux(r: np.ndarray) -> np.ndarray:
    """Cubic filter of Robidoux, of support 2."""
    b = 12 / (19 + 9 * math.sqrt(2))
    c = (1 - b) / 2
    near = ((12 - 9 * b - 6 * c) * r**3 + (-18 + 12 * b + 6 * c) * r**2 + 6 - 2 * b) / 6
    far = ((-b - 6 * c) * r**3 + (6 * b + 30 * c) * r**2 + (-12 * b - 48 * c) * r + 8 * b + 24 * c) / 6
    return np.where(r < 1, near, np.where(r < 2, far, 0))


@kernel("ewa_distort", "distortion", {"distortion": "barrel", "params": {"k1": 0.3, "k2": 0.1}}, distortion="barrel", params={})
def ewa_distort(img, distortion, params):
    """A distortion sampled by ellipses: where it shrinks, all source pixels under an output pixel count. Jacobians are central differences."""
    op = OPERATORS[distortion]
    sx, sy = MAPS[distortion](img, **op.bind(params))
    j = [np.gradient(v, axis=k) if min(img.shape[:2]) > 1 else np.zeros_like(v) for v in (sx, sy) for k in (1, 0)]
    ux, uy, vx, vy = j
    # the ellipse is at least a unit circle
    a, b, c = vx**2 + vy**2 + 1, -2 * (ux * vx + uy * vy), ux**2 + uy**2 + 1
    f = a * c - b * b / 4
    a, b, c = a / f, b / f, c / f
    reach_x, reach_y = 2 * np.sqrt(c / np.maximum(a * c - b * b / 4, 1e-12)), 2 * np.sqrt(a / np.maximum(a * c - b * b / 4, 1e-12))
    h, w = img.shape[:2]
    rx, ry = (min(int(np.ceil(v.max())), 32) for v in (reach_x, reach_y))
    total, weight = np.zeros_like(img), np.zeros((h, w))
    x0, y0 = np.floor(sx), np.floor(sy)
    for dy in range(-ry, ry + 2):
        for dx in range(-rx, rx + 2):
            u, v = x0 + dx - sx, y0 + dy - sy
            k = robidoux(np.sqrt(np.maximum(a * u * u + b * u * v + c * v * v, 0)))
            if k.any():
                total += k[..., None] * img[np.clip(y0 + dy, 0, h - 1).astype(int), np.clip(x0 + dx, 0, w - 1).astype(int)]
                weight += k
    return total / np.where(np.abs(weight) > 1e-10, weight, 1)[..., None]


def _entropy(gray: np.ndarray) -> float:
    p = np.bincount(gray.ravel(), minlength=256) / max(gray.size, 1)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


@kernel("smart_crop_to", "transform", {"w": 9, "h": 7}, w=(64, 1, 65536), h=(64, 1, 65536), strategy="entropy")
def smart_crop_to(img, w, h, strategy):
    """A window of a size: edges of less entropy are cut in up to about eight slices, or the window is laid around the strongest smoothed contrast and saturation."""
    rows, cols = img.shape[:2]
    w, h = min(w, cols), min(h, rows)
    gray = np.clip(np.rint(img[..., :3] @ np.array([0.2126, 0.7152, 0.0722]) * 255), 0, 255).astype(int)
    if strategy == "attention":
        y, x = np.gradient(gray.astype(float)) if min(rows, cols) > 1 else (np.zeros_like(gray), np.zeros_like(gray))
        heat = np.hypot(x, y) / 255 + np.ptp(img[..., :3], axis=-1)
        from pixelloom.operators.kernels import gauss

        heat = gauss(heat[..., None], max(min(rows, cols) / 32, 0.5))[..., 0]
        cy, cx = np.unravel_index(int(heat.argmax()), heat.shape)
        x0, y0 = min(max(int(cx) - w // 2, 0), cols - w), min(max(int(cy) - h // 2, 0), rows - h)
        return img[y0 : y0 + h, x0 : x0 + w]
    x0, y0, cw, ch = 0, 0, cols, rows
    step = max(-(-(cols - w) // 8), -(-(rows - h) // 8), 1)
    while cw > w or ch > h:
        if cw > w:
            s = min(step, cw - w)
            x0 += s * (_entropy(gray[y0 : y0 + ch, x0 : x0 + s]) <= _entropy(gray[y0 : y0 + ch, x0 + cw - s : x0 + cw]))
            cw -= s
        if ch > h:
            s = min(step, ch - h)
            y0 += s * (_entropy(gray[y0 : y0 + s, x0 : x0 + cw]) <= _entropy(gray[y0 + ch - s : y0 + ch, x0 : x0 + cw]))
            ch -= s
    return img[y0 : y0 + h, x0 : x0 + w]
