"""Operators on neighbourhoods, sequences and whole images as numpy kernels.

A kernel takes an image as an array (height, width, 4) of doubles and returns
one. It runs once for each image, or for each tile of it where `halo` says how
far it looks.
"""

from __future__ import annotations

import colorsys
import heapq
import math

import numpy as np

from pixelloom.functions import matrices as mx
from pixelloom.functions.noise import SEEDS, Sequence, cellular, normal, octaves, place_hash, place_noise, value_noise
from pixelloom.plans.registry import Param, kernel

UNIT, SIGNED = (0.0, 1.0), (-1.0, 1.0)
LUMA = np.array([0.2126, 0.7152, 0.0722])


def luma(img: np.ndarray) -> np.ndarray:
    return img[..., :3] @ LUMA


def painted(img: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Image with new colours and the old alpha; one plane counts for all three."""
    out = img.copy()
    out[..., :3] = rgb[..., None] if rgb.ndim == 2 else rgb
    return out


def mirror(n: int, before: int, after: int) -> np.ndarray:
    """Places from -before to n + after, mirrored at the border without repeating it."""
    v = np.arange(-before, n + after)
    return np.where(v < 0, np.minimum(-v, n - 1), np.where(v >= n, np.maximum(2 * n - v - 2, 0), v))


def padded(img: np.ndarray, r: int, border: str = "mirror", rx: int | None = None) -> np.ndarray:
    h, w = img.shape[:2]
    rx = r if rx is None else rx
    if border == "mirror":
        return img[mirror(h, r, r)][:, mirror(w, rx, rx)]
    return img[np.clip(np.arange(-r, h + r), 0, h - 1)][:, np.clip(np.arange(-rx, w + rx), 0, w - 1)]


def shifted(img: np.ndarray, taps, border: str = "mirror"):
    """(weight, image moved by the tap) for each tap (dy, dx, weight)."""
    r = max([abs(v) for dy, dx, _ in taps for v in (dy, dx)], default=0)
    big = padded(img, r, border)
    h, w = img.shape[:2]
    for dy, dx, k in taps:
        yield k, big[r + dy : r + dy + h, r + dx : r + dx + w]


def convolved(img: np.ndarray, weights: np.ndarray, border: str = "mirror") -> np.ndarray:
    h, w = weights.shape
    taps = [(y - h // 2, x - w // 2, weights[y, x]) for y in range(h) for x in range(w) if weights[y, x]]
    return sum(k * part for k, part in shifted(img, taps, border))


def bell(sigma: float, spread: float = 5.0) -> np.ndarray:
    size = max(int(math.floor(2 * spread * sigma + 1 + 0.5)) | 1, 3)
    x = np.arange(size) - size // 2
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum()


#: Places along an axis that one product of matrices makes.
BLOCK = 64


def along_columns(img: np.ndarray, k: np.ndarray, border: str) -> np.ndarray:
    """Each column filtered by k: blocks of rows are products of a banded matrix with the rows that they need, which runs at the speed of matrix multiplication."""
    r, n = len(k) // 2, img.shape[0]
    places_ = mirror(n, r, r) if border == "mirror" else np.clip(np.arange(-r, n + r), 0, n - 1)
    flat = np.ascontiguousarray(img).reshape(n, -1)
    big = flat[places_] if r else flat
    size = min(BLOCK, n)
    band = np.zeros((size, size + 2 * r), flat.dtype)
    for i in range(size):
        band[i, i : i + len(k)] = k
    out = np.empty(flat.shape, flat.dtype)
    for y in range(0, n, size):
        rows = min(size, n - y)
        np.matmul(band[:rows, : rows + 2 * r], big[y : y + rows + 2 * r], out=out[y : y + rows])
    return out.reshape(img.shape)


def separable(img: np.ndarray, k: np.ndarray, border: str = "mirror") -> np.ndarray:
    """Rows, then columns."""
    across = along_columns(img.swapaxes(0, 1), k, border).swapaxes(0, 1)
    return along_columns(across, k, border)


def gauss(img: np.ndarray, sigma: float) -> np.ndarray:
    return separable(img, bell(sigma)) if sigma > 0 else img


def reach(sigma: float) -> int:
    return len(bell(sigma)) // 2 if sigma > 0 else 0


def places(img: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, w = img.shape[:2]
    return np.meshgrid(np.arange(w, dtype=float), np.arange(h, dtype=float))


def rounded(v: np.ndarray) -> np.ndarray:
    """Nearest integer, halves away from zero."""
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


def stretched(v: np.ndarray) -> np.ndarray:
    """Each channel from its least to its greatest value onto [0, 1]."""
    lo, hi = v.min((0, 1)), v.max((0, 1))
    return np.where(hi - lo > 1e-10, (v - lo) / np.where(hi - lo > 1e-10, hi - lo, 1), v)


# spatial


@kernel("gaussian_blur", "spatial", {"radius": 0.8}, single=True, halo=lambda radius: reach(radius), radius=(1.0, 0.0, 100.0))
def gaussian_blur(img, radius):
    return gauss(img, radius)


@kernel("box_blur", "spatial", {"radius": 2}, single=True, halo=lambda radius: radius, radius=(1, 0, 100))
def box_blur(img, radius):
    return separable(img, np.full(2 * radius + 1, 1 / (2 * radius + 1)))


@kernel("high_pass", "spatial", {"radius": 0.8}, single=True, halo=lambda radius: reach(radius), radius=(3.0, 0.0, 100.0))
def high_pass(img, radius):
    return painted(img, (img - gauss(img, radius))[..., :3] + 0.5)


@kernel("frequency_high", "enhancement", {"sigma": 0.8}, single=True, halo=lambda sigma: reach(sigma), sigma=(3.0, 0.0, 100.0))
def frequency_high(img, sigma):
    return high_pass(img, sigma)


@kernel("frequency_low", "enhancement", {"sigma": 0.8}, single=True, halo=lambda sigma: reach(sigma), sigma=(3.0, 0.0, 100.0))
def frequency_low(img, sigma):
    return gauss(img, sigma)


@kernel("sharpen", "spatial", {"radius": 0.8, "amount": 1.5}, single=True, halo=lambda radius, amount: reach(radius), radius=(1.0, 0.0, 100.0), amount=(1.0, 0.0, 10.0))
def sharpen(img, radius, amount):
    return painted(img, (img + amount * (img - gauss(img, radius)))[..., :3])


@kernel("clarity", "enhancement", {"amount": 0.6, "radius": 0.8}, halo=lambda amount, radius: reach(radius), amount=(0.0, *SIGNED), radius=(20.0, 0.0, 100.0))
def clarity(img, amount, radius):
    y = luma(img)[..., None]
    return painted(img, (img + amount * 4 * y * (1 - y) * (img - gauss(img, radius)))[..., :3])


@kernel("convolve", "spatial", {"weights": ((0, 1, 2), (-1, 0, 1), (0, -2, 1)), "divisor": 2.0}, halo=lambda weights, divisor: max(len(weights), len(weights[0])) // 2, weights=Param(((1.0,),)), divisor=1.0)
def convolve(img, weights, divisor):
    return convolved(img, np.array(weights, float) / divisor)


def disc(radius: int) -> np.ndarray:
    x = np.arange(-radius, radius + 1)
    return (x[:, None] ** 2 + x[None, :] ** 2 <= (radius + 0.5) ** 2).astype(float)


def polygon(radius: int, sides: int, degrees: float) -> np.ndarray:
    """Places within radius + 1/2 of the centre along each side's normal."""
    x = np.arange(-radius, radius + 1)
    turn = np.radians(degrees) + 2 * np.pi * np.arange(sides) / sides
    far = x[None, :, None] * np.cos(turn) + x[:, None, None] * np.sin(turn)
    return (far <= radius + 0.5).all(-1).astype(float)


def _mean_under(img, shape):
    return convolved(img, shape / max(shape.sum(), 1e-6))


@kernel("bokeh_blur", "spatial", {"radius": 2, "shape": 1}, halo=lambda radius, shape: radius, radius=(5, 1, 50), shape=(0, 0, 1))
def bokeh_blur(img, radius, shape):
    return _mean_under(img, polygon(radius, 6, 0.0) if shape else disc(radius))


@kernel("lens_blur", "spatial", {"radius": 3, "blade_count": 5, "rotation": 20.0}, halo=lambda radius, **_: radius, radius=(5, 0, 50), blade_count=(0, 0, 12), rotation=(0.0, 0.0, 360.0))
def lens_blur(img, radius, blade_count, rotation):
    return _mean_under(img, polygon(radius, blade_count, rotation) if blade_count > 2 else disc(radius)) if radius else img


@kernel("median", "spatial", {"radius": 1}, halo=lambda radius: radius, radius=(1, 0, 50))
def median(img, radius):
    span = range(-radius, radius + 1)
    stack = np.stack([p[..., :3] for _, p in shifted(img, [(dy, dx, 1) for dy in span for dx in span])])
    n = len(stack) // 2
    return painted(img, np.partition(stack, n, axis=0)[n])


@kernel("motion_blur", "spatial", {"angle": 30.0, "length": 3.0}, halo=lambda angle, length: math.ceil(length) // 2 + 1, angle=(0.0, 0.0, 360.0), length=(10.0, 0.0, 200.0))
def motion_blur(img, angle, length):
    if length <= 0:
        return img
    steps = math.ceil(length)
    t = np.arange(steps + 1) - steps * 0.5
    # a place moved by a step rounds as the step does, halves up
    halves = lambda v: np.floor(v + 0.5).astype(int)
    dx, dy = halves(t * math.cos(math.radians(angle))), halves(t * math.sin(math.radians(angle)))
    return sum(p for _, p in shifted(img, [(int(b), int(a), 1) for a, b in zip(dx, dy, strict=True)])) / (steps + 1)


def sampled(img, sx, sy):
    """Nearest pixels at real places, the border extended."""
    h, w = img.shape[:2]
    return img[np.clip(rounded(sy), 0, h - 1), np.clip(rounded(sx), 0, w - 1)]


@kernel("spin_blur", "spatial", {"angle": 20.0}, center_x=(0.5, *UNIT), center_y=(0.5, *UNIT), angle=(10.0, 0.0, 360.0))
def spin_blur(img, center_x, center_y, angle):
    if abs(angle) < 1e-6:
        return img
    h, w = img.shape[:2]
    x, y = places(img)
    cx, cy, turn = center_x * w, center_y * h, math.radians(angle)
    n = min(max((math.ceil(2 * abs(turn) * math.hypot(w, h) * 0.5) + 2) | 1, 3), 129)
    dx, dy = x - cx, y - cy
    out = 0
    for i in range(n):
        t = turn * (i - n // 2) / n
        out = out + sampled(img, cx + dx * math.cos(t) - dy * math.sin(t), cy + dx * math.sin(t) + dy * math.cos(t))
    return out / n


@kernel("zoom_blur", "spatial", {"factor": 0.4}, center_x=(0.5, *UNIT), center_y=(0.5, *UNIT), factor=(0.1, *SIGNED))
def zoom_blur(img, center_x, center_y, factor):
    if abs(factor) < 1e-6:
        return img
    h, w = img.shape[:2]
    x, y = places(img)
    dx, dy = center_x * w - x, center_y * h - y
    n = np.clip(np.ceil(np.hypot(dx, dy) * abs(factor)), 3, 64)
    total = np.zeros_like(img)
    for s in range(int(n.max())):
        t = s * factor / n
        total += sampled(img, x + dx * t, y + dy * t) * (s < n)[..., None]
    return total / n[..., None]


@kernel("tilt_shift", "spatial", {"blur_radius": 0.9, "angle": 20.0}, focus_position=(0.5, *UNIT), band_size=(0.2, *UNIT), blur_radius=(8.0, 0.0, 100.0), angle=(0.0, 0.0, 360.0))
def tilt_shift(img, focus_position, band_size, blur_radius, angle):
    if blur_radius <= 0 or band_size >= 1:
        return img
    h, w = img.shape[:2]
    x, y = places(img)
    far = np.abs((x / w - 0.5) * math.sin(math.radians(angle)) + (y / h - focus_position) * math.cos(math.radians(angle)))
    d = np.clip((far - band_size / 2) / max(band_size / 2, 0.05), 0, 1)
    return img + (d * d * (3 - 2 * d))[..., None] * (gauss(img, blur_radius) - img)


def to_lab(rgb: np.ndarray) -> np.ndarray:
    v = rgb @ mx.SRGB_TO_XYZ_SHORT.T / np.array(mx.D65_WHITE)
    d = 6 / 29
    f = np.where(v > d**3, np.cbrt(v), v / (3 * d * d) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def from_lab(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] + 16) / 116
    f = np.stack([lab[..., 1] / 500 + y, y, y - lab[..., 2] / 200], -1)
    d = 6 / 29
    return np.where(f > d, f**3, 3 * d * d * (f - 4 / 29)) * np.array(mx.D65_WHITE) @ mx.XYZ_TO_SRGB_SHORT.T


def edge_kept(img, diameter, sigma_color, sigma_space):
    r = diameter // 2
    lab = to_lab(img[..., :3])
    both = np.concatenate([img[..., :3], lab], -1)
    total, weight = 0, 0
    for k, p in shifted(both, [(dy, dx, math.exp(-0.5 * (dx * dx + dy * dy) / sigma_space**2)) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]):
        own = k * np.exp(-0.5 * ((p[..., 3:] - lab) ** 2).sum(-1, keepdims=True) / sigma_color**2)
        total, weight = total + own * p[..., :3], weight + own
    return np.where(weight > 1e-10, total / np.where(weight > 1e-10, weight, 1), 0)


@kernel("bilateral", "spatial", {"diameter": 5, "sigma_color": 0.9, "sigma_space": 3.0}, halo=lambda diameter, **_: diameter // 2, diameter=(5, 1, 50), sigma_color=(0.1, 0.0, 1.0), sigma_space=(10.0, 0.0, 100.0))
def bilateral(img, diameter, sigma_color, sigma_space):
    return painted(img, edge_kept(img, diameter, max(sigma_color, 1e-9), max(sigma_space, 1e-9)))


@kernel("smart_sharpen", "spatial", {"radius": 2, "threshold": 0.9}, halo=lambda radius, **_: radius, amount=(1.0, 0.0, 5.0), radius=(3, 1, 20), threshold=(0.1, 0.01, 1.0))
def smart_sharpen(img, amount, radius, threshold):
    return painted(img, img[..., :3] + amount * (img[..., :3] - edge_kept(img, 2 * radius + 1, threshold, radius)))


SOBEL, SCHARR = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float), np.array([[-3, 0, 3], [-10, 0, 10], [-3, 0, 3]], float)


def slope(plane: np.ndarray, weights: np.ndarray, border: str = "edge") -> tuple[np.ndarray, np.ndarray]:
    return convolved(plane, weights, border), convolved(plane, weights.T, border)


@kernel("sobel", "spatial", {"scale": 1.5}, halo=lambda scale: 1, scale=(1.0, 0.1, 5.0))
def sobel(img, scale):
    return painted(img, np.hypot(*slope(luma(img), SOBEL)) * scale)


@kernel("scharr", "spatial", {"scale": 1.5}, halo=lambda scale: 1, scale=(1.0, 0.1, 5.0))
def scharr(img, scale):
    return painted(img, np.hypot(*slope(luma(img), SCHARR)) * scale / 32)


@kernel("laplacian", "spatial", {"scale": 1.5}, halo=lambda scale: 1, scale=(1.0, 0.1, 5.0))
def laplacian(img, scale):
    return painted(img, np.abs(convolved(luma(img), np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float), "edge")) * scale)


@kernel("emboss", "effect", halo=lambda: 1)
def emboss(img):
    return painted(img, convolved(img[..., :3], np.array([[-2, -1, 0], [-1, 1, 1], [0, 1, 2]], float)) + 0.5)


@kernel("charcoal", "effect", {"sigma": 0.7}, halo=lambda radius, sigma: reach(sigma) + 1, radius=(1.0, 0.0, 20.0), sigma=(1.0, 0.0, 20.0))
def charcoal(img, radius, sigma):
    drawn = painted(img, np.minimum(np.hypot(*slope(luma(img), SOBEL, "mirror")), 1))
    soft = gauss(drawn, sigma)
    soft[..., :3] = 1 - soft[..., :3]
    return soft


@kernel("adaptive_threshold", "spatial", {"radius": 2}, halo=lambda radius, offset: radius, radius=(5, 1, 50), offset=(0.02, -0.5, 0.5))
def adaptive_threshold(img, radius, offset):
    """Luma against the mean of the window, as far as it lies in the image."""
    y = luma(img)
    table = np.zeros((y.shape[0] + 1, y.shape[1] + 1))
    table[1:, 1:] = y.cumsum(0).cumsum(1)
    r0, r1 = (np.clip(np.arange(y.shape[0]) + d, 0, y.shape[0]) for d in (-radius, radius + 1))
    c0, c1 = (np.clip(np.arange(y.shape[1]) + d, 0, y.shape[1]) for d in (-radius, radius + 1))
    area = (r1 - r0)[:, None] * (c1 - c0)[None, :]
    total = table[r1][:, c1] - table[r0][:, c1] - table[r1][:, c0] + table[r0][:, c0]
    return painted(img, (y >= total / area - offset).astype(float))


@kernel("canny", "spatial", {"low": 0.1, "high": 0.5}, low=(0.1, *UNIT), high=(0.3, *UNIT))
def canny(img, low, high):
    r = math.ceil(1.4 * 3)
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * 1.4**2))
    gx, gy = slope(luma(separable(img, k / k.sum(), "edge")), SOBEL)
    size, turn = np.hypot(gx, gy), np.degrees(np.arctan2(gy, gx)) % 180
    big = padded(size, 1, "edge")
    at = lambda dy, dx: big[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    choice = np.digitize(turn, [22.5, 67.5, 112.5, 157.5]) % 4
    peak = np.zeros(size.shape, bool)
    for k, (dx, dy) in enumerate(((1, 0), (1, 1), (0, 1), (-1, 1))):
        peak |= (choice == k) & (size >= at(dy, dx)) & (size >= at(-dy, -dx))
    size = np.where(peak, size, 0)
    strong, weak = size >= high, size >= low
    while True:  # strong edges spread over weak ones
        ring = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in range(3):
            for dx in range(3):
                near |= ring[dy : dy + strong.shape[0], dx : dx + strong.shape[1]]
        grown = strong | (near & weak)
        if (grown == strong).all():
            return painted(img, strong.astype(float))
        strong = grown


# morphology


def extreme(img: np.ndarray, radius: int, f) -> np.ndarray:
    """Least or greatest colour in a square window, along rows and then columns."""
    out = img[..., :3]
    h, w = out.shape[:2]
    for axis in (1, 0):
        big = padded(out, radius * (axis == 0), "edge", radius * (axis == 1))
        parts = [big[:, i : i + w] if axis else big[i : i + h] for i in range(2 * radius + 1)]
        out = f.reduce(parts)
    return painted(img, out)


def _morph(name: str, looks: int, f) -> None:
    kernel(name, "morphology", {"radius": 1}, halo=lambda radius: looks * radius, radius=(2 if "hat" in name else 1, 1, 20))(f)


def opened(img, radius):
    return extreme(extreme(img, radius, np.minimum), radius, np.maximum)


def closed(img, radius):
    return extreme(extreme(img, radius, np.maximum), radius, np.minimum)


_morph("dilate", 1, lambda img, radius: extreme(img, radius, np.maximum))
_morph("erode", 1, lambda img, radius: extreme(img, radius, np.minimum))
_morph("morph_open", 2, opened)
_morph("morph_close", 2, closed)
_morph("morph_gradient", 1, lambda img, radius: painted(img, np.abs(extreme(img, radius, np.maximum) - extreme(img, radius, np.minimum))[..., :3]))
_morph("morph_tophat", 2, lambda img, radius: painted(img, np.maximum(img - opened(img, radius), 0)[..., :3]))
_morph("morph_blackhat", 2, lambda img, radius: painted(img, np.maximum(closed(img, radius) - img, 0)[..., :3]))


@kernel("skeletonize", "morphology", {"threshold": 0.4}, threshold=(0.5, *UNIT), max_iterations=(0, 0, 10000))
def skeletonize(img, threshold, max_iterations):
    """Thinning after Zhang and Suen; the outermost pixels stay."""
    on = luma(img) > threshold
    h, w = on.shape
    if h > 2 and w > 2:
        for _ in range(max_iterations or max(min(w, h) // 2, 1)):
            before = on.copy()
            for first in (True, False):
                # neighbours clockwise from the one above
                around = [on[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy, dx in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                count = sum(p.astype(int) for p in around)
                turns = sum((~a & b).astype(int) for a, b in zip(around, around[1:] + around[:1], strict=True))
                up, right, down, left = around[::2]
                free = ~(up & right & down) & ~(right & down & left) if first else ~(up & right & left) & ~(up & down & left)
                on[1:-1, 1:-1] &= ~((count >= 2) & (count <= 6) & (turns == 1) & free)
            if (before == on).all():
                break
    return painted(img, on.astype(float))


# enhancement


def _log_ratio(img, sigma):
    return np.log(np.maximum(img[..., :3], 1e-10)) - np.log(np.maximum(gauss(img, sigma)[..., :3], 1e-10))


SCALES = {"sigma_small": (15.0, 0.0, 200.0), "sigma_medium": (80.0, 0.0, 200.0), "sigma_large": (250.0, 0.0, 500.0)}
SMALL = {"sigma_small": 0.5, "sigma_medium": 0.8, "sigma_large": 1.2}


@kernel("retinex_ssr", "enhancement", {"sigma": 0.8}, sigma=(80.0, 0.0, 200.0))
def retinex_ssr(img, sigma):
    return painted(img, stretched(_log_ratio(img, sigma)))


@kernel("retinex_msr", "enhancement", SMALL, **SCALES)
def retinex_msr(img, **sigmas):
    return painted(img, stretched(sum(_log_ratio(img, s) for s in sigmas.values()) / 3))


@kernel("retinex_msrcr", "enhancement", SMALL, **SCALES, alpha=(125.0, 0.0, 200.0), beta=(46.0, 0.0, 100.0))
def retinex_msrcr(img, alpha, beta, **sigmas):
    total = img[..., :3].sum(-1, keepdims=True)
    share = np.where(total > 1e-10, img[..., :3] / np.where(total > 1e-10, total, 1), 1 / 3)
    gain = beta * np.maximum(np.log(np.maximum(alpha * share, 1e-300)), -10)
    return painted(img, stretched(gain * sum(_log_ratio(img, s) for s in sigmas.values()) / 3))


def _clipped_min(plane: np.ndarray, r: int) -> np.ndarray:
    return extreme(np.repeat(plane[..., None], 4, -1), r, np.minimum)[..., 0]


@kernel("dehaze", "enhancement", {"patch_radius": 2}, patch_radius=(7, 1, 50), omega=(0.95, *UNIT), t_min=(0.1, *UNIT))
def dehaze(img, patch_radius, omega, t_min):
    rgb = img[..., :3]
    dark = _clipped_min(rgb.min(-1), patch_radius)
    n = max(math.ceil(dark.size * 0.001), 1)
    bright = np.argsort(-dark.ravel(), kind="stable")[:n]
    air = rgb.reshape(-1, 3)[bright].sum(0) / n
    t = 1 - omega * _clipped_min((rgb / np.maximum(air, 1e-10)).min(-1), patch_radius)
    return painted(img, (rgb - air) / np.maximum(t, t_min)[..., None] + air)


@kernel("shadow_highlight", "enhancement", {"shadows": 60.0, "highlights": 30.0, "radius": 0.9, "shadows_ccorrect": 70.0}, shadows=(0.0, -100.0, 100.0), highlights=(0.0, -100.0, 100.0), whitepoint=(0.0, -100.0, 100.0), radius=(30.0, 0.0, 200.0), compress=(50.0, 0.0, 100.0), shadows_ccorrect=(50.0, 0.0, 100.0), highlights_ccorrect=(50.0, 0.0, 100.0))
def shadow_highlight(img, shadows, highlights, whitepoint, radius, compress, shadows_ccorrect, highlights_ccorrect):
    y = luma(img)
    soft = gauss(y[..., None], radius)[..., 0]
    mid = 1 - compress / 100 * 4 * soft * (1 - soft) if compress > 0 else 1
    dark, light = (1 - soft) ** 2 * mid, soft**2 * mid
    old = np.maximum(y, 1e-10)
    new = np.maximum(old + shadows / 100 * dark - highlights / 100 * light + whitepoint * 0.01, 0)
    chroma = img[..., :3] - old[..., None]
    sign = np.where(np.signbit(chroma), -1.0, 1.0)
    gain = 1 + sign * (dark * (shadows_ccorrect / 100 - 1) + light * (highlights_ccorrect / 100 - 1))[..., None]
    return painted(img, new[..., None] + chroma * np.maximum(gain, 0) * (new / old)[..., None])


@kernel("vignette", "enhancement", {"sigma": 0.9, "x_inset": 2}, sigma=(10.0, 0.0, 100.0), x_inset=(0, 0, 1000), y_inset=(0, 0, 1000))
def vignette(img, sigma, x_inset, y_inset):
    h, w = img.shape[:2]
    x, y = places(img)
    u, v = (x - w / 2) / max(w / 2 - x_inset, 1), (y - h / 2) / max(h / 2 - y_inset, 1)
    mask = gauss((u * u + v * v <= 1).astype(float)[..., None], sigma)
    return painted(img, img[..., :3] * mask)


@kernel("pyramid_detail_remap", "enhancement", {"sigma": 0.3}, sigma=(0.5, 0.0, 5.0), levels=(0, 0, 10))
def pyramid_detail_remap(img, sigma, levels):
    """Detail against the next coarser level is compressed, level by level; each level is compared with the coarser one as it was."""
    h, w = img.shape[:2]
    levels = levels or min(max(int(math.log2(min(w, h))) - 2, 3), 7)
    pyramid = [img[..., :3].copy()]
    for _ in range(levels):
        p = pyramid[-1]
        rows, cols = np.arange(-(-p.shape[0] // 2)) * 2, np.arange(-(-p.shape[1] // 2)) * 2
        r1, c1 = np.minimum(rows + 1, p.shape[0] - 1), np.minimum(cols + 1, p.shape[1] - 1)
        pyramid.append((p[rows][:, cols] + p[rows][:, c1] + p[r1][:, cols] + p[r1][:, c1]) / 4)
    fine, coarse = pyramid[0], pyramid[1]
    up = coarse[np.arange(h) // 2][:, np.arange(w) // 2]
    detail = fine - up
    return painted(img, up + (detail * sigma / (sigma + np.abs(detail)) if abs(sigma) > 1e-10 else 0))


@kernel("nlm_denoise", "enhancement", {"h": 0.4, "patch_radius": 1, "search_radius": 2}, halo=lambda h, patch_radius, search_radius: patch_radius + search_radius, h=(0.1, *UNIT), patch_radius=(3, 1, 10), search_radius=(10, 1, 30))
def nlm_denoise(img, h, patch_radius, search_radius):
    """Each shift of the image is compared with it by the mean of squared differences over patches, which is a box filter."""
    if h * h < 1e-10:
        return img
    p, s = patch_radius, search_radius
    rgb = img[..., :3]
    rows, cols = rgb.shape[:2]
    ry, rx = mirror(rows, p, p), mirror(cols, p, p)
    own = rgb[ry][:, rx]
    total, weight = np.zeros_like(rgb), np.zeros((rows, cols, 1))
    for dy in range(-s, s + 1):
        ny = mirror(rows, s, s)[s + dy : s + dy + rows]
        for dx in range(-s, s + 1):
            nx = mirror(cols, s, s)[s + dx : s + dx + cols]
            gap = np.zeros((rows, cols))
            for a in range(-p, p + 1):
                ya = mirror(rows, p, p)[ny + a + p]
                for b in range(-p, p + 1):
                    xb = mirror(cols, p, p)[nx + b + p]
                    gap += ((own[p + a : p + a + rows, p + b : p + b + cols] - rgb[ya][:, xb]) ** 2).sum(-1)
            k = np.exp(-gap / (3 * (2 * p + 1) ** 2) / (h * h))[..., None]
            total += k * rgb[ny][:, nx]
            weight += k
    return painted(img, total / np.where(weight > 1e-10, weight, 1))


@kernel("clahe", "enhancement", {"tile_grid": 2, "clip_limit": 3.0}, tile_grid=(8, 1, 32), clip_limit=(2.0, 0.0, 100.0))
def clahe(img, tile_grid, clip_limit):
    h, w = img.shape[:2]
    th, tw = h // tile_grid, w // tile_grid
    if not th or not tw:
        return img
    y = np.clip(luma(img), 0, 1)
    level = np.minimum(y * 255 + 0.5, 255).astype(int)
    clip = int(max(clip_limit * th * tw / 256, 1))
    tiles = level[: th * tile_grid, : tw * tile_grid].reshape(tile_grid, th, tile_grid, tw).transpose(0, 2, 1, 3).reshape(-1, th * tw)
    counts = np.stack([np.bincount(t, minlength=256) for t in tiles])
    excess = np.maximum(counts - clip, 0).sum(1)
    counts = np.minimum(counts, clip) + (excess // 256)[:, None]
    for row, rest in zip(counts, excess % 256, strict=True):
        if rest:
            row[np.arange(0, 256, max(256 // rest, 1))[:rest]] += 1
    table = np.clip(np.rint(counts.cumsum(1) * (255 / (th * tw))), 0, 255).reshape(tile_grid, tile_grid, 256)

    def axis(n, size):
        at = np.arange(n) / size - 0.5
        low = np.clip(np.floor(at), 0, tile_grid - 1).astype(int)
        return low, np.minimum(low + 1, tile_grid - 1), np.clip(at - low, 0, 1)

    (y0, y1, v), (x0, x1, u) = axis(h, th), axis(w, tw)
    v, u = v[:, None], u[None, :]
    read = lambda a, b: table[a[:, None], b[None, :], level]
    new = (read(y0, x0) * (1 - u) + read(y0, x1) * u) * (1 - v) + (read(y1, x0) * (1 - u) + read(y1, x1) * u) * v
    return painted(img, img[..., :3] * (new / 255 / np.maximum(y, 1e-10))[..., None])


# effects


@kernel("oil_paint", "effect", {"radius": 2}, halo=lambda radius: radius, radius=(4, 1, 20))
def oil_paint(img, radius):
    """The colour of the pixel with which a level of intensity first reaches the most pixels in the window, in raster order."""
    level = np.minimum(np.maximum(img[..., :3] @ np.array([0.212656, 0.715158, 0.072186]), 0) * 255 + 0.5, 255).astype(np.int64)
    h, w = level.shape
    span = range(-radius, radius + 1)
    stack = np.concatenate([img, level[..., None]], -1)
    parts = [p for _, p in shifted(stack, [(dy, dx, 1) for dy in span for dx in span], "edge")]
    rows = np.arange(h)[:, None], np.arange(w)[None, :]
    count = np.zeros((h, w, 256), np.int32)
    most, best = np.zeros((h, w), np.int32), img[..., :3].copy()
    for p in parts:
        k = p[..., 4].astype(int)
        count[*rows, k] += 1
        now = count[*rows, k]
        lead = now > most
        most = np.where(lead, now, most)
        best[lead] = p[..., :3][lead]
    return painted(img, best)


@kernel("halftone", "effect", {"dot_size": 2.0}, dot_size=(8.0, 1.0, 50.0), angle_offset=(0.0, 0.0, 360.0))
def halftone(img, dot_size, angle_offset):
    """Dots of cyan, magenta, yellow and black on turned grids; a dot covers what lies within its radius less a half."""
    h, w = img.shape[:2]
    x, y = places(img)
    cell = 2 * max(dot_size, 1)
    ink = []
    for k, degrees in enumerate((15, 75, 0, 45)):
        c, s = math.cos(math.radians(degrees + angle_offset)), math.sin(math.radians(degrees + angle_offset))
        u, v = x * c + y * s, y * c - x * s
        cu, cv = rounded(u / cell) * cell, rounded(v / cell) * cell
        # the way back adds the sine where an inverse would subtract it
        px, py = np.clip(cu * c + cv * s, 0, w - 1).astype(int), np.clip(cu * s + cv * c, 0, h - 1).astype(int)
        rgb = img[py, px, :3]
        black = 1 - rgb.max(-1)
        full = np.where(black < 1, 1 / np.where(black < 1, 1 - black, 1), 0)
        density = black if k == 3 else (1 - rgb[..., k] - black) * full
        dot = max(dot_size, 1) * np.sqrt(np.maximum(density, 0))
        ink.append((np.hypot(u - cu, v - cv) <= dot - 0.5).astype(float))
    return painted(img, np.stack([(1 - ink[k]) * (1 - ink[3]) for k in range(3)], -1))


@kernel("glitch", "effect", {"shift_amount": 6.0, "channel_offset": 3.0, "intensity": 0.8, "band_height": 2}, shift_amount=(20.0, 0.0, 200.0), channel_offset=(10.0, 0.0, 100.0), intensity=(0.5, *UNIT), band_height=(8, 1, 100), seed=(42, 0, 100))
def glitch(img, shift_amount, channel_offset, intensity, band_height, seed):
    h, w = img.shape[:2]
    noise = place_noise(np.arange(h) // band_height, 0, seed ^ SEEDS["glitch"])
    hit = np.abs(noise) > 1 - intensity
    move, split = (np.where(hit, np.trunc(noise * k), 0).astype(int) for k in (shift_amount, channel_offset))
    out = img.copy()
    for c, k in enumerate((1, 0, -1)):
        at = np.arange(w)[None, :] + (move + k * split)[:, None]
        at = np.where(at < 0, np.minimum(-at, w - 1), np.where(at >= w, np.maximum(2 * w - at - 2, 0), at))
        out[..., c] = img[np.arange(h)[:, None], at, c]
    return out


@kernel("mirror_kaleidoscope", "effect", {"segments": 3, "mode": 2, "angle": 20.0}, segments=(4, 2, 32), angle=(0.0, 0.0, 360.0), mode=(0, 0, 2))
def mirror_kaleidoscope(img, segments, angle, mode):
    h, w = img.shape[:2]
    if mode < 2:
        n = (h if mode else w)
        size = n // segments
        if not size:
            return img
        at = np.arange(n)
        at = np.where(at // size % 2 == 0, at % size, size - 1 - at % size)
        return img[at] if mode else img[:, at]
    x, y = places(img)
    dx, dy = x - w / 2, y - h / 2
    base, part = math.radians(angle), 2 * np.pi / segments
    turn = np.arctan2(dy, dx) - base
    turn = np.where(turn < 0, turn + 2 * np.pi, turn)
    k = np.maximum(np.floor(turn / part), 0)
    local = turn - k * part
    mapped = np.where(k % 2 == 0, local, part - local) + base
    far = np.hypot(dx, dy)
    sx, sy = rounded(w / 2 + far * np.cos(mapped)), rounded(h / 2 + far * np.sin(mapped))
    fold = lambda v, n: np.where(v < 0, np.minimum(-v, n - 1), np.where(v >= n, np.maximum(2 * n - v - 2, 0), v))
    return img[fold(sy, h), fold(sx, w)]


SEED = Param(42, 0, (1 << 63) - 1)


@kernel("gaussian_noise", "effect", {"amount": 50.0}, amount=(10.0, 0.0, 100.0), mean=(0.0, -255.0, 255.0), sigma=(25.0, 0.0, 255.0), seed=SEED)
def gaussian_noise(img, amount, mean, sigma, seed):
    if amount <= 0:
        return img
    n = Sequence(seed, "gaussian").gaussian(img[..., :3].size).reshape(*img.shape[:2], 3)
    return painted(img, img[..., :3] + (mean / 255 + sigma / 255 * n) * amount / 100)


@kernel("uniform_noise", "effect", {}, range=(25.0, 0.0, 255.0), seed=SEED)
def uniform_noise(img, range, seed):
    if range <= 0:
        return img
    return painted(img, img[..., :3] + (Sequence(seed, "uniform").unit(img[..., :3].size).reshape(*img.shape[:2], 3) * 2 - 1) * range / 255)


@kernel("salt_pepper_noise", "effect", {"density": 0.2}, density=(0.05, *UNIT), seed=SEED)
def salt_pepper_noise(img, density, seed):
    """A pixel draws once, and once more if it is hit."""
    draws = Sequence(seed, "salt_pepper").unit(2 * img.shape[0] * img.shape[1])
    out = img.reshape(-1, 4).copy()
    at = 0
    for i in range(len(out)):
        if draws[at] < density:
            at += 1
            out[i, :3] = 0.0 if draws[at] < 0.5 else 1.0
        at += 1
    return out.reshape(img.shape)


@kernel("poisson_noise", "effect", {"scale": 12.0}, scale=(100.0, 0.1, 1000.0), seed=SEED)
def poisson_noise(img, scale, seed):
    """Counts of mean v * scale: a rounded bell above 10, else products of draws (Knuth)."""
    rng = Sequence(seed, "poisson")
    mean = np.maximum(np.maximum(img[..., :3], 0) * scale, 0.001).ravel()
    draw = rng.units(min(4 * mean.size, 1 << 16)).__next__
    out = np.empty_like(mean)
    for start in range(0, mean.size, 1 << 16):
        bells, pairs = [], []
        for i, m in enumerate(mean[start : start + (1 << 16)].tolist(), start):
            if m > 10:
                bells.append(i)
                pairs += draw(), draw()
            else:
                limit, p, k = math.exp(-m), draw(), 0
                while p > limit:
                    p *= draw()
                    k += 1
                out[i] = k
        if bells:
            out[bells] = mean[bells] + np.sqrt(mean[bells]) * normal(np.array(pairs))
    return painted(img, out.reshape(*img.shape[:2], 3) / scale)


@kernel("film_grain", "effect", {"size": 2.0, "amount": 0.4}, amount=(0.1, *UNIT), size=(1.0, 1.0, 10.0), seed=SEED)
def film_grain(img, amount, size, seed):
    if amount <= 0:
        return img
    h, w = img.shape[:2]
    gw, gh = math.ceil(w / size), math.ceil(h / size)
    grain = Sequence(seed, "film_grain").gaussian(gw * gh).reshape(gh, gw) * amount
    at = grain[np.minimum((np.arange(h) / size).astype(int), gh - 1)][:, np.minimum((np.arange(w) / size).astype(int), gw - 1)]
    y = np.clip(luma(img), 0, 1)
    return painted(img, img[..., :3] + (at * 4 * y * (1 - y))[..., None])


@kernel("film_grain_grading", "grading", {"size": 2.0, "amount": 0.4, "color": True}, amount=(0.1, *UNIT), size=(1.0, 0.1, 10.0), color=False, seed=(42, 0, 100))
def film_grain_grading(img, amount, size, color, seed):
    h, w = img.shape[:2]
    x, y = np.meshgrid((np.arange(w) / max(size, 0.1)).astype(np.int64), (np.arange(h) / max(size, 0.1)).astype(np.int64))
    v = luma(img)
    strength = (4 * v * (1 - v) * amount)[..., None]
    base = seed ^ SEEDS["film_grain"]
    grain = np.stack([place_noise(x, y, base + k * color) for k in range(3)], -1)
    return painted(img, img[..., :3] + grain * strength)


# generators of noise


def _cloud(name: str, offsets, f, seed: int = 42, **spec) -> None:
    def run(img, scale, seed, **p):
        x, y = places(img)
        (ax, bx), (ay, by) = offsets
        v = f(x / scale + seed * ax + bx, y / scale + seed * ay + by, **p)
        return np.concatenate([np.repeat(v[..., None], 3, -1), np.ones((*v.shape, 1))], -1)

    kernel(name, "generator", {"scale": 6.0}, scale=spec.pop("scale", (50.0, 1.0, 200.0)), octaves=spec.pop("octaves", (4, 1, 8)), persistence=(0.5, *UNIT), seed=(seed, 0, 99999), **spec)(run)


_BASE = ((0.1, 0.0), (0.07, 0.0))
_cloud("perlin_noise", _BASE, lambda x, y, octaves, persistence: _fbm(value_noise, x, y, octaves, persistence))
_cloud("simplex_noise", ((0.13, 100.0), (0.09, 200.0)), lambda x, y, octaves, persistence: _fbm(value_noise, x, y, octaves, persistence), seed=7)
_cloud("fractal_noise", _BASE, lambda x, y, octaves, persistence, lacunarity: _fbm(value_noise, x, y, octaves, persistence, lacunarity), octaves=(6, 1, 10), lacunarity=(2.0, 1.0, 4.0))
_cloud(
    "cloud_noise", _BASE,
    lambda x, y, octaves, persistence, worley_blend: _fbm(value_noise, x, y, octaves, persistence) * (1 - worley_blend) + _fbm(lambda a, b: 1 - cellular(a, b), x, y, octaves, persistence) * worley_blend,
    scale=(60.0, 1.0, 200.0), octaves=(5, 1, 8), worley_blend=(0.4, *UNIT),
)


def _fbm(noise, x, y, n, persistence, lacunarity=2.0):
    return octaves(noise, x, y, n, persistence, lacunarity)


# palettes


def median_cut(img: np.ndarray, colors: int) -> np.ndarray:
    """Palette of the means of boxes; the box of the widest channel is halved at its median, the last one on ties."""
    flat = img[..., :3].reshape(-1, 3)
    boxes = [flat[:: max(len(flat) // 4096, 1)]]
    width = [np.ptp(boxes[0], axis=0).max()]
    while len(boxes) < colors:
        k = len(width) - 1 - int(np.argmax(width[::-1]))
        # the box taken out is replaced by the last one
        box, boxes[k], width[k] = boxes[k], boxes[-1], width[-1]
        boxes.pop()
        width.pop()
        if len(box) < 2:
            boxes.append(box)
            break
        box = box[np.argsort(box[:, int(np.argmax(np.ptp(box, axis=0)))], kind="stable")]
        halves = [box[: len(box) // 2], box[len(box) // 2 :]]
        boxes += halves
        width += [np.ptp(b, axis=0).max() for b in halves]
    return np.stack([b.mean(0) for b in boxes])


def snapped(rgb: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The nearest colour of the palette, the first on ties."""
    return palette[((rgb[..., None, :] - palette) ** 2).sum(-1).argmin(-1)]


@kernel("quantize", "color", {"max_colors": 6}, max_colors=(16, 2, 256))
def quantize(img, max_colors):
    return painted(img, snapped(img[..., :3], median_cut(img, max_colors)))


@kernel("kmeans_quantize", "color", {"k": 5}, k=(16, 2, 256), max_iterations=(20, 1, 100), seed=(42, 0, 100))
def kmeans_quantize(img, k, max_iterations, seed):
    flat = img[..., :3].reshape(-1, 3)
    picks = (place_hash(np.arange(k), 0, seed ^ SEEDS["kmeans"]) % np.uint64(len(flat))).astype(int)
    centers, sample = flat[picks].copy(), flat[:: max(len(flat) // 8192, 1)]
    for _ in range(max_iterations):
        near = ((sample[:, None] - centers) ** 2).sum(-1).argmin(1)
        count = np.bincount(near, minlength=k)
        means = np.stack([np.bincount(near, sample[:, c], k) for c in range(3)], 1) / np.maximum(count, 1)[:, None]
        moved = np.where(count[:, None] > 0, means, centers)
        still = np.abs(moved - centers).max() <= 1e-5
        centers = moved
        if still:
            break
    return painted(img, snapped(img[..., :3], centers))


def bayer(n: int) -> np.ndarray:
    """Threshold matrix of order n (a power of two), each step made of the one before."""
    m = np.array([[0, 2], [3, 1]]) / 4
    size = 2
    while size < n:
        base = np.tile(m * size * size, (2, 2))
        size *= 2
        m = (4 * base + np.kron([[0, 2], [3, 1]], np.ones((size // 2, size // 2))) + 0.5) / (size * size)
    return m


@kernel("dither_ordered", "color", {"max_colors": 5}, max_colors=(16, 2, 256), map_size=(4, 2, 16))
def dither_ordered(img, max_colors, map_size):
    h, w = img.shape[:2]
    m = bayer(map_size)
    bias = (m[np.arange(h)[:, None] % len(m), np.arange(w)[None, :] % len(m)] - 0.5) / max_colors
    return painted(img, snapped(img[..., :3] + bias[..., None], median_cut(img, max_colors)))


@kernel("dither_floyd_steinberg", "color", {"max_colors": 5}, max_colors=(16, 2, 256))
def dither_floyd_steinberg(img, max_colors):
    palette = median_cut(img, max_colors)
    h, w = img.shape[:2]
    # a ring around the image takes what is diffused outside
    work = np.zeros((h + 1, w + 2, 3))
    work[:h, 1:-1] = img[..., :3]
    for y in range(h):
        for x in range(1, w + 1):
            old = work[y, x].copy()
            new = palette[((old - palette) ** 2).sum(1).argmin()]
            work[y, x] = new
            rest = (old - new) / 16
            work[y, x + 1] += 7 * rest
            work[y + 1, x - 1 : x + 2] += np.array([3, 5, 1])[:, None] * rest
    return painted(img, work[:h, 1:-1])


@kernel("lab_sharpen", "color", {"radius": 0.8}, halo=lambda amount, radius: math.ceil(3 * radius), amount=(1.0, 0.0, 10.0), radius=(2.0, 0.0, 100.0))
def lab_sharpen(img, amount, radius):
    lab = to_lab(img[..., :3])
    r = math.ceil(radius * 3)
    if r:
        k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * radius**2))
        soft = separable(lab[..., :1], k / k.sum(), "edge")[..., 0]
        lab[..., 0] += amount * (lab[..., 0] - soft)
    lab[..., 0] = np.clip(lab[..., 0], 0, 100)
    return painted(img, from_lab(lab))


@kernel("feather", "mask", {"radius": 2}, halo=lambda radius: radius, radius=(3, 1, 50))
def feather(img, radius):
    k = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * (radius / 2) ** 2))
    out = img.copy()
    out[..., 3] = separable(img[..., 3:], k / k.sum(), "edge")[..., 0]
    return out


# tools and analysis


@kernel("flood_fill", "tool", {"tolerance": 0.6}, seed_x=(0.5, *UNIT), seed_y=(0.5, *UNIT), tolerance=(0.1, *UNIT), fill_r=(1.0, *UNIT), fill_g=(0.0, *UNIT), fill_b=(0.0, *UNIT))
def flood_fill(img, seed_x, seed_y, tolerance, fill_r, fill_g, fill_b):
    h, w = img.shape[:2]
    sx, sy = int(seed_x * w), int(seed_y * h)
    if sx >= w or sy >= h:
        return img
    alike = ((img[..., :3] - img[sy, sx, :3]) ** 2).sum(-1) <= tolerance**2
    region = np.zeros((h, w), bool)
    region[sy, sx] = True
    while True:  # grow into neighbours of like colour
        ring = np.pad(region, 1)
        grown = region | ((ring[:-2, 1:-1] | ring[2:, 1:-1] | ring[1:-1, :-2] | ring[1:-1, 2:]) & alike)
        if (grown == region).all():
            break
        region = grown
    out = img.copy()
    out[region, :3] = fill_r, fill_g, fill_b
    return out


@kernel("connected_components", "analysis", {"threshold": 0.4}, threshold=(0.5, *UNIT))
def connected_components(img, threshold):
    """Labels pass from the left, else from above, in one sweep without union; a label's colour turns by the golden angle."""
    on = luma(img) > threshold
    labels = np.zeros(on.shape, int)
    known = 0
    for y in range(on.shape[0]):
        for x in np.flatnonzero(on[y]):
            label = (labels[y, x - 1] if x else 0) or (labels[y - 1, x] if y else 0)
            if not label:
                known += 1
                label = known
            labels[y, x] = label
    hues = [(0.0, 0.0, 0.0), *(colorsys.hls_to_rgb(k * 137.508 % 360 / 360, 0.5, 0.8) for k in range(1, known + 1))]
    return painted(img, np.array(hues)[labels])


@kernel("harris_corners", "analysis", {}, halo=lambda k, radius: radius + 1, k=(0.04, 0.01, 0.3), radius=(1, 1, 5))
def harris_corners(img, k, radius):
    h, w = img.shape[:2]
    y = luma(img)
    r = radius
    at = lambda oy, ox: y[np.clip(np.arange(h) + oy, 0, h - 1)][:, np.clip(np.arange(w) + ox, 0, w - 1)]
    xx = yy = xy = 0
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            gx, gy = at(dy, dx + 1) - at(dy, dx - 1), at(dy + 1, dx) - at(dy - 1, dx)
            xx, yy, xy = xx + gx * gx, yy + gy * gy, xy + gx * gy
    return painted(img, np.clip((xx * yy - xy * xy - k * (xx + yy) ** 2) * 1000, 0, 1))


@kernel("hough_lines", "analysis", {"threshold": 0.3}, threshold=(0.5, *UNIT))
def hough_lines(img, threshold):
    """Vertical edges of luma inside the outermost pixels, which are cleared."""
    y = luma(img)
    out = np.zeros_like(img)
    edge = (np.abs(y[1:-1, 2:] - y[1:-1, :-2]) > threshold).astype(float)
    out[1:-1, 1:-1, :3] = edge[..., None]
    out[1:-1, 1:-1, 3] = img[1:-1, 1:-1, 3]
    return out


@kernel("template_match", "analysis", {"template_size": 4}, template_size=(16, 4, 64))
def template_match(img, template_size):
    """Mean product with the patch in the middle, where a patch fits."""
    h, w = img.shape[:2]
    t = template_size
    out = np.zeros_like(img)
    if h <= t or w <= t:
        return out
    y = luma(img)
    patch = y[h // 2 - t // 2 :, w // 2 - t // 2 :][:t, :t]
    view = np.lib.stride_tricks.sliding_window_view(y, (t, t))[: h - t, : w - t]
    out[: h - t, : w - t, :3] = np.minimum((view * patch).sum((2, 3)) / (t * t), 1)[..., None]
    out[: h - t, : w - t, 3] = 1
    return out


def carve(img: np.ndarray, seams: int) -> np.ndarray:
    """Vertical seams of least energy taken out one by one."""
    for _ in range(min(seams, img.shape[1] - 1)):
        h, w = img.shape[:2]
        rgb = img[..., :3]
        rows, cols = np.arange(h), np.arange(w)
        gx = rgb[:, np.minimum(cols + 1, w - 1)] - rgb[:, np.maximum(cols - 1, 0)]
        gy = rgb[np.minimum(rows + 1, h - 1)] - rgb[np.maximum(rows - 1, 0)]
        cost = np.sqrt((gx**2).sum(-1)) + np.sqrt((gy**2).sum(-1))
        for y in range(1, h):
            up = np.pad(cost[y - 1], 1, constant_values=np.inf)
            cost[y] += np.minimum(np.minimum(up[:-2], up[1:-1]), up[2:])
        seam = np.empty(h, int)
        seam[-1] = cost[-1].argmin()
        for y in range(h - 2, -1, -1):
            x = seam[y + 1]
            # straight up wins ties, then left
            seam[y] = min((c for c in (x, x - 1, x + 1) if 0 <= c < w), key=lambda c: (cost[y, c], (x, x - 1, x + 1).index(c)))
        keep = np.ones((h, w), bool)
        keep[rows, seam] = False
        img = img[keep].reshape(h, w - 1, 4)
    return img


@kernel("seam_carve_width", "transform", {"seams": 4}, seams=(50, 1, 500))
def seam_carve_width(img, seams):
    """The size stays; what is gained at the right is empty."""
    out = np.zeros_like(img)
    left = carve(img, seams)
    out[:, : left.shape[1]] = left
    return out


@kernel("seam_carve_height", "transform", {"seams": 4}, seams=(50, 1, 500))
def seam_carve_height(img, seams):
    return seam_carve_width(img.transpose(1, 0, 2), seams).transpose(1, 0, 2)


def crop_box(img: np.ndarray, ratio: float) -> tuple[int, int, int, int]:
    """(x, y, width, height) of the window of the most horizontal contrast in red, on a coarse grid, the first on ties."""
    h, w = img.shape[:2]
    cw, ch = min(max(int(w * ratio), 1), w), min(max(int(h * ratio), 1), h)
    contrast = np.zeros((h, w))
    contrast[:, :-1] = np.abs(np.diff(img[..., 0], axis=1))
    step = max(4, cw // 10)
    best = max(((contrast[y : y + ch : 4, x : x + cw : 4].sum(), -y, -x) for y in range(0, h - ch + 1, step) for x in range(0, w - cw + 1, step)))
    return -best[2], -best[1], cw, ch


@kernel("smart_crop", "transform", {"ratio": 0.6}, ratio=(0.75, 0.1, 1.0))
def smart_crop(img, ratio):
    x, y, w, h = crop_box(img, ratio)
    return img[y : y + h, x : x + w]


# scopes


class Scope:
    """A square black canvas to which dots of light add up."""

    def __init__(self, size: int):
        self.size, self.out = size, np.zeros((size, size, 4))
        self.out[..., 3] = 1.0

    def dots(self, x, y, rgb, light: float) -> None:
        """Dots of a colour; places are cut to integers, those outside are left out."""
        x, y = (np.trunc(v).astype(int).ravel() for v in np.broadcast_arrays(np.asarray(x, float), np.asarray(y, float)))
        rgb = np.broadcast_to(rgb, (len(x), 3))
        good = (x >= 0) & (y >= 0) & (x < self.size) & (y < self.size)
        np.add.at(self.out, (y[good], x[good], slice(0, 3)), rgb[good] * light)

    def line(self, x0, y0, x1, y1, rgb, light: float) -> None:
        n = int(max(abs(int(x1) - int(x0)), abs(int(y1) - int(y0)), 1))
        t = np.arange(n + 1) / n
        self.dots(rounded(int(x0) + (int(x1) - int(x0)) * t), rounded(int(y0) + (int(y1) - int(y0)) * t), np.array(rgb), light)

    def done(self) -> np.ndarray:
        return np.clip(self.out, 0, 1)


def _scope(name: str):
    return kernel(name, "analysis(scope)", {"scope_size": 64}, scope_size=(512, 64, 2048), log_scale=False)


@_scope("scope_histogram")
def scope_histogram(img, scope_size, log_scale):
    planes = [*np.clip(img[..., :3], 0, 1).transpose(2, 0, 1), np.clip(luma(img), 0, 1)]
    counts = [np.bincount(np.minimum(p * 255, 255).astype(int).ravel(), minlength=256) for p in planes]
    most = max(max(c.max() for c in counts[:3]), 1)
    scope = Scope(scope_size)
    x = (np.arange(256) / 255 * (scope_size - 1)).astype(int)
    height = [((np.log(c + 1) / math.log(most + 1) if log_scale else c / most) * (scope_size - 1)).astype(int) for c in counts]
    for k in range(256):
        for c in range(3):
            rgb = np.full(3, 0.1)
            rgb[c] = 0.9
            rows = scope_size - 1 - np.arange(height[c][k])
            scope.dots(x[k], rows, rgb, 0.5)
        if height[3][k]:
            scope.dots(x[k], np.array([scope_size - 1 - height[3][k]]), np.full(3, 0.7), 0.6)
    return scope.done()


@_scope("scope_waveform")
def scope_waveform(img, scope_size, log_scale):
    x, _ = places(img)
    scope = Scope(scope_size)
    scope.dots(x / img.shape[1] * (scope_size - 1), (1 - np.clip(luma(img), 0, 1)) * (scope_size - 1), np.array([0.2, 0.8, 0.2]), min(max(4 / img.shape[0], 0.02), 0.5))
    return scope.done()


@_scope("scope_parade")
def scope_parade(img, scope_size, log_scale):
    x, _ = places(img)
    scope, third = Scope(scope_size), scope_size // 3
    for c in range(3):
        rgb = np.full(3, 0.15)
        rgb[c] = 0.9
        scope.dots(np.trunc(x / img.shape[1] * (third - 2)) + c * third, (1 - np.clip(img[..., c], 0, 1)) * (scope_size - 1), rgb, min(max(4 / img.shape[0], 0.02), 0.5))
    for k in (1, 2):
        scope.line(k * third, 0, k * third, scope_size - 1, (0.3, 0.3, 0.3), 1.0)
    return scope.done()


def vectorscope_grid(scope_size: int) -> Scope:
    """The scope without an image: its circle, axes, line of skin and boxes of the colours."""
    scope, mid = Scope(scope_size), scope_size / 2
    r = mid - 2
    turn = np.arange(int(scope_size * math.pi)) / int(scope_size * math.pi) * 2 * np.pi
    scope.dots(mid + r * np.cos(turn), mid - r * np.sin(turn), np.full(3, 0.2), 1.0)
    scope.line(mid, 0, mid, scope_size - 1, (0.15, 0.15, 0.15), 1.0)
    scope.line(0, mid, scope_size - 1, mid, (0.15, 0.15, 0.15), 1.0)
    skin = math.radians(123)
    scope.line(mid, mid, mid + r * math.cos(skin), mid - r * math.sin(skin), (0.5, 0.4, 0.3), 0.6)
    for degrees, rgb in ((0, (1, 0, 0)), (120, (0, 1, 0)), (240, (0, 0, 1)), (180, (0, 0.8, 0.8)), (300, (0.8, 0, 0.8)), (60, (0.8, 0.8, 0))):
        x, y = int(mid + r * 0.75 * math.cos(math.radians(degrees))), int(mid - r * 0.75 * math.sin(math.radians(degrees)))
        dx, dy = np.meshgrid(np.arange(-2, 3), np.arange(-2, 3))
        scope.dots(x + dx, y + dy, np.array(rgb, float), 0.7)
    return scope


@_scope("scope_vectorscope")
def scope_vectorscope(img, scope_size, log_scale):
    scope, mid = vectorscope_grid(scope_size), scope_size / 2
    r = mid - 2
    rgb = np.clip(img[..., :3], 0, 1).reshape(-1, 3)
    hls = np.array([colorsys.rgb_to_hls(*p) for p in rgb.tolist()])
    some = hls[:, 2] >= 0.001
    turn, far = hls[some, 0] * 2 * np.pi, hls[some, 2] * r
    scope.dots(mid + far * np.cos(turn), mid - far * np.sin(turn), rgb[some] * 0.6 + 0.2, min(max(8 / len(rgb), 0.005), 0.3))
    return scope.done()


# repair


def _slopes(v, known, axis, both, one):
    """Slope of v along an axis: both(before, here, after) where both neighbours are known, one(low, high) where one is, else zero. v and known have a ring of one around the result."""
    take = lambda a, k: a[tuple(slice(1 + k * (i == axis), a.shape[i] - 1 + k * (i == axis)) for i in range(2))]
    before, here, after = (take(v, k) for k in (-1, 0, 1))
    low, high = (take(known, k)[..., None] for k in (-1, 1))
    return np.where(low & high, both(before, here, after), np.where(high, one(here, after), np.where(low, one(before, here), 0.0)))


def _arrival(t, known, y, x):
    """Time at which a front of unit speed reaches a place from its known neighbours, the least over the four quadrants."""
    best = np.inf
    for a in ((y - 1, x), (y + 1, x)):
        for b in ((y, x - 1), (y, x + 1)):
            ta, tb = (t[p] if known[p] else np.inf for p in (a, b))
            if abs(ta - tb) < 1:
                best = min(best, (ta + tb + math.sqrt(2 - (ta - tb) ** 2)) / 2)
            else:
                best = min(best, 1 + min(ta, tb))
    return best


def marched(level: np.ndarray, hole: np.ndarray, radius: int, flow: bool) -> np.ndarray:
    """Levels (h, w, channels) with the hole filled from its border inwards, in the order of a front of unit speed.

    A place is a weighted mean of the known places within the radius. By the fast marching method of Telea they weigh by
    nearness, by the front's time, and by the front's direction, and their gradient is added as one step of a level. By the
    method of Navier-Stokes (flow) they weigh by nearness and by how far along their lines of equal level they lie.
    """
    pad = radius + 1
    v = np.pad(level.astype(float), ((pad, pad), (pad, pad), (0, 0)))
    todo = np.pad(hole, pad)
    known = np.pad(~hole, pad)
    t = np.where(todo, 1e6, 0.0)
    dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1].astype(float)
    r2 = dy * dy + dx * dx
    inside = (r2 > 0) & (r2 <= radius * radius)
    r2 = np.where(r2 > 0, r2, 1.0)
    four = ((-1, 0), (0, -1), (1, 0), (0, 1))
    border = [(y, x) for y, x in zip(*np.nonzero(known), strict=True) if any(todo[y + a, x + b] for a, b in four)]
    heap = [(0.0, k, int(y), int(x)) for k, (y, x) in enumerate(border)]
    count = len(heap)
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for a, b in four:
            ny, nx = y + a, x + b
            if not todo[ny, nx]:
                continue
            todo[ny, nx] = False
            t[ny, nx] = _arrival(t, known, ny, nx)
            box = slice(ny - radius, ny + radius + 1), slice(nx - radius, nx + radius + 1)
            ring = slice(ny - radius - 1, ny + radius + 2), slice(nx - radius - 1, nx + radius + 2)
            near, sure = v[ring], known[ring]
            if flow:
                spread = [lambda p, c, n: np.abs(n - c) + np.abs(c - p), lambda p, n: 2 * np.abs(n - p)]
                up, across = (_slopes(near, sure, axis, *spread) for axis in (0, 1))
                along = dx[..., None] * up - dy[..., None] * across
                size = np.sqrt(r2[..., None] * (up * up + across * across))
                turn = np.where(np.abs(along) > 0.01, np.abs(along) / np.where(size > 0, size, 1), 1e-6)
                weight = turn * ((inside & known[box]) / (r2 * r2 + 1))[..., None]
                v[ny, nx] = (weight * v[box]).sum((0, 1)) / np.maximum(weight.sum((0, 1)), 1e-300)
            else:
                # the place itself counts as reached for the front's own slope
                own = known[ny - 1 : ny + 2, nx - 1 : nx + 2]
                front = [float(_slopes(t[ny - 1 : ny + 2, nx - 1 : nx + 2, None], own, axis, lambda p, c, n: (n - p) / 2, lambda p, n: n - p)[0, 0, 0]) for axis in (0, 1)]
                turn = dy * front[0] + dx * front[1]
                turn = np.where(np.abs(turn) > 0.01, np.abs(turn), 1e-6)
                weight = (turn * inside * known[box] / (r2 * np.sqrt(r2) * (1 + np.abs(t[box] - t[ny, nx]))))[..., None]
                step = [lambda p, c, n: 2 * (n - p), lambda p, n: n - p]
                jy, jx = ((weight * _slopes(near, sure, axis, *step) * d[..., None]).sum((0, 1)) for axis, d in ((0, dy), (1, dx)))
                v[ny, nx] = (weight * v[box]).sum((0, 1)) / (weight.sum((0, 1)) + 1e-20) + (jx + jy) / (np.sqrt(jx * jx + jy * jy) + 1e-20)
            v[ny, nx] = np.floor(np.clip(v[ny, nx], 0, 255) + 0.5)
            known[ny, nx] = True
            heapq.heappush(heap, (t[ny, nx], count, ny, nx))
            count += 1
    return v[pad:-pad, pad:-pad]


@kernel("inpaint", "repair", {"radius": 2}, radius=(3, 1, 50), method=(0, 0, 1))
def inpaint(img, radius, method):
    """Pixels of alpha zero are filled in 8-bit levels from the border of the known ones and become opaque; method 0 is Telea's, 1 that of Navier-Stokes."""
    hole = ~(img[..., 3] > 0)
    out = img.copy()
    if hole.all() or not hole.any():
        return out
    levels = np.floor(np.clip(img[..., :3], 0, 1) * 255 + 0.5)
    out[hole, :3] = marched(levels, hole, radius, bool(method))[hole] / 255
    out[hole, 3] = 1.0
    return out
