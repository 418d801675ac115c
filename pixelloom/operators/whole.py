"""Kernels of operators with statistics, for whole images: no pixel leaves its row."""

from __future__ import annotations

import math

import numpy as np

from pixelloom.operators import stats
from pixelloom.operators.kernels import luma, painted
from pixelloom.plans.registry import OPERATORS


assert stats  # registers the operators


def on_whole_images(name: str):
    """The kernel of an operator whose plan stays in use on rows of pixels, where it aggregates before it shuffles."""

    def wrap(f):
        OPERATORS[name].kernel, OPERATORS[name].narrow = f, True
        return f

    return wrap


@on_whole_images("auto_level")
def _(img):
    lo, hi = img[..., :3].min((0, 1)), img[..., :3].max((0, 1))
    return painted(img, (img[..., :3] - lo) / np.maximum(hi - lo, 1e-10))


@on_whole_images("white_balance_gray_world")
def _(img):
    means = img[..., :3].mean((0, 1))
    gain = np.where(means > 1e-10, means.mean() / np.where(means > 1e-10, means, 1), 1)
    return painted(img, img[..., :3] * gain)


@on_whole_images("match_color")
def _(img, target_mean_r, target_mean_g, target_mean_b, target_std, strength):
    rgb = img[..., :3]
    moved = (rgb - rgb.mean((0, 1))) * target_std / np.maximum(rgb.std((0, 1)), 1e-3) + np.array([target_mean_r, target_mean_g, target_mean_b])
    return painted(img, np.clip(rgb + (moved - rgb) * strength, 0, 1))


def _bins(plane):
    return np.minimum(np.maximum(plane, 0) * 255, 255).astype(int)


@on_whole_images("equalize")
def _(img):
    out = img.copy()
    for c in range(3):
        level = _bins(img[..., c])
        cdf = np.bincount(level.ravel(), minlength=256).cumsum()
        low = cdf[cdf > 0][0]
        if cdf[-1] > low:
            out[..., c] = (cdf[level] - low) / (cdf[-1] - low)
    return out


@on_whole_images("normalize")
def normalize(img, black_clip, white_clip):
    out = img.copy()
    for c in range(3):
        count = np.bincount(_bins(img[..., c]).ravel(), minlength=256)
        black = int(np.argmax(count.cumsum() >= math.floor(count.sum() * black_clip)))
        white = 255 - int(np.argmax(count[::-1].cumsum() >= math.floor(count.sum() * white_clip)))
        if white > black:
            out[..., c] = (img[..., c] - black / 255) / ((white - black) / 255)
    return out


@on_whole_images("contrast_stretch")
def _(img, black_pct, white_pct):
    out = normalize(img, black_pct, white_pct)
    out[..., :3] = np.clip(out[..., :3], 0, 1)
    return out


def _levels(img):
    v = luma(img) * 255
    return np.clip((np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(int), 0, 255)


def _parted(img, cut):
    return painted(img, (luma(img) >= (cut + 0.5) / 255).astype(float))


@on_whole_images("otsu_threshold")
def _(img):
    count = np.bincount(_levels(img).ravel(), minlength=256).astype(float)
    below, mass = count.cumsum(), (count * np.arange(256)).cumsum()
    above = below[-1] - below
    good = (below > 0) & (above > 0)
    gap = mass / np.where(good, below, 1) - (mass[-1] - mass) / np.where(good, above, 1)
    return _parted(img, int(np.argmax(np.where(good, below * above * gap**2, 0))))


@on_whole_images("triangle_threshold")
def _(img):
    count = np.bincount(_levels(img).ravel(), minlength=256)
    some = np.flatnonzero(count)
    left, right, peak = max(some[0] - 1, 0), min(some[-1] + 1, 255), int(count.argmax())
    flipped = peak - left < right - peak
    if flipped:
        left, peak, count = 255 - right, 255 - peak, count[::-1]
    i = np.arange(left + 1, peak + 1)
    far = count[peak] * i + (left - peak) * count[i] if len(i) else np.zeros(0)
    best = (int(i[far.argmax()]) if len(i) and far.max() > 0 else left) - 1
    return _parted(img, 255 - best if flipped else best)


@on_whole_images("pixelate")
def _(img, block_size):
    out = img.copy()
    for y in range(0, img.shape[0], block_size):
        for x in range(0, img.shape[1], block_size):
            out[y : y + block_size, x : x + block_size, :3] = img[y : y + block_size, x : x + block_size, :3].mean((0, 1))
    return out


