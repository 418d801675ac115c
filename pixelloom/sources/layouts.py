"""Raw pixels in twenty layouts: to and from RGBA arrays, and from one layout to another.

Samples are little-endian; 8 and 16 bits stand for [0, 1], floats for themselves.
A change of samples alone, or between RGB and RGBA, is direct; other changes of
both go through 8 bits, unless one side is rgba32f. Gray of 8-bit levels is
(77 r + 150 g + 29 b + 128) / 256, of rgba32f the luma of Rec. 709. Planar layouts
hold BT.601 luma and colour differences in full range, those averaged where they
are stored at half the size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_SAMPLES = {"8": ("u1", 255), "16": ("<u2", 65535), "16f": ("<f2", None), "32f": ("<f4", None)}
_INTERLEAVED = ("rgb8", "rgba8", "bgr8", "bgra8", "gray8", "gray16", "rgb16", "rgba16", "cmyk8", "cmyka8", "rgb16f", "rgba16f", "gray16f", "rgb32f", "rgba32f", "gray32f")
#: Halvings (down, across) of the colour differences.
_PLANAR = {"yuv420p": (2, 2), "yuv422p": (1, 2), "yuv444p": (1, 1), "nv12": (2, 2)}
LAYOUTS = (*_INTERLEAVED, *_PLANAR)
#: Luma and colour differences of BT.601, full range.
BT601 = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])


def _parts(layout: str) -> tuple[str, str]:
    """(channels, samples) of an interleaved layout."""
    if layout not in _INTERLEAVED:
        raise ValueError(f"unknown layout {layout}")
    channels = layout.rstrip("0123456789f")
    return channels, layout[len(channels) :]


def size_of(layout: str, w: int, h: int) -> int:
    if layout in _PLANAR:
        down, across = _PLANAR[layout]
        return w * h + 2 * -(-h // down) * -(-w // across)
    channels, samples = _parts(layout)
    return w * h * (1 if channels == "gray" else len(channels)) * np.dtype(_SAMPLES[samples][0]).itemsize


def to_rgba(content: bytes, w: int, h: int, layout: str) -> np.ndarray:
    """(h, w, 4) of raw pixels. Raises ValueError where they aren't as many as the size says."""
    if len(content) != size_of(layout, w, h):
        raise ValueError(f"{len(content)} bytes aren't {w} by {h} pixels of {layout}")
    if layout in _PLANAR:
        down, across = _PLANAR[layout]
        flat = np.frombuffer(content, "u1") / 255
        small = -(-h // down), -(-w // across)
        sides = flat[w * h :].reshape(*small, 2).transpose(2, 0, 1) if layout == "nv12" else flat[w * h :].reshape(2, *small)
        chroma = [np.repeat(np.repeat(p, down, 0), across, 1)[:h, :w] - 128 / 255 for p in sides]
        rgb = np.clip(np.stack([flat[: w * h].reshape(h, w), *chroma], -1) @ np.linalg.inv(BT601).T, 0, 1)
        return np.concatenate([rgb, np.ones((h, w, 1))], -1)
    channels, samples = _parts(layout)
    kind, top = _SAMPLES[samples]
    v = np.frombuffer(content, kind).reshape(h, w, -1).astype(float) / (top or 1)
    one = np.ones((h, w, 1))
    if channels == "gray":
        return np.concatenate([v, v, v, one], -1)
    if channels.startswith("cmyk"):
        return np.concatenate([(1 - v[..., :3]) * (1 - v[..., 3:4]), v[..., 4:] if channels == "cmyka" else one], -1)
    if channels.startswith("bgr"):
        v = v[..., [2, 1, 0, 3][: v.shape[-1]]]
    return v if v.shape[-1] == 4 else np.concatenate([v, one], -1)


def _stored(v: np.ndarray, samples: str) -> bytes:
    kind, top = _SAMPLES[samples]
    return (np.floor(np.clip(v * top + 0.5, 0, top)) if top else v).astype(kind).tobytes()


def from_rgba(img: np.ndarray, layout: str) -> bytes:
    """Raw pixels of an RGBA array."""
    if layout in _PLANAR:
        down, across = _PLANAR[layout]
        h, w = img.shape[:2]
        yuv = img[..., :3] @ BT601.T
        padded = np.pad(yuv[..., 1:], ((0, -h % down), (0, -w % across), (0, 0)), mode="edge")
        small = padded.reshape(padded.shape[0] // down, down, padded.shape[1] // across, across, 2).mean((1, 3)) + 128 / 255
        sides = small if layout == "nv12" else small.transpose(2, 0, 1)
        return _stored(yuv[..., 0], "8") + _stored(sides, "8")
    channels, samples = _parts(layout)
    rgb, a = img[..., :3], img[..., 3:4]
    if channels == "gray":
        return _stored(rgb @ np.array([0.2126, 0.7152, 0.0722]), samples)
    if channels.startswith("cmyk"):
        k = 1 - rgb.max(-1, keepdims=True)
        ink = np.where(k < 1, (1 - rgb - k) / np.where(k < 1, 1 - k, 1), 0)
        return _stored(np.concatenate([ink, k, a][: 2 + (channels == "cmyka")], -1), samples)
    return _stored(np.concatenate([rgb[..., ::-1] if channels.startswith("bgr") else rgb, a][: 1 + channels.endswith("a")], -1), samples)


def converted(content: bytes, w: int, h: int, source: str, target: str) -> bytes:
    """Raw pixels in another layout."""
    if source == target:
        if len(content) != size_of(source, w, h):
            raise ValueError(f"{len(content)} bytes aren't {w} by {h} pixels of {source}")
        return content
    img = to_rgba(content, w, h, source)
    if "rgba32f" in (source, target) or source in _PLANAR or target in _PLANAR:
        return from_rgba(img, target)
    (a, deep), (b, wide) = _parts(source), _parts(target)
    if a == b or deep == wide and (deep == "8" or {a, b} <= {"rgb", "rgba"}):
        return _gray8(img) if target == "gray8" and a != "gray" else from_rgba(img, target)
    # both change: through levels of 8 bits
    img = np.floor(np.clip(img * 255 + 0.5, 0, 255)) / 255
    if b == "gray" and a != "gray":
        img = np.repeat(np.frombuffer(_gray8(img), "u1").reshape(h, w, 1) / 255, 4, -1)
    # equal channels have themselves as their luma, but for rounding
    return _stored(img[..., 0], wide) if b == "gray" else from_rgba(img, target)


def _gray8(img: np.ndarray) -> bytes:
    levels = np.floor(np.clip(img[..., :3] * 255 + 0.5, 0, 255)).astype(np.int64)
    return (levels @ np.array([77, 150, 29]) + 128 >> 8).astype("u1").tobytes()


def convert_format(rows: DataFrame, source: str, target: str) -> DataFrame:
    """(image_id, width, height, content) in another layout; null content, and content that doesn't fit the size, give null."""

    def one(content, w: int, h: int) -> bytes | None:
        try:
            return None if content is None else converted(bytes(content), w, h, source, target)
        except ValueError:
            return None

    for layout in (source, target):
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["content"] = [one(c, int(w), int(h)) for c, w, h in zip(pdf["content"], pdf["width"], pdf["height"], strict=True)]
            yield pdf

    return rows.select("image_id", "width", "height", "content").mapInPandas(run, "image_id long, width long, height long, content binary")
