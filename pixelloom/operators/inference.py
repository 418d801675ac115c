"""Model inference on images or on overlapping tiles of them, as batches of arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pixelloom.plans.run import packed, unpacked


@dataclass(frozen=True)
class Input:
    """What a model takes: whole images (tile 0) or tiles of a side with an overlap; layout nhwc or nchw; dtype; padding mirror, zero or clamp."""

    tile: int = 0
    overlap: int = 0
    layout: str = "nhwc"
    dtype: str = "float32"
    padding: str = "mirror"
    channels: int = 3


def _pad(img: np.ndarray, top: int, bottom: int, left: int, right: int, padding: str) -> np.ndarray:
    mode = {"mirror": "symmetric", "zero": "constant", "clamp": "edge"}[padding]
    return np.pad(img, ((top, bottom), (left, right), (0, 0)), mode=mode)


def tensor(img: np.ndarray, spec: Input) -> np.ndarray:
    v = img[..., : spec.channels]
    v = (np.clip(v, 0, 1) * 255 + 0.5).astype(np.uint8) if spec.dtype == "uint8" else v.astype(spec.dtype)
    return v.transpose(2, 0, 1) if spec.layout == "nchw" else v


def image(out: np.ndarray, spec: Input) -> np.ndarray:
    v = out.transpose(1, 2, 0) if spec.layout == "nchw" else out
    return v.astype(float) / 255 if spec.dtype == "uint8" else v.astype(float)


def run(img: np.ndarray, model: Callable[[np.ndarray], np.ndarray], spec: Input, output: str = "image") -> np.ndarray:
    """Model over an image; an output `mask` becomes the alpha of the image."""
    h, w = img.shape[:2]
    side, o = (spec.tile, spec.overlap) if spec.tile else (max(h, w), 0)
    rows, cols = (1, 1) if not spec.tile else (-(-h // side), -(-w // side))
    th, tw = (h, w) if not spec.tile else (side, side)
    big = _pad(img, o, rows * th - h + o, o, cols * tw - w + o, spec.padding)
    parts = np.stack([tensor(big[y * th : y * th + th + 2 * o, x * tw : x * tw + tw + 2 * o], spec) for y in range(rows) for x in range(cols)])
    got = model(parts)
    out = None
    for k, part in enumerate(got):
        y, x = divmod(k, cols)
        v = image(part, spec)[o : o + th, o : o + tw]
        out = np.zeros((rows * th, cols * tw, v.shape[-1])) if out is None else out
        out[y * th : y * th + th, x * tw : x * tw + tw] = v
    out = out[:h, :w]
    res = img.copy()
    if output == "mask":
        res[..., 3] = out[..., 0]
    else:
        res[..., : min(3, out.shape[-1])] = out[..., :3]
    return res


def infer(images: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], spec: Input = Input(), output: str = "image") -> DataFrame:
    """A model on rows of whole images; it is made once for each task."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            yield pdf.assign(data=[packed(run(unpacked(d, int(w), int(h)), model, spec, output)) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)])

    return images.mapInPandas(work, images.schema)
