"""Running operators on DataFrames of pixels or of whole images.

Pixels are rows (image_id, width, height, y, x, r, g, b, a). Whole images are
rows (image_id, width, height, data) with data little-endian 32-bit floats, row by
row, RGBA; operators compute in doubles, or in the precision of the rows where a kernel is marked so. Plans run on pixels as DataFrame operations. Kernels run on images: those
of whole-image rows batch by batch without a shuffle; pixels are first brought
together by image, or by tile where the kernels say how far they look.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.registry import PIXEL, Operator
from pixelloom.plans.rel import SparkRel

PIXEL_SCHEMA = "image_id long, width long, height long, y long, x long, r double, g double, b double, a double"
IMAGE_SCHEMA = "image_id long, width long, height long, data binary"
CHANNELS = ["r", "g", "b", "a"]
#: Side of the tiles into which pixels are cut for kernels with a halo.
TILE = 512

#: How channels of whole images are stored.
PACKED = "<f4"

Kernel = Callable[[np.ndarray], np.ndarray]


def _chain(kernels: Sequence[Kernel]) -> Kernel:
    return lambda img: reduce(lambda v, f: f(v), kernels, img)


def _image(pdf: pd.DataFrame) -> np.ndarray:
    """The pixels of one rectangle as an array, whatever their order."""
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    y0, x0 = y.min(), x.min()
    out = np.zeros((y.max() - y0 + 1, x.max() - x0 + 1, 4))
    out[y - y0, x - x0] = pdf[CHANNELS].to_numpy(float)
    return out


def _rows(image_id, img: np.ndarray, y0: int = 0, x0: int = 0, size: tuple[int, int] | None = None) -> pd.DataFrame:
    h, w = img.shape[:2]
    y, x = np.divmod(np.arange(h * w), w)
    full = size or (h, w)
    return pd.DataFrame({"image_id": image_id, "width": full[1], "height": full[0], "y": y + y0, "x": x + x0} | {c: img[..., k].ravel() for k, c in enumerate(CHANNELS)})


def whole_images(pixels: DataFrame, kernels: Sequence[Kernel]) -> DataFrame:
    """Kernels on each image, one after another in one pass."""
    f = _chain(kernels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(pdf["image_id"].iloc[0], f(_image(pdf)))

    return pixels.select(*PIXEL).groupBy("image_id").applyInPandas(run, PIXEL_SCHEMA)


def tiles(pixels: DataFrame, kernels: Sequence[Kernel], halo: int, side: int = TILE) -> DataFrame:
    """Kernels on tiles that overlap by the halo. A pixel is sent to each tile that needs it, so no image has to fit in one task."""
    f = _chain(kernels)
    first = lambda c: F.greatest(F.floor((F.col(c) - halo) / side), F.lit(0))
    last = lambda c, size: F.least(F.floor((F.col(c) + halo) / side), F.floor((F.col(size) - 1) / side))
    dealt = pixels.select(*PIXEL).withColumn("_ty", F.explode(F.sequence(first("y"), last("y", "height")))).withColumn("_tx", F.explode(F.sequence(first("x"), last("x", "width"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
        img = f(_image(pdf))
        top, left = int(one["_ty"]) * side, int(one["_tx"]) * side
        core = img[top - y0 : top - y0 + side, left - x0 : left - x0 + side]
        return _rows(one["image_id"], core, top, left, (int(one["height"]), int(one["width"])))

    return dealt.groupBy("image_id", "_ty", "_tx").applyInPandas(run, PIXEL_SCHEMA)


def packed_images(images: DataFrame, kernels: Sequence[Kernel], single: bool = False) -> DataFrame:
    """Kernels on rows of whole images, in doubles or in single precision; other columns stay."""
    f = _chain(kernels)
    names = images.columns
    at = {c: names.index(c) for c in ("width", "height", "data")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: images are large
                row = batch.slice(k, 1)
                w, h = (row.column(at[c])[0].as_py() for c in ("width", "height"))
                data = row.column(at["data"])[0]
                columns = row.columns
                if data.is_valid:
                    out = f(np.frombuffer(data.as_buffer(), PACKED).reshape(h, w, 4) if single else _from_buffer(data.as_buffer(), w, h))
                    fresh = {"width": out.shape[1], "height": out.shape[0], "data": packed(out)}
                    for c, v in fresh.items():
                        columns[at[c]] = pa.array([v], batch.schema.field(at[c]).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return images.mapInArrow(run, images.schema)


def _from_buffer(data, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, PACKED).reshape(height, width, 4).astype(float)


def packed(img: np.ndarray) -> bytes:
    return img.astype(PACKED, copy=False).tobytes()


def unpacked(data: bytes, width: int, height: int) -> np.ndarray:
    return _from_buffer(data, width, height)


def to_pixels(images: DataFrame) -> DataFrame:
    """Rows of pixels of rows of whole images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, w, h, d in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                yield _rows(i, unpacked(d, int(w), int(h)))

    return images.select("image_id", "width", "height", "data").mapInPandas(run, PIXEL_SCHEMA)


def to_images(pixels: DataFrame) -> DataFrame:
    """Rows of whole images of rows of pixels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        img = _image(pdf)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [img.shape[1]], "height": [img.shape[0]], "data": [packed(img)]})

    return pixels.select(*PIXEL).groupBy("image_id").applyInPandas(run, IMAGE_SCHEMA)


def is_packed(df: DataFrame) -> bool:
    return "data" in df.columns


def uses_kernel(op: Operator, df: DataFrame) -> bool:
    return op.kernel is not None and (is_packed(df) or not op.narrow)


def apply(df: DataFrame, op: Operator, params: dict, *others: DataFrame) -> DataFrame:
    """One operator on pixels or whole images, with all its parameters."""
    if uses_kernel(op, df):
        kernels = [lambda img: op.kernel(img, **params)]
        if is_packed(df):
            return packed_images(df, kernels, op.single)
        return tiles(df, kernels, op.halo(**params)) if op.halo else whole_images(df, kernels)
    inputs = [to_pixels(d) if is_packed(d) else d for d in (df, *others)]
    out = op.plan(*map(SparkRel, inputs), **params).df
    return out.select(*PIXEL)
