"""Versions of images as tables of tiles, for undo and redo.

Every change appends the tiles that it touched under the next version; nothing is
overwritten; a tile that goes is a row without data. An image as of a version is, for
each tile, the row of the latest version up to it, which is one aggregate, and has the
size of its latest version.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.run import PACKED, unpacked
from pixelloom.plans.run import packed as packed_row

TILES = "image_id long, version long, tile_y int, tile_x int, width long, height long, data binary"


def cut(images: DataFrame, version: int, side: int = 256) -> DataFrame:
    """Whole images as tiles of a version."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, w, h, d in zip(pdf["image_id"], pdf["width"], pdf["height"], pdf["data"], strict=True):
                img = unpacked(d, int(w), int(h))
                for ty in range(-(-img.shape[0] // side)):
                    for tx in range(-(-img.shape[1] // side)):
                        part = img[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side]
                        rows.append((i, version, ty, tx, w, h, packed_row(part)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])

    return images.select("image_id", "width", "height", "data").mapInPandas(run, TILES)


def changed(history: DataFrame, images: DataFrame, version: int, side: int = 256) -> DataFrame:
    """The tiles of images that differ from the history's latest: what a new version has to append. A tile that an image no longer has is appended without data."""
    keys = ["image_id", "tile_y", "tile_x"]
    now = cut(images, version, side)
    before = as_of(history, version - 1).select(*keys, F.sha2("data", 256).alias("old"), F.col("width").alias("old_w"), F.col("height").alias("old_h"))
    before = before.join(images.select("image_id").distinct(), "image_id", "left_semi")
    both = now.join(before, keys, "full").withColumns({"version": F.lit(version).cast("long"), "width": F.coalesce("width", "old_w"), "height": F.coalesce("height", "old_h")})
    other = F.col("old").isNull() | F.col("data").isNull() | (F.sha2("data", 256) != F.col("old"))
    # the first tile tells of another size even if its own pixels stay
    sized = (F.col("tile_y") == 0) & (F.col("tile_x") == 0) & ((F.col("width") != F.col("old_w")) | (F.col("height") != F.col("old_h")))
    return both.where(other | sized).select(*history.columns)


def as_of(history: DataFrame, version: int) -> DataFrame:
    """The tiles of all images at a version, with the size that the image has then."""
    upto = history.where(F.col("version") <= version)
    latest = upto.groupBy("image_id", "tile_y", "tile_x").agg(F.max("version").alias("version"), F.max_by(F.struct("data"), "version").alias("t"))
    sizes = upto.where("data is not null").groupBy("image_id").agg(F.max_by(F.struct("width", "height"), "version").alias("s"))
    return latest.where("t.data is not null").join(sizes, "image_id").select("image_id", "version", "tile_y", "tile_x", "s.width", "s.height", "t.data")


def joined(tiles: DataFrame, side: int = 256) -> DataFrame:
    """Whole images of their tiles."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["width"].iloc[0]), int(pdf["height"].iloc[0])
        out = np.zeros((h, w, 4))
        for ty, tx, d in zip(pdf["tile_y"], pdf["tile_x"], pdf["data"], strict=True):
            part = out[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side]
            part[:] = np.frombuffer(d, PACKED).reshape(part.shape)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "width": [w], "height": [h], "data": [packed_row(out)]})

    return tiles.groupBy("image_id").applyInPandas(run, "image_id long, width long, height long, data binary")


def packed(images: DataFrame, bits: int = 16) -> DataFrame:
    """Whole images with channels in [0, 1] stored in 16 or 8 bits, for caches; unpacked() takes them back."""
    kind, top = {16: ("<u2", 65535), 8: ("u1", 255)}[bits]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[(np.clip(np.frombuffer(d, PACKED), 0, 1) * top + 0.5).astype(kind).tobytes() for d in pdf["data"]])

    return images.mapInPandas(run, images.schema)


def restored(images: DataFrame, bits: int = 16) -> DataFrame:
    kind, top = {16: ("<u2", 65535), 8: ("u1", 255)}[bits]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[(np.frombuffer(d, kind).astype(float) / top).astype(PACKED).tobytes() for d in pdf["data"]])

    return images.mapInPandas(run, images.schema)
