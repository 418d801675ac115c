"""Image files as DataFrames: scans, probes of headers, frames, and encoding.

Files are read by Spark's own reader, so they may be in any store that it knows.
A file becomes one row for each frame; a probe reads headers only. Frames of a
file that the caller doesn't want are dropped in the task that decodes it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pixelloom.plans.run import packed, unpacked
from pixelloom.sources import codecs, layouts, metadata, webp

FRAME_SCHEMA = (
    "image_id long, path string, format string, frame_index int, frames int, delay_ms int, width long, height long, color_space string, metadata map<string,map<string,string>>, data binary"
)
PROBE_SCHEMA = "image_id long, path string, format string, width long, height long"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(image_id, path, content): image_id is a hash of the path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.abs(F.xxhash64("path")).alias("image_id"), "path", "content")


def decoded(contents: DataFrame, frames: str | Sequence[int] | range = "first") -> DataFrame:
    """Frames of files (image_id, path, content): "first", "all", a range, or chosen ones. A file that can't be decoded is left out with its path in a row without data."""

    def wanted(n: int) -> list[int]:
        if frames == "first":
            return [0]
        return list(range(n)) if frames == "all" else [i for i in frames if 0 <= i < n]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, path, content in zip(pdf["image_id"], pdf["path"], pdf["content"], strict=True):
                try:
                    got = codecs.decode(content, path.rpartition(".")[2].lower())
                except ValueError:
                    rows.append((i, path, None, None, 0, None, None, None, None, None, None))
                    continue
                notes = got.metadata | metadata.read(content)
                for k in wanted(len(got.frames)):
                    f = got.frames[k]
                    delay = got.delays[k] if k < len(got.delays) else 0
                    rows.append((i, path, codecs.detect(content) or "tga", k, len(got.frames), delay, f.shape[1], f.shape[0], "linear", notes, packed(f)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAME_SCHEMA.split(", ")])

    return contents.select("image_id", "path", "content").mapInPandas(run, FRAME_SCHEMA)


def read(spark: SparkSession, path: str, pattern: str = "*", frames: str | Sequence[int] | range = "first") -> DataFrame:
    return decoded(files(spark, path, pattern), frames)


def from_raw(rows: DataFrame, layout: str = "rgba8") -> DataFrame:
    """Whole images of rows (image_id, width, height, content) of raw pixels in a layout of layouts.py: levels of 8 bits are sRGB, others linear; f32 is rgba32f."""
    layout = "rgba32f" if layout == "f32" else layout

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, content in zip(pdf["width"], pdf["height"], pdf["content"], strict=True):
                img = layouts.to_rgba(content, int(w), int(h), layout)
                if _levels(layout):
                    img[..., :3] = codecs.to_linear(img[..., :3])
                out.append(packed(img))
            yield pd.DataFrame({"image_id": pdf["image_id"], "width": pdf["width"], "height": pdf["height"], "data": out})

    return rows.select("image_id", "width", "height", "content").mapInPandas(run, "image_id long, width long, height long, data binary")


def to_raw(images: DataFrame, layout: str = "rgba8") -> DataFrame:
    """The reverse of from_raw."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, data in zip(pdf["width"], pdf["height"], pdf["data"], strict=True):
                img = unpacked(data, int(w), int(h))
                if _levels(layout):
                    img[..., :3] = codecs.to_srgb(img[..., :3])
                out.append(layouts.from_rgba(img, layout))
            yield pd.DataFrame({"image_id": pdf["image_id"], "width": pdf["width"], "height": pdf["height"], "content": out})

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, width long, height long, content binary")


def _levels(layout: str) -> bool:
    return not layout.endswith(("16", "f"))


def size_of(content: bytes) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) from a header."""
    name = codecs.detect(content)
    try:
        if name == "png":
            return name, *struct.unpack_from(">II", content, 16)
        if name == "gif":
            return name, *struct.unpack_from("<HH", content, 6)
        if name == "bmp":
            w, h = struct.unpack_from("<ii", content, 18)
            return name, w, abs(h)
        if name == "qoi":
            return name, *struct.unpack_from(">II", content, 4)
        if name == "tga":
            return name, *struct.unpack_from("<HH", content, 12)
        if name == "ico":
            return name, content[6] or 256, content[7] or 256
        if name == "pnm" and content[1:2] != b"7":
            head, _ = codecs._pnm_tokens(content, 3)
            return name, int(head[1]), int(head[2])
        if name in HEADERS:
            return name, *HEADERS[name](content)
    except (ValueError, IndexError, struct.error):
        pass
    return name, None, None


def _jpeg_size(data: bytes) -> tuple[int, int]:
    at = 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        at += 2 + size


def _tiff_size(data: bytes) -> tuple[int, int]:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind = struct.unpack_from(order + "HH", data, at + 2 + 12 * k)
        if tag in (256, 257):
            found[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)[0]
    if len(found) < 2:
        raise ValueError("no size")
    return found[256], found[257]


def _exr_size(data: bytes) -> tuple[int, int]:
    at = 8
    while data[at]:
        name_end = data.index(0, at)
        kind_end = data.index(0, name_end + 1)
        size = struct.unpack_from("<i", data, kind_end + 1)[0]
        if data[at:name_end] == b"dataWindow":
            x0, y0, x1, y1 = struct.unpack_from("<4i", data, kind_end + 5)
            return x1 - x0 + 1, y1 - y0 + 1
        at = kind_end + 5 + size
    raise ValueError("no size")


def _hdr_size(data: bytes) -> tuple[int, int]:
    words = data[data.index(b"\n\n") + 2 :].split(b"\n", 1)[0].split()
    sizes = {w[1:]: int(n) for w, n in zip(words[::2], words[1::2], strict=True)}
    return sizes[b"X"], sizes[b"Y"]


def _fits_size(data: bytes) -> tuple[int, int]:
    cards = {data[k : k + 8].strip(): data[k + 10 : k + 30] for k in range(0, min(len(data), 28_800), 80)}
    if b"NAXIS1" not in cards or b"NAXIS2" not in cards:
        raise ValueError("no size")
    return int(cards[b"NAXIS1"]), int(cards[b"NAXIS2"])


def _pam_size(data: bytes) -> tuple[int, int]:
    fields = dict(line.split(None, 1) for line in data[: data.index(b"ENDHDR")].split(b"\n")[1:] if line and line[:1] != b"#")
    return int(fields[b"WIDTH"]), int(fields[b"HEIGHT"])


#: Sizes from headers that take more than a look at a fixed place.
HEADERS = {"jpeg": _jpeg_size, "tiff": _tiff_size, "dds": lambda d: struct.unpack_from("<II", d, 12)[::-1], "exr": _exr_size, "hdr": _hdr_size, "fits": _fits_size, "pnm": _pam_size, "webp": webp.size_of}


def probe(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Format and size of files from their headers; no pixel is decoded. Spark's reader hands over whole files, of which only the head is looked at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, p, *size_of(c)) for i, p, c in zip(pdf["image_id"], pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["image_id", "path", "format", "width", "height"])

    return files(spark, path, pattern).mapInPandas(run, PROBE_SCHEMA)


def encoded(images: DataFrame, name: str) -> DataFrame:
    """(image_id, format, content) of whole images; animated formats of several frames go through encode_frames()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [codecs.encode(unpacked(d, int(w), int(h)), name) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]
            yield pd.DataFrame({"image_id": pdf["image_id"], "format": name, "content": out})

    return images.select("image_id", "width", "height", "data").mapInPandas(run, "image_id long, format string, content binary")


def encode_frames(frames: DataFrame, name: str = "gif") -> DataFrame:
    """(image_id, format, content): all frames of an image in one file, gif, apng or tiff."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        imgs = [unpacked(d, int(w), int(h)) for d, w, h in zip(pdf["data"], pdf["width"], pdf["height"], strict=True)]
        delays = [int(d or 0) for d in pdf["delay_ms"]]
        content = codecs.encode_tiff(imgs) if name == "tiff" else {"gif": codecs.encode_gif, "apng": codecs.encode_apng}[name](imgs, delays)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "format": [name], "content": [content]})

    return frames.groupBy("image_id").applyInPandas(run, "image_id long, format string, content binary")


def write_files(contents: DataFrame, folder: str) -> DataFrame:
    """Writes each file (image_id, format, content) into a folder that executors share; gives (path, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for pdf in batches:
            rows = []
            for i, name, content in zip(pdf["image_id"], pdf["format"], pdf["content"], strict=True):
                path = f"{base}/{i}.{name}"
                # under another name first: a task that runs twice leaves a whole file
                with store.open_output_stream(path + ".part") as f:
                    f.write(content)
                store.move(path + ".part", path)
                rows.append((path, len(content)))
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    return contents.select("image_id", "format", "content").mapInPandas(run, "path string, bytes long")


class ImageFiles(DataSource):
    """Data source `pixelloom`: spark.read.format("pixelloom").option("path", folder).load() gives frames of the files in a mounted folder."""

    @classmethod
    def name(cls) -> str:
        return "pixelloom"

    def schema(self) -> str:
        return "path string, format string, frame_index int, width long, height long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


class _FileReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.all = options["path"], options.get("frames", "first") == "all"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = [f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file]
        return [InputPartition(found[i : i + 64]) for i in range(0, len(found), 64)]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.value if partition else []:
            with store.open_input_stream(path) as f:
                content = f.read()
            try:
                got = codecs.decode(content, path.rpartition(".")[2].lower())
            except ValueError:  # a row without data, as of decoded()
                yield path, None, None, None, None, None
                continue
            for k, img in enumerate(got.frames if self.all else got.frames[:1]):
                yield path, codecs.detect(content) or "tga", k, img.shape[1], img.shape[0], packed(img)
