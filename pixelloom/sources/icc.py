"""ICC profiles: found in files, read, and applied to levels as numpy arrays.

Read are profiles by matrix and curves, gray ones, and tables of 8 and 16 bits
(lut8, lut16) from gray, RGB or CMYK into XYZ or Lab. The result is linear sRGB.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The white of the connection space, and XYZ of it (adapted to D50 by Bradford) to linear sRGB.
D50 = np.array([0.9642, 1.0, 0.8249])
D50_TO_SRGB = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])


def extract(data: bytes) -> bytes | None:
    """The profile in a PNG, JPEG, TIFF or WebP file; None where there is none, or it is cut."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while at + 8 <= len(data):
                size, kind = struct.unpack_from(">I4s", data, at)
                if kind == b"iCCP":
                    return zlib.decompress(data[at + 8 : at + 8 + size].split(b"\0", 1)[1][1:])
                if kind == b"IDAT":
                    return None
                at += 12 + size
        elif data[:2] == b"\xff\xd8":
            return _of_jpeg(data)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            return _of_tiff(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            from pixelloom.sources import webp

            return dict(webp.chunks(data[12:])).get(b"ICCP")
    except (struct.error, IndexError, ValueError, zlib.error):
        pass
    return None


def _of_jpeg(data: bytes) -> bytes | None:
    at, parts = 2, {}
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            parts[body[12]] = body[14:], body[13]
        at += 2 + size
    if not parts or len(parts) != next(iter(parts.values()))[1]:
        return None
    return b"".join(parts[k][0] for k in sorted(parts))


def _of_tiff(data: bytes) -> bytes | None:
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, _, size, place = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
        if tag == 34675:
            return data[place : place + size]
    return None


class Profile:
    """A profile by its bytes. Raises ValueError where it can't be read."""

    def __init__(self, data: bytes):
        try:
            if data[36:40] != b"acsp":
                raise ValueError("no profile")
            self.space, self.pcs = data[16:20].decode("latin-1").strip(), data[20:24].decode("latin-1").strip()
            (n,) = struct.unpack_from(">I", data, 128)
            self.tags = {}
            for k in range(n):
                name, at, size = struct.unpack_from(">4sII", data, 132 + 12 * k)
                self.tags[name.decode("latin-1")] = data[at : at + size]
            self.steps = self._steps()
        except (struct.error, IndexError, KeyError) as broken:
            raise ValueError(f"broken profile: {broken!r}") from broken

    def _steps(self):
        table = self.tags.get("A2B0", b"")[:4]
        if table in (b"mft1", b"mft2"):
            return Table(self.tags["A2B0"])
        if self.space == "GRAY":
            return curve(self.tags["kTRC"])
        if self.space == "RGB" and {"rXYZ", "gXYZ", "bXYZ"} <= set(self.tags):
            columns = [np.array(struct.unpack_from(">3i", self.tags[c + "XYZ"], 8)) / 65536 for c in "rgb"]
            return [curve(self.tags[c + "TRC"]) for c in "rgb"], np.stack(columns, 1)
        raise ValueError("this kind of profile isn't read")

    def linear(self, v: np.ndarray) -> np.ndarray:
        """Linear sRGB (..., 3) of levels in [0, 1]: (..., 3), of gray profiles the first channel, of CMYK ones (..., 4)."""
        if isinstance(self.steps, Table):
            out = self.steps(v[..., : self.steps.inputs])
            xyz = lab_to_xyz(out * self.steps.lab_scale - self.steps.lab_shift) if self.pcs == "Lab" else out * (1 + 32767 / 32768)
        elif self.space == "GRAY":
            return np.repeat(self.steps(v[..., :1]), 3, -1)
        else:
            curves, matrix = self.steps
            xyz = np.stack([c(v[..., k]) for k, c in enumerate(curves)], -1) @ matrix.T
        return xyz @ D50_TO_SRGB.T


def curve(tag: bytes):
    """The function of a curve tag."""
    if tag[:4] == b"curv":
        (n,) = struct.unpack_from(">I", tag, 8)
        if n == 0:
            return lambda v: v
        if n == 1:
            gamma = struct.unpack_from(">H", tag, 12)[0] / 256
            return lambda v: np.maximum(v, 0) ** gamma
        table = np.frombuffer(tag, ">u2", n, 12) / 65535
        return lambda v: np.interp(v, np.linspace(0, 1, n), table)
    if tag[:4] != b"para":
        raise ValueError("an unknown curve")
    (kind,) = struct.unpack_from(">H", tag, 8)
    if kind > 4:
        raise ValueError("an unknown curve")
    p = [x / 65536 for x in struct.unpack_from(f">{(1, 3, 4, 5, 7)[kind]}i", tag, 12)]
    g, a, b = p[0], *(p[1:3] or (1.0, 0.0))
    c, d, e, f = 0.0, -b / a if a else 0.0, 0.0, 0.0
    if kind == 0:
        d = 0.0
    elif kind == 2:
        e = f = p[3]
    elif kind >= 3:
        c, d = p[3:5]
        e, f = p[5:7] if kind == 4 else (0.0, 0.0)
    return lambda v: np.where(v >= d, np.maximum(a * v + b, 0) ** g + e, c * v + f)


class Table:
    """lut8 and lut16: curves, a grid with linear interpolation in all dimensions, curves."""

    def __init__(self, tag: bytes):
        wide = tag[:4] == b"mft2"
        self.inputs, self.outputs, self.side = tag[8:11]
        if not (1 <= self.inputs <= 4 and self.outputs == 3 and self.side > 1):
            raise ValueError("this kind of table isn't read")
        n, m = struct.unpack_from(">HH", tag, 48) if wide else (256, 256)
        kind, top = (">u2", 65535) if wide else (np.uint8, 255)
        sizes = (self.inputs * n, self.side**self.inputs * 3, 3 * m)
        flat = np.frombuffer(tag, kind, sum(sizes), 52 if wide else 48) / top
        first, grid, last = np.split(flat, np.cumsum(sizes)[:2])
        self.first, self.grid, self.last = first.reshape(self.inputs, n), grid.reshape(-1, 3), last.reshape(3, m)
        # Lab of 16 bits in these tables ends at 0xFF00
        self.lab_scale = np.array([100.0, 255.0, 255.0]) * (65535 / 65280 if wide else 1)
        self.lab_shift = np.array([0.0, 128.0, 128.0])

    def __call__(self, v: np.ndarray) -> np.ndarray:
        places = [np.interp(v[..., k], np.linspace(0, 1, self.first.shape[1]), self.first[k]) * (self.side - 1) for k in range(self.inputs)]
        low = [np.minimum(p.astype(int), self.side - 2) for p in places]
        out = np.zeros((*v.shape[:-1], 3))
        for corner in range(1 << self.inputs):
            at, weight = np.zeros(v.shape[:-1], int), np.ones(v.shape[:-1])
            for k, (p, base) in enumerate(zip(places, low, strict=True)):
                up = corner >> k & 1
                at = at * self.side + base + up
                weight = weight * (p - base if up else 1 - p + base)
            out += weight[..., None] * self.grid[at]
        return np.stack([np.interp(out[..., k], np.linspace(0, 1, self.last.shape[1]), self.last[k]) for k in range(3)], -1)


def lab_to_xyz(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], -1)
    return np.where(f > 6 / 29, f**3, (f - 4 / 29) * 3 * (6 / 29) ** 2) * D50
