"""Text drawn with the outlines of a TrueType font."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.plans.registry import Param, kernel

#: Samples across a pixel along each axis.
FINE = 4


class Font:
    """Outlines of a font file with glyf tables."""

    def __init__(self, data: bytes):
        self.data = data
        (n,) = struct.unpack_from(">H", data, 4)
        self.tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack_from(">II", data, 20 + 16 * i)[0] for i in range(n)}
        head, hhea = self.tables[b"head"], self.tables[b"hhea"]
        (self.units,) = struct.unpack_from(">H", data, head + 18)
        (self.long,) = struct.unpack_from(">h", data, head + 50)
        self.ascent, self.descent = struct.unpack_from(">hh", data, hhea + 4)
        (self.metrics,) = struct.unpack_from(">H", data, hhea + 34)
        self.codes = self._codes()

    def _codes(self) -> dict[int, int]:
        data, at = self.data, self.tables[b"cmap"]
        (n,) = struct.unpack_from(">H", data, at + 2)
        out: dict[int, int] = {}
        for i in range(n):
            sub = at + struct.unpack_from(">I", data, at + 8 + 8 * i)[0]
            (kind,) = struct.unpack_from(">H", data, sub)
            if kind == 12:
                for k in range(struct.unpack_from(">I", data, sub + 12)[0]):
                    a, b, g = struct.unpack_from(">III", data, sub + 16 + 12 * k)
                    out |= {c: g + c - a for c in range(a, b + 1)}
            elif kind == 4:
                (twice,) = struct.unpack_from(">H", data, sub + 6)
                count = twice // 2
                ends, starts, deltas, offsets = (struct.unpack_from(f">{count}{k}", data, sub + 14 + o) for k, o in (("H", 0), ("H", twice + 2), ("h", 2 * twice + 2), ("H", 3 * twice + 2)))
                for s in range(count):
                    for c in range(starts[s], min(ends[s], 0xFFFE) + 1):
                        g = c
                        if offsets[s]:
                            g = struct.unpack_from(">H", data, sub + 16 + 3 * twice + 2 * s + offsets[s] + 2 * (c - starts[s]))[0]
                            if not g:
                                continue
                        out.setdefault(c, (g + deltas[s]) & 0xFFFF)
        return out

    def advance(self, glyph: int) -> int:
        return struct.unpack_from(">H", self.data, self.tables[b"hmtx"] + 4 * min(glyph, self.metrics - 1))[0]

    def outline(self, glyph: int, depth: int = 0) -> list[np.ndarray]:
        """Closed polygons of a glyph in font units, curves cut into pieces."""
        data, loca, glyf = self.data, self.tables[b"loca"], self.tables[b"glyf"]
        a, b = struct.unpack_from(">II", data, loca + 4 * glyph) if self.long else (2 * v for v in struct.unpack_from(">HH", data, loca + 2 * glyph))
        if a == b or depth > 5:
            return []
        at = glyf + a
        (n,) = struct.unpack_from(">h", data, at)
        return self._simple(at + 10, n) if n >= 0 else self._compound(at + 10, depth)

    def _simple(self, at: int, n: int) -> list[np.ndarray]:
        data = self.data
        ends = struct.unpack_from(f">{n}H", data, at)
        at += 2 * n
        at += 2 + struct.unpack_from(">H", data, at)[0]
        count = ends[-1] + 1 if n else 0
        flags: list[int] = []
        while len(flags) < count:
            f = data[at]
            at += 1
            flags.append(f)
            if f & 8:
                flags += [f] * data[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags:
                if f & short:
                    v += data[at] if f & same else -data[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack_from(">h", data, at)[0]
                    at += 2
                out.append(v)
            axes.append(out)
        points, out, first = np.array(axes, float).T, [], 0
        for e in ends:
            out.append(_flattened(points[first : e + 1], [bool(f & 1) for f in flags[first : e + 1]]))
            first = e + 1
        return [p for p in out if len(p) > 2]

    def _compound(self, at: int, depth: int) -> list[np.ndarray]:
        out, more = [], True
        while more:
            flags, glyph = struct.unpack_from(">HH", self.data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", self.data, at)
            at += 4 if flags & 1 else 2
            m = np.eye(2)
            n = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
            k = [v / 16384 for v in struct.unpack_from(f">{n}h", self.data, at)]
            at += 2 * n
            if n:
                m = np.array([[k[0], k[1] if n == 4 else 0], [k[2] if n == 4 else 0, k[-1]]])
            out += [p @ m + ((dx, dy) if flags & 2 else (0, 0)) for p in self.outline(glyph, depth + 1)]
            more = bool(flags & 0x20)
        return out

    def coverage(self, text: str, x: float, y: float, size: float, width: int, height: int) -> np.ndarray:
        """How much of each pixel of a canvas the text covers; (x, y) is the top left of its first line."""
        scale = size / self.units
        fine = np.zeros((height * FINE, width * FINE + 1), np.int16)
        pen, line = x, y + self.ascent * scale
        for c in text:
            if c == "\n":
                pen, line = x, line + (self.ascent - self.descent) * scale
                continue
            glyph = self.codes.get(ord(c), 0)
            for p in self.outline(glyph):
                _wind(fine, pen + p[:, 0] * scale, line - p[:, 1] * scale)
            pen += self.advance(glyph) * scale
        inside = np.cumsum(fine, axis=1)[:, :-1] != 0
        return inside.reshape(height, FINE, width, FINE).mean((1, 3))


def _flattened(points: np.ndarray, on: list[bool]) -> np.ndarray:
    """Quadratic curves of a contour as short lines; between two control points lies one on the curve."""
    full: list[tuple[np.ndarray, bool]] = []
    for i in range(len(points)):
        j = (i + 1) % len(points)
        full.append((points[i], on[i]))
        if not on[i] and not on[j]:
            full.append(((points[i] + points[j]) / 2, True))
    start = next((i for i, (_, o) in enumerate(full) if o), 0)
    full = full[start:] + full[: start + 1]
    out, i = [full[0][0]], 1
    while i < len(full):
        p, o = full[i]
        if o:
            out.append(p)
            i += 1
        else:
            a, b = out[-1], full[min(i + 1, len(full) - 1)][0]
            t = np.linspace(0, 1, 9)[1:, None]
            out += list((1 - t) ** 2 * a + 2 * t * (1 - t) * p + t * t * b)
            i += 2
    return np.array(out)


def _wind(fine: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Adds the windings of a polygon: each edge counts for the samples to its right."""
    h, w = fine.shape[0], fine.shape[1] - 1
    x, y = x * FINE, y * FINE
    for x0, y0, x1, y1 in zip(x, y, np.roll(x, -1), np.roll(y, -1), strict=True):
        if y0 == y1:
            continue
        turn = 1 if y1 > y0 else -1
        top, low = min(y0, y1), max(y0, y1)
        rows = np.arange(max(int(np.ceil(top - 0.5)), 0), min(int(np.ceil(low - 0.5)), h))
        at = x0 + (rows + 0.5 - y0) * (x1 - x0) / (y1 - y0)
        cols = np.clip(np.ceil(at - 0.5), 0, w).astype(int)
        np.add.at(fine, (rows, cols), turn)


UNIT = (0.0, 1.0)


@kernel("draw_text", "draw", {}, text="", x=(10.0, -8192.0, 8192.0), y=(10.0, -8192.0, 8192.0), size=(24.0, 1.0, 1024.0), color_r=(1.0, *UNIT), color_g=(1.0, *UNIT), color_b=(1.0, *UNIT), color_a=(1.0, *UNIT), font=Param(None))
def draw_text(img, text, x, y, size, color_r, color_g, color_b, color_a, font):
    """Text in a font given as the bytes of its file; without a font, or text, the image stays."""
    if font is None or not text:
        return img
    h, w = img.shape[:2]
    k = (Font(font).coverage(text, x, y, size, w, h) * color_a)[..., None]
    out = img.copy()
    out[..., :3] = out[..., :3] * (1 - k) + np.array([color_r, color_g, color_b]) * k
    out[..., 3:] = out[..., 3:] * (1 - k) + k
    return out
