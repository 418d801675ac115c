"""Image files as bytes, in pure Python and numpy: decoders and encoders by format.

decode() gives float arrays (frames, height, width, 4) with linear light: formats
for display hold sRGB levels, which are linearised; HDR, PFM and FITS are linear
already. encode() does the reverse, once.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from pixelloom.sources import icc, jpeg, webp

LINEAR = {"hdr", "pfm", "fits"}


@dataclass
class Decoded:
    """Frames of one file; levels are None where the samples are linear floats already."""

    frames: list[np.ndarray]
    delays: list[int] = field(default_factory=list)
    metadata: dict[str, dict[str, str]] = field(default_factory=dict)
    linear: bool = False


def to_linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((np.maximum(v, 0) + 0.055) / 1.055) ** 2.4)


def to_srgb(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)


def levels8(img: np.ndarray) -> np.ndarray:
    """RGBA levels for display of a linear image."""
    out = img.copy()
    out[..., :3] = to_srgb(out[..., :3])
    return (np.clip(out, 0, 1) * 255 + 0.5).astype(np.uint8)


def rgba(levels: np.ndarray, top: float = 255.0) -> np.ndarray:
    """Float RGBA in [0, 1] of gray, gray and alpha, RGB or RGBA levels."""
    v = np.asarray(levels, float) / top
    v = v[..., None] if v.ndim == 2 else v
    if v.shape[-1] in (1, 2):
        v = np.concatenate([np.repeat(v[..., :1], 3, -1), v[..., 1:]], -1)
    if v.shape[-1] == 3:
        v = np.concatenate([v, np.ones((*v.shape[:2], 1))], -1)
    return v


# PNM family


def _pnm_tokens(data: bytes, n: int) -> tuple[list[bytes], int]:
    out, at = [], 0
    while len(out) < n:
        m = re.compile(rb"(?:\s|#[^\n]*\n)*(\S+)").match(data, at)
        if not m:
            raise ValueError("the header ends early")
        out.append(m[1])
        at = m.end()
    return out, at + 1


def decode_pnm(data: bytes) -> Decoded:
    kind = data[:2]
    if kind == b"P7":
        head, _, body = data.partition(b"ENDHDR\n")
        info = dict(line.split(None, 1) for line in head.split(b"\n")[1:] if b" " in line and not line.startswith(b"#"))
        w, h, d, top = (int(info[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
        v = np.frombuffer(body, ">u2" if top > 255 else np.uint8, w * h * d).reshape(h, w, d)
        return Decoded([rgba(v, top)])
    if kind in (b"PF", b"Pf"):
        (_, w, h, scale), at = _pnm_tokens(data, 4)
        d = 3 if kind == b"PF" else 1
        v = np.frombuffer(data, "<f4" if float(scale) < 0 else ">f4", int(w) * int(h) * d, at).reshape(int(h), int(w), d)[::-1]
        return Decoded([rgba(v, 1.0)], linear=True)
    bits = kind in (b"P1", b"P4")
    head, at = _pnm_tokens(data, 3 if bits else 4)
    w, h, top = int(head[1]), int(head[2]), 1 if bits else int(head[3])
    d = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        v = np.array([c - 48 for c in re.sub(rb"\s", b"", data[at - 1 :])][: w * h])
    elif kind in (b"P2", b"P3"):
        v = np.array(data[at - 1 :].split()[: w * h * d], int)
    elif kind == b"P4":
        v = np.unpackbits(np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1), axis=1)[:, :w]
    else:
        v = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * d, at)
    v = v.reshape(h, w, d)
    return Decoded([rgba(1 - v if bits else v, top)])


def encode_ppm(img: np.ndarray) -> bytes:
    return f"P6\n{img.shape[1]} {img.shape[0]}\n255\n".encode() + levels8(img)[..., :3].tobytes()


def encode_pgm(img: np.ndarray) -> bytes:
    gray = img.copy()
    gray[..., :3] = (img[..., :3] @ np.array([0.2126, 0.7152, 0.0722]))[..., None]
    return f"P5\n{img.shape[1]} {img.shape[0]}\n255\n".encode() + levels8(gray)[..., 0].tobytes()


def encode_pbm(img: np.ndarray) -> bytes:
    dark = img[..., :3] @ np.array([0.2126, 0.7152, 0.0722]) < 0.5
    return f"P4\n{img.shape[1]} {img.shape[0]}\n".encode() + np.packbits(dark, axis=1).tobytes()


def encode_pam(img: np.ndarray) -> bytes:
    return f"P7\nWIDTH {img.shape[1]}\nHEIGHT {img.shape[0]}\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n".encode() + levels8(img).tobytes()


def encode_pfm(img: np.ndarray) -> bytes:
    return f"PF\n{img.shape[1]} {img.shape[0]}\n-1.0\n".encode() + img[::-1, :, :3].astype("<f4").tobytes()


# PNG


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Scanlines with their prediction taken off."""
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    if (rows[:, 0] > 2).any():
        return _unfiltered_by_diagonals(rows[:, 0], rows[:, 1:], step)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            for i in range(step):
                line[i::step] = np.cumsum(line[i::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        out[y] = above = line
    return out


def _unfiltered_by_diagonals(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """The same where lines are predicted from both sides: places of equal x + y depend on earlier ones only, and are done at once."""
    h, stride = lines.shape
    n = -(-stride // step)
    coded = np.pad(lines, ((0, 0), (0, n * step - stride))).reshape(h, n, step).astype(np.int16)
    out = np.zeros((h + 1, n + 1, step), np.int16)
    left, up, mean, near = (np.where(kinds == k, 1, 0).astype(np.int16)[:, None] for k in (1, 2, 3, 4))
    for d in range(h + n - 1):
        y = np.arange(max(0, d - n + 1), min(h, d + 1))
        x = d - y
        a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
        pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        out[y + 1, x + 1] = coded[y, x] + left[y] * a + up[y] * b + mean[y] * (a + b >> 1) + near[y] * nearest & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, n * step)[:, :stride]


def _png_samples(raw: bytes, w: int, h: int, depth: int, channels: int) -> np.ndarray:
    stride = (w * depth * channels + 7) // 8
    lines = _unfiltered(raw, h, stride, max(1, depth * channels // 8))
    if depth == 16:
        return lines.reshape(-1).view(">u2").reshape(h, w, channels)
    if depth == 8:
        return lines.reshape(h, w, channels)
    bits = np.unpackbits(lines, axis=1).reshape(h, -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:, :w, None]


def decode_png(data: bytes) -> Decoded:
    at, chunks = 8, []
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunks.append((kind, data[at + 8 : at + 8 + size]))
        at += 12 + size
    head = next(b for k, b in chunks if k == b"IHDR")
    w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    palette = next((np.frombuffer(b, np.uint8).reshape(-1, 3) for k, b in chunks if k == b"PLTE"), None)
    clear = next((b for k, b in chunks if k == b"tRNS"), None)

    def image(raw: bytes, w: int, h: int) -> np.ndarray:
        if lace:
            v, pos = np.zeros((h, w, channels), np.int64), 0
            for y0, x0, dy, dx in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)):
                ph, pw = len(range(y0, h, dy)), len(range(x0, w, dx))
                if ph and pw:
                    size = ph * ((pw * depth * channels + 7) // 8 + 1)
                    v[y0::dy, x0::dx] = _png_samples(raw[pos : pos + size], pw, ph, depth, channels)
                    pos += size
        else:
            v = _png_samples(raw, w, h, depth, channels)
        if color == 3:
            table = np.concatenate([palette, np.full((len(palette), 1), 255, np.uint8)], 1)
            if clear:
                table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
            return rgba(table[v[..., 0]])
        out = rgba(v, (1 << depth) - 1)
        if clear and color in (0, 2):
            out[..., 3] = ~(v == np.frombuffer(clear, ">u2")).all(-1)
        return out

    text = {}
    for kind, body in chunks:
        if kind == b"tEXt":
            k, _, v = body.partition(b"\0")
            text[k.decode("latin-1")] = v.decode("latin-1")
    frames = [image(zlib.decompress(b"".join(b for k, b in chunks if k == b"IDAT")), w, h)]
    delays = []
    controls = [b for k, b in chunks if k == b"fcTL"]
    if controls:  # an animation: each control is followed by its data
        frames, canvas, parts = [], np.zeros((h, w, 4)), []
        for kind, body in [*chunks, (b"fcTL", b"")]:
            if kind in (b"IDAT", b"fdAT") and parts is not None:
                parts.append(body if kind == b"IDAT" else body[4:])
            if kind == b"fcTL":
                if parts and delays:
                    _, fw, fh, fx, fy = struct.unpack_from(">IIIII", control)
                    drawn, before = image(zlib.decompress(b"".join(parts)), fw, fh), canvas.copy()
                    box = canvas[fy : fy + fh, fx : fx + fw]
                    a = drawn[..., 3:] if control[25] else np.ones_like(drawn[..., 3:])
                    box[:] = drawn * a + box * (1 - a) if control[25] else drawn
                    frames.append(canvas.copy())
                    if control[24] == 1:
                        box[:] = 0
                    elif control[24] == 2:
                        canvas = before
                parts = []
                if body:
                    control = body
                    num, den = struct.unpack_from(">HH", body, 20)
                    delays.append(num * 1000 // (den or 100))
    return Decoded(frames, delays, {"png": text} if text else {})


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png_lines(levels: np.ndarray) -> bytes:
    """Scanlines predicted from the left, which costs little and packs well."""
    h, w, c = levels.shape
    left = np.zeros_like(levels)
    left[:, 1:] = levels[:, :-1]
    lines = np.concatenate([np.ones((h, 1), np.uint8), (levels - left).reshape(h, w * c)], 1)
    return zlib.compress(lines.tobytes(), 4)


def encode_png(img: np.ndarray, text: dict[str, str] | None = None) -> bytes:
    h, w = img.shape[:2]
    notes = b"".join(_png_chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in (text or {}).items())
    return b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + notes + _png_chunk(b"IDAT", _png_lines(levels8(img))) + _png_chunk(b"IEND", b"")


def encode_apng(frames: list[np.ndarray], delays: list[int]) -> bytes:
    h, w = frames[0].shape[:2]
    out = b"\x89PNG\r\n\x1a\n" + _png_chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _png_chunk(b"acTL", struct.pack(">II", len(frames), 0))
    n = 0
    for i, (f, d) in enumerate(zip(frames, delays, strict=True)):
        out += _png_chunk(b"fcTL", struct.pack(">IIIIIHHBB", n, w, h, 0, 0, d, 1000, 0, 0))
        n += 1
        body = _png_lines(levels8(f))
        if i:
            out += _png_chunk(b"fdAT", struct.pack(">I", n) + body)
            n += 1
        else:
            out += _png_chunk(b"IDAT", body)
    return out + _png_chunk(b"IEND", b"")


# BMP, ICO


def _bmp_pixels(data: bytes, head: int, body: int | None, icon: bool = False) -> np.ndarray:
    size, w, h = struct.unpack_from("<Iii", data, head)
    bits, packing = struct.unpack_from("<HI", data, head + 14)
    (used,) = struct.unpack_from("<I", data, head + 32) if size >= 36 else (0,)
    flip, h = h > 0, abs(h) // (2 if icon else 1)
    masks = struct.unpack_from("<IIII", data, head + 40) if packing in (3, 6) and (size >= 56) else (*struct.unpack_from("<III", data, head + 40), 0) if packing == 3 else None
    start = head + size + (12 if packing == 3 and size == 40 else 0)
    colors = (used or 1 << bits) if bits <= 8 else 0
    table = np.frombuffer(data, np.uint8, colors * 4, start).reshape(-1, 4)[:, 2::-1] if colors else None
    body = start + 4 * colors if body is None else body
    stride = (w * bits + 31) // 32 * 4
    if packing in (1, 2):
        v = _bmp_runs(data, body, w, h, bits)
    else:
        raw = np.frombuffer(data, np.uint8, stride * h, body).reshape(h, stride)
        if bits <= 8:
            v = (np.unpackbits(raw, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1]))[:, :w]
        elif bits == 24:
            v = raw[:, : 3 * w].reshape(h, w, 3)[..., ::-1]
        else:
            words = raw[:, : w * bits // 8].reshape(-1).view("<u2" if bits == 16 else "<u4").reshape(h, w).astype(np.int64)
            masks = masks or ((0x7C00, 0x3E0, 0x1F, 0) if bits == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000 if icon else 0))
            planes = [(words & m) // (m & -m) / (m // (m & -m)) if m else np.ones((h, w)) for m in masks]
            v = np.stack(planes, -1)
            return v[::-1] if flip else v
    out = rgba(table[v] if table is not None else v)
    return out[::-1] if flip else out


def _bmp_runs(data: bytes, at: int, w: int, h: int, bits: int) -> np.ndarray:
    out, x, y = np.zeros((h, w), np.int64), 0, 0
    while at + 1 < len(data) and y < h:
        n, v = data[at], data[at + 1]
        at += 2
        if n:
            cells = [v] * n if bits == 8 else [(v >> 4, v & 15)[i % 2] for i in range(n)]
        elif v == 0:
            x, y = 0, y + 1
            continue
        elif v == 1:
            break
        elif v == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
            continue
        else:
            size = v if bits == 8 else (v + 1) // 2
            raw = data[at : at + size]
            cells = list(raw) if bits == 8 else [b for c in raw for b in (c >> 4, c & 15)][:v]
            at += size + size % 2
        fit = cells[: w - x]
        out[y, x : x + len(fit)] = fit
        x += len(cells)
    return out


def decode_bmp(data: bytes) -> Decoded:
    (body,) = struct.unpack_from("<I", data, 10)
    return Decoded([_bmp_pixels(data, 14, body)])


def encode_bmp(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    body = levels8(img)[::-1, :, [2, 1, 0, 3]].tobytes()
    head = struct.pack("<IiiHHIIiiII", 108, w, h, 1, 32, 3, len(body), 2835, 2835, 0, 0) + struct.pack("<IIII", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + b"BGRs" + bytes(48)
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


def decode_ico(data: bytes) -> Decoded:
    """The frames of an icon or cursor, largest first."""
    (n,) = struct.unpack_from("<H", data, 4)
    frames = []
    for i in range(n):
        size, at = struct.unpack_from("<II", data, 6 + 16 * i + 8)
        part = data[at : at + size]
        frames.append(decode_png(part).frames[0] if part[:4] == b"\x89PNG" else _bmp_pixels(part, 0, None, icon=True))
    return Decoded(sorted(frames, key=lambda f: -f.shape[0] * f.shape[1]))


def encode_ico(img: np.ndarray) -> bytes:
    body = encode_png(img)
    h, w = img.shape[:2]
    if max(h, w) > 256:
        raise ValueError("icons have at most 256 by 256 pixels")
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, 1, 32, len(body), 22) + body


# QOI


def decode_qoi(data: bytes) -> Decoded:
    _, w, h, _, _ = struct.unpack_from(">4sIIBB", data)
    out, seen = bytearray(), [(0, 0, 0, 0)] * 64
    p, at, n = (0, 0, 0, 255), 14, 0
    while n < w * h:
        b = data[at]
        at += 1
        run = 1
        if b == 0xFE:
            p, at = (*data[at : at + 3], p[3]), at + 3
        elif b == 0xFF:
            p, at = tuple(data[at : at + 4]), at + 4
        elif b < 64:
            p = seen[b]
        elif b < 128:
            p = ((p[0] + (b >> 4 & 3) - 2) & 255, (p[1] + (b >> 2 & 3) - 2) & 255, (p[2] + (b & 3) - 2) & 255, p[3])
        elif b < 192:
            g, c = b - 160, data[at]
            at += 1
            p = ((p[0] + g + (c >> 4) - 8) & 255, (p[1] + g) & 255, (p[2] + g + (c & 15) - 8) & 255, p[3])
        else:
            run = b - 191
        seen[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out += bytes(p) * run
        n += run
    return Decoded([rgba(np.frombuffer(bytes(out), np.uint8, w * h * 4).reshape(h, w, 4))])


def encode_qoi(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    px = levels8(img).reshape(-1, 4)
    whole = px.view("<u4")[:, 0] if len(px) else np.zeros(0, "<u4")
    before = np.concatenate([np.array([0, 0, 0, 255], np.uint8).view("<u4"), whole[:-1]])
    repeated = whole == before
    at = np.flatnonzero(~repeated)
    p, last = px[at].astype(np.int64), before[at].view(np.uint8).reshape(-1, 4).astype(np.int64)
    # the pixel that a slot holds is the last one, not of a run, that fell into it
    slot = p @ np.array([3, 5, 7, 11]) % 64
    order = np.argsort(slot, kind="stable")
    same = (slot[order[1:]] == slot[order[:-1]]) & (whole[at][order[1:]] == whole[at][order[:-1]])
    held = np.zeros(len(at), bool)
    held[order[1:][same]] = True
    dr, dg, db = ((p - last + 128) % 256 - 128)[:, :3].T
    clear = p[:, 3] != last[:, 3]
    small = np.abs(np.stack([dr, dg, db]) + 0.5).max(0, initial=0) < 2
    medium = (np.abs(dg + 0.5) < 32) & (np.abs(dr - dg + 0.5) < 8) & (np.abs(db - dg + 0.5) < 8)
    kinds = np.select([held, clear, small, medium], [0, 4, 1, 2], 3)
    begin = np.flatnonzero(repeated & ~np.concatenate([[False], repeated[:-1]]))
    length = np.flatnonzero(repeated & ~np.concatenate([repeated[1:], [False]])) - begin + 1
    size = np.zeros(len(px) + 1, np.int64)
    size[1:][at] = np.array([1, 1, 2, 4, 5])[kinds]
    size[1:][begin] = -(-length // 62)
    place = np.cumsum(size)
    out = np.full(place[-1], 0xC0 + 61, np.uint8)
    out[place[1:][begin] - 1] = 0xC0 + (length - 1) % 62
    start = place[:-1][at]

    def put(kind: int, *columns: np.ndarray) -> None:
        of = kinds == kind
        for i, values in enumerate(columns):
            out[start[of] + i] = np.broadcast_to(values, len(at))[of]

    put(0, slot)
    put(1, 0x40 + (dr + 2 << 4) + (dg + 2 << 2) + db + 2)
    put(2, 0x80 + dg + 32, (dr - dg + 8 << 4) + db - dg + 8)
    put(3, np.int64(0xFE), *p.T[:3])
    put(4, np.int64(0xFF), *p.T)
    return struct.pack(">4sIIBB", b"qoif", w, h, 4, 0) + out.tobytes() + bytes(7) + b"\1"


# TGA


def decode_tga(data: bytes) -> Decoded:
    note, mapped, kind, first, length, deep, _, _, w, h, bits, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    at = 18 + note
    table = None

    def colours(raw: np.ndarray, bits: int) -> np.ndarray:
        if bits in (15, 16):
            v = raw.reshape(-1).view("<u2").astype(np.int64)
            return np.stack([(v >> s & 31) * 255 // 31 for s in (10, 5, 0)] + [np.full(len(v), 255)], -1)
        v = raw.reshape(-1, bits // 8)
        if bits == 8:
            return np.stack([v[:, 0]] * 3 + [np.full(len(v), 255)], -1)
        return np.concatenate([v[:, 2::-1], v[:, 3:] if bits == 32 else np.full((len(v), 1), 255)], 1)

    if mapped:
        size = length * ((deep + 7) // 8)
        table = colours(np.frombuffer(data, np.uint8, size, at), deep)
        at += size
    step = (bits + 7) // 8
    if kind & 8:
        out = bytearray()
        while len(out) < w * h * step:
            n = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1 : at + 1 + step] * n
                at += 1 + step
            else:
                out += data[at + 1 : at + 1 + n * step]
                at += 1 + n * step
        raw = np.frombuffer(bytes(out[: w * h * step]), np.uint8)
    else:
        raw = np.frombuffer(data, np.uint8, w * h * step, at)
    v = table[raw.astype(int) - first] if table is not None else colours(raw.copy(), bits)
    v = v.reshape(h, w, 4)
    v = v if flags & 32 else v[::-1]
    return Decoded([rgba(v[:, ::-1] if flags & 16 else v)])


def encode_tga(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, w, h, 32, 0x28) + levels8(img)[..., [2, 1, 0, 3]].tobytes()


# Radiance HDR, FITS


def decode_hdr(data: bytes) -> Decoded:
    head, _, rest = data.partition(b"\n\n")
    size, _, body = rest.partition(b"\n")
    m = re.match(rb"-Y (\d+) \+X (\d+)", size)
    h, w = int(m[1]), int(m[2])
    if len(body) >= 4 and body[0] == 2 and body[1] == 2 and 8 <= w < 32768:
        planes, at = np.zeros((h, 4, w), np.uint8), 0
        for y in range(h):
            at += 4
            for c in range(4):
                line = bytearray()
                while len(line) < w:
                    n = body[at]
                    if n > 128:
                        line += body[at + 1 : at + 2] * (n - 128)
                        at += 2
                    else:
                        line += body[at + 1 : at + 1 + n]
                        at += 1 + n
                planes[y, c] = np.frombuffer(bytes(line[:w]), np.uint8)
        v = planes.transpose(0, 2, 1)
    else:
        v = np.frombuffer(body, np.uint8, w * h * 4).reshape(h, w, 4)
    scale = np.where(v[..., 3] > 0, np.exp2(v[..., 3].astype(float) - 136), 0)
    return Decoded([rgba(v[..., :3] * scale[..., None], 1.0)], linear=True)


def encode_hdr(img: np.ndarray) -> bytes:
    rgb = np.maximum(img[..., :3], 0)
    top = rgb.max(-1)
    _, power = np.frexp(top)
    power = np.where(top > 1e-32, power, -128)
    v = np.concatenate([np.clip(rgb * np.exp2(8.0 - power)[..., None], 0, 255), (power + 128)[..., None]], -1)
    return f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {img.shape[0]} +X {img.shape[1]}\n".encode() + v.astype(np.uint8).tobytes()


def decode_fits(data: bytes) -> Decoded:
    cards, at = {}, 0
    while True:
        block = data[at : at + 2880]
        at += 2880
        for i in range(0, 2880, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            if card[8:10] == "= ":
                cards[card[:8].strip()] = card[10:].split("/")[0].strip()
        if any(block[i : i + 8] == b"END     " for i in range(0, 2880, 80)) or at >= len(data):
            break
    kind = {8: "u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[int(cards["BITPIX"])]
    shape = [int(cards[f"NAXIS{k}"]) for k in range(int(cards["NAXIS"]), 0, -1)]
    v = np.frombuffer(data, kind, int(np.prod(shape)), at).astype(float).reshape(shape) * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    v = v[None] if v.ndim == 2 else v
    if not kind.startswith(">f"):
        v = v / {"u1": 255, ">i2": 65535, ">i4": 2**32 - 1}[kind]
    v = v[:, ::-1]
    return Decoded([rgba(np.moveaxis(v if len(v) in (3, 4) else v[:1], 0, -1), 1.0)], linear=True, metadata={"fits": cards})


def encode_fits(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", "NAXIS   =                    3", f"NAXIS1  = {w:>20}", f"NAXIS2  = {h:>20}", "NAXIS3  =                    3", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    body = np.moveaxis(img[::-1, :, :3], -1, 0).astype(">f4").tobytes()
    return head + body + bytes(-len(body) % 2880)


# GIF


def _gif_unpack(data: bytes, bits: int, size: int) -> np.ndarray:
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    out, word, have, width, last, at = bytearray(), 0, 0, bits + 1, None, 0
    while len(out) < size:
        while have < width:
            if at >= len(data):
                return np.frombuffer(bytes(out.ljust(size, b"\0")), np.uint8, size)
            word |= data[at] << have
            have, at = have + 8, at + 1
        code, word, have = word & ((1 << width) - 1), word >> width, have - width
        if code == clear:
            table, width, last = [bytes((i,)) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == end:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry
    return np.frombuffer(bytes(out.ljust(size, b"\0")), np.uint8, size)


def _gif_pack(values: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    out, word, have, width = bytearray(), clear, bits + 1, bits + 1
    table = {bytes((i,)): i for i in range(clear)}
    nxt, run = end + 1, b""

    def put(code: int) -> None:
        nonlocal word, have
        word |= code << have
        have += width
        while have >= 8:
            out.append(word & 255)
            word, have = word >> 8, have - 8

    while have >= 8:
        out.append(word & 255)
        word, have = word >> 8, have - 8
    for v in values:
        more = run + bytes((v,))
        if more in table:
            run = more
            continue
        put(table[run])
        if nxt < 4096:
            table[more] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear)
            table, nxt, width = {bytes((i,)): i for i in range(clear)}, end + 1, bits + 1
        run = more[-1:]
    if run:
        put(table[run])
    put(end)
    if have:
        out.append(word & 255)
    return bytes(out)


def decode_gif(data: bytes) -> Decoded:
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at = 13
    table = None
    if flags & 128:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        out = bytearray()
        while data[at]:
            out += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        return bytes(out), at + 1

    canvas, frames, delays = np.zeros((h, w, 4)), [], []
    delay, clear, dispose = 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                dispose, delay = body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0] * 10
                clear = body[3] if body[0] & 1 else None
            continue
        x, y, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = table
        if flags & 128:
            n = 2 << (flags & 7)
            own = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
            at += 3 * n
        bits = data[at]
        body, at = blocks(at + 1)
        v = _gif_unpack(body, bits, fw * fh).reshape(fh, fw)
        if flags & 64:
            order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, fh, d)]
            straight = np.empty_like(v)
            straight[order] = v
            v = straight
        before = canvas.copy()
        shown = np.ones((fh, fw), bool) if clear is None else v != clear
        box = canvas[y : y + fh, x : x + fw]
        box[shown] = rgba(own[np.minimum(v, len(own) - 1)])[shown]
        frames.append(canvas.copy())
        delays.append(delay)
        if dispose == 2:
            box[:] = 0
        elif dispose == 3:
            canvas = before
        delay, clear, dispose = 0, None, 0
    if not frames:
        raise ValueError("broken gif data: no frame")
    return Decoded(frames, delays)


def encode_gif(frames: list[np.ndarray], delays: list[int] | None = None) -> bytes:
    """Frames with a palette of 256 colours each, by median cut."""
    from pixelloom.operators.kernels import median_cut

    frames = [np.asarray(f) for f in frames]
    h, w = frames[0].shape[:2]
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0, 0, 0) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0" * (len(frames) > 1)
    for f, d in zip(frames, delays or [0] * len(frames), strict=True):
        levels = levels8(f)[..., :3]
        flat = levels.reshape(-1, 3)
        kinds, back = np.unique(flat, axis=0, return_inverse=True)
        if len(kinds) > 256:
            palette = np.clip(np.rint(median_cut(rgba(levels), 256) * 255), 0, 255).astype(np.uint8)
            near = ((kinds[:, None].astype(int) - palette.astype(int)) ** 2).sum(-1).argmin(1)
            index = near[back.ravel()]
        else:
            palette, index = kinds, back.ravel()
        table = np.zeros((256, 3), np.uint8)
        table[: len(palette)] = palette
        packed = _gif_pack(index.astype(np.uint8).tobytes(), 8)
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", 0, d // 10, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x87) + table.tobytes() + b"\x08"
        out += b"".join(bytes((len(packed[i : i + 255]),)) + packed[i : i + 255] for i in range(0, len(packed), 255)) + b"\0"
    return out + b"\x3b"


# TIFF


def _tiff_lzw(data: bytes) -> bytes:
    table: list[bytes] = []
    out, bit, width, last = bytearray(), 0, 9, b""
    while bit + width <= 8 * len(data):
        code = int.from_bytes(data[bit // 8 : bit // 8 + 4].ljust(4, b"\0"), "big") >> (32 - bit % 8 - width) & ((1 << width) - 1)
        bit += width
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def decode_tiff(data: bytes) -> Decoded:
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    frames, notes = [], {}
    while at:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            code = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind, "B")
            size = struct.calcsize(order + code) * count
            place = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * i + 8)[0]
            tags[tag] = data[place : place + count] if kind == 2 else struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
        (nxt,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        one = lambda tag, default=0: tags.get(tag, (default,))[0]  # noqa: E731, B023
        w, h, spp, packing, photo = one(256), one(257), one(277, 1), one(259, 1), one(262, 1)
        bits, sample = one(258, 1), one(339, 1)
        unpack: Callable[[bytes], bytes] = {1: bytes, 5: _tiff_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}[packing]
        tiled = 322 in tags
        tw, th = (one(322), one(323)) if tiled else (w, min(one(278, h), h))
        offsets, counts = tags[324 if tiled else 273], tags[325 if tiled else 279]
        kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (32, 3): "f4", (64, 3): "f8", (16, 3): "f2"}.get((bits, sample))
        out, across = np.zeros((h, w, spp)), -(-w // tw)
        for k, (o, c) in enumerate(zip(offsets, counts, strict=True)):
            raw, y, x = unpack(data[o : o + c]), k // across * th, k % across * tw
            rows = th if tiled else min(th, h - y)
            if bits == 1:
                v = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1)[:, :tw, None]
            else:
                v = np.frombuffer(raw, order + kind, rows * tw * spp).reshape(rows, tw, spp)
                if one(317, 1) == 2:
                    v = np.cumsum(v, axis=1, dtype=v.dtype)
            part = out[y : y + th, x : x + tw]
            part[:] = v[: part.shape[0], : part.shape[1]]
        if photo == 3:
            table = np.array(tags[320], float).reshape(3, -1).T / 65535
            frame = rgba(table[out[..., 0].astype(int)], 1.0)
        else:
            top = 1.0 if sample == 3 else float((1 << bits) - 1)
            frame = rgba((top - out) if photo == 0 else out, top)
        frames.append(frame)
        notes |= {str(t): v.rstrip(b"\0").decode("utf-8", "replace") for t, v in tags.items() if isinstance(v, bytes)}
        at = nxt
    return Decoded(frames, metadata={"tiff": notes} if notes else {})


def encode_tiff(frames: list[np.ndarray] | np.ndarray, packing: str = "deflate") -> bytes:
    frames = [frames] if isinstance(frames, np.ndarray) else frames
    out, links = bytearray(b"II*\0" + bytes(4)), [4]
    for f in frames:
        h, w = f.shape[:2]
        body = levels8(f).tobytes()
        body = zlib.compress(body, 6) if packing == "deflate" else body
        at = len(out)
        out += body + b"\0" * (len(body) % 2)
        depth_at = len(out)
        out += struct.pack("<HHHH", 8, 8, 8, 8)
        struct.pack_into("<I", out, links[-1], len(out))
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 4, depth_at), (259, 3, 1, 8 if packing == "deflate" else 1), (262, 3, 1, 2), (273, 4, 1, at), (277, 3, 1, 4), (278, 4, 1, h), (279, 4, 1, len(body)), (338, 3, 1, 2)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        links.append(len(out))
        out += bytes(4)
    return bytes(out)


def decode_jpeg(data: bytes) -> Decoded:
    v = jpeg.decode(data)
    if v.shape[-1] == 4:  # inks
        v = (255 - v[..., :3]) * (255 - v[..., 3:]) / 255
    return Decoded([rgba(v)])


def encode_jpeg(img: np.ndarray, quality: int = 85) -> bytes:
    """Baseline JPEG; alpha is left out."""
    return jpeg.encode(levels8(img), quality)


# OpenEXR: scan lines of half, float or integer channels, plain, run-length, ZIP


def _exr_text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("latin-1"), end + 1


def _exr_unpacked(raw: bytes, size: int, packing: int) -> bytes:
    if packing == 0 or len(raw) == size:
        return raw
    if packing == 1:
        flat, at = bytearray(), 0
        while at < len(raw):
            n = raw[at] - 256 * (raw[at] > 127)
            if n < 0:
                flat += raw[at + 1 : at + 1 - n]
                at += 1 - n
            else:
                flat += raw[at + 1 : at + 2] * (n + 1)
                at += 2
        data = np.frombuffer(bytes(flat), np.uint8)
    elif packing in (2, 3):
        data = np.frombuffer(zlib.decompress(raw), np.uint8)
    else:
        raise ValueError("this packing of EXR isn't read")
    # differences from the byte before, then halves interleaved
    data = np.cumsum(np.concatenate([data[:1].astype(np.int64), data[1:].astype(np.int64) - 128])).astype(np.uint8)
    half = (len(data) + 1) // 2
    out = np.empty(len(data), np.uint8)
    out[::2], out[1::2] = data[:half], data[half:]
    return out.tobytes()


def decode_exr(data: bytes) -> Decoded:
    (flags,) = struct.unpack_from("<I", data, 4)
    if flags & 0x1A00:
        raise ValueError("tiled, deep or multi-part EXR isn't read")
    at, info = 8, {}
    while data[at]:
        name, at = _exr_text(data, at)
        _, at = _exr_text(data, at)
        (n,) = struct.unpack_from("<I", data, at)
        info[name], at = data[at + 4 : at + 4 + n], at + 4 + n
    at += 1
    channels, k = [], 0
    while info["channels"][k]:
        name, k = _exr_text(info["channels"], k)
        channels.append((name, struct.unpack_from("<I", info["channels"], k)[0]))
        k += 16
    x0, y0, x1, y1 = struct.unpack("<iiii", info["dataWindow"])
    w, h, packing = x1 - x0 + 1, y1 - y0 + 1, info["compression"][0]
    lines = 16 if packing == 3 else 1
    kinds = {0: ("<u4", 4), 1: ("<f2", 2), 2: ("<f4", 4)}
    planes = {name: np.zeros((h, w)) for name, _ in channels}
    step = sum(kinds[k][1] for _, k in channels) * w
    for place in struct.unpack_from(f"<{-(-h // lines)}Q", data, at):
        y, size = struct.unpack_from("<iI", data, place)
        rows = min(lines, y1 - y + 1)
        raw = _exr_unpacked(data[place + 8 : place + 8 + size], step * rows, packing)
        pos = 0
        for r in range(rows):
            for name, k in channels:
                planes[name][y - y0 + r] = np.frombuffer(raw, kinds[k][0], w, pos)
                pos += w * kinds[k][1]
    gray = planes.get("Y", np.zeros((h, w)))
    v = np.stack([planes.get(c, gray) for c in "RGB"] + [planes.get("A", np.ones((h, w)))], -1)
    return Decoded([v], linear=True)


def encode_exr(img: np.ndarray) -> bytes:
    """Float channels, each line packed on its own."""
    h, w = img.shape[:2]
    attribute = lambda name, kind, body: name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<I", len(body)) + body
    box = struct.pack("<iiii", 0, 0, w - 1, h - 1)
    head = b"\x76\x2f\x31\x01" + struct.pack("<I", 2)
    head += attribute("channels", "chlist", b"".join(c.encode() + b"\0" + struct.pack("<IIII", 2, 0, 1, 1) for c in "ABGR") + b"\0")
    head += attribute("compression", "compression", b"\2") + attribute("dataWindow", "box2i", box) + attribute("displayWindow", "box2i", box)
    head += attribute("lineOrder", "lineOrder", b"\0") + attribute("pixelAspectRatio", "float", struct.pack("<f", 1)) + attribute("screenWindowCenter", "v2f", struct.pack("<ff", 0, 0)) + attribute("screenWindowWidth", "float", struct.pack("<f", 1)) + b"\0"
    parts, places, at = [], [], len(head) + 8 * h
    for y in range(h):
        raw = np.frombuffer(img[y, :, [3, 2, 1, 0]].astype("<f4").tobytes(), np.uint8)
        split = np.concatenate([raw[::2], raw[1::2]]).astype(np.int64)
        packed = zlib.compress(np.concatenate([split[:1], np.diff(split) + 128]).astype(np.uint8).tobytes())
        body = packed if len(packed) < len(raw) else raw.tobytes()
        parts.append(struct.pack("<iI", y, len(body)) + body)
        places.append(at)
        at += len(parts[-1])
    return head + struct.pack(f"<{h}Q", *places) + b"".join(parts)


# DDS: plain pixels by masks, and blocks of four by four


def _dds_colors(two: np.ndarray, opaque: np.ndarray) -> np.ndarray:
    """Four colours of each block from two of 16 bits; blocks in which the first isn't greater have a clear one."""
    rgb = np.stack([(two >> s & m) * 255 / m for s, m in ((11, 31), (5, 63), (0, 31))], -1)
    a, b = rgb[:, 0], rgb[:, 1]
    four = opaque[:, None]
    third, fourth = np.where(four, (2 * a + b) / 3, (a + b) / 2), np.where(four, (a + 2 * b) / 3, 0)
    out = np.stack([a, b, third, fourth], 1)
    alpha = np.full((len(two), 4, 1), 255.0)
    alpha[~opaque, 3] = 0
    return np.concatenate([out, alpha], -1)


def decode_dds(data: bytes) -> Decoded:
    h, w = struct.unpack_from("<II", data, 12)
    kind, code, bits, *masks = struct.unpack_from("<I4sIIIII", data, 80)
    if not kind & 4:
        words = np.frombuffer(np.pad(np.frombuffer(data, np.uint8, w * h * bits // 8, 128).reshape(-1, bits // 8), ((0, 0), (0, 4 - bits // 8))).tobytes(), "<u4").astype(np.int64).reshape(h, w)
        return Decoded([np.stack([(words & m) // (m & -m) / (m // (m & -m)) if m else np.full((h, w), 1.0 if k == 3 else 0.0) for k, m in enumerate(masks)], -1)])
    size = {b"DXT1": 8, b"DXT3": 16, b"DXT5": 16}[code]
    rows, cols = -(-h // 4), -(-w // 4)
    blocks = np.frombuffer(data, np.uint8, rows * cols * size, 128).reshape(-1, size)
    color = np.ascontiguousarray(blocks[:, -8:])
    two = np.ascontiguousarray(color[:, :4]).view("<u2").astype(np.int64)
    pick = (np.ascontiguousarray(color[:, 4:]).view("<u4").astype(np.int64) >> 2 * np.arange(16)) & 3
    table = _dds_colors(two, (two[:, 0] > two[:, 1]) | (code != b"DXT1"))
    v = table[np.arange(len(blocks))[:, None], pick]
    if code == b"DXT3":
        v[..., 3] = ((np.ascontiguousarray(blocks[:, :8]).view("<u8") >> (4 * np.arange(16)).astype(np.uint64)) & np.uint64(15)) * 17.0
    elif code == b"DXT5":
        a, b = (blocks[:, k].astype(float)[:, None] for k in (0, 1))
        word = np.concatenate([blocks[:, 2:8], np.zeros((len(blocks), 2), np.uint8)], 1).view("<u8")
        at = ((word >> (3 * np.arange(16)).astype(np.uint64)) & np.uint64(7)).astype(int)
        k = np.arange(8)
        eight = np.where(k < 2, np.where(k == 0, a, b), ((8 - k) * a + (k - 1) * b) / 7)
        six = np.where(k < 2, np.where(k == 0, a, b), np.where(k < 6, ((6 - k) * a + (k - 1) * b) / 5, np.where(k == 6, 0, 255)))
        v[..., 3] = np.where(a > b, eight, six)[np.arange(len(blocks))[:, None], at]
    img = v.reshape(rows, cols, 4, 4, 4).transpose(0, 2, 1, 3, 4).reshape(rows * 4, cols * 4, 4)[:h, :w]
    return Decoded([np.ascontiguousarray(img) / 255])


def encode_dds(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    head = struct.pack("<4sIIIIIII", b"DDS ", 124, 0x100F, h, w, w * 4, 0, 0) + bytes(44)
    head += struct.pack("<II4sIIIII", 32, 0x41, bytes(4), 32, 0xFF, 0xFF00, 0xFF0000, 0xFF000000) + struct.pack("<IIIII", 0x1000, 0, 0, 0, 0)
    return head + levels8(img).tobytes()


# WebP


def decode_webp(data: bytes) -> Decoded:
    frames, delays, _ = webp.decode(data)
    return Decoded([rgba(f) for f in frames], delays)


def encode_webp(img: np.ndarray) -> bytes:
    """Lossless."""
    return webp.encode(levels8(img))


MAGIC: tuple[tuple[str, Callable[[bytes], bool]], ...] = (
    ("png", lambda d: d[:8] == b"\x89PNG\r\n\x1a\n"),
    ("jpeg", lambda d: d[:3] == b"\xff\xd8\xff"),
    ("gif", lambda d: d[:6] in (b"GIF87a", b"GIF89a")),
    ("webp", lambda d: d[:4] == b"RIFF" and d[8:12] == b"WEBP"),
    ("bmp", lambda d: d[:2] == b"BM"),
    ("exr", lambda d: d[:4] == b"\x76\x2f\x31\x01"),
    ("dds", lambda d: d[:4] == b"DDS "),
    ("qoi", lambda d: d[:4] == b"qoif"),
    ("tiff", lambda d: d[:4] in (b"II*\0", b"MM\0*")),
    ("hdr", lambda d: d[:2] == b"#?"),
    ("fits", lambda d: d[:9] == b"SIMPLE  ="),
    ("ico", lambda d: d[:4] in (b"\0\0\1\0", b"\0\0\2\0") and d[4:6] != b"\0\0"),
    ("pnm", lambda d: d[:1] == b"P" and d[1:2] in b"1234567Ff" and len(d) > 2),
    ("tga", lambda d: len(d) > 18 and d[1] in (0, 1) and d[2] in (1, 2, 3, 9, 10, 11) and d[16] in (8, 15, 16, 24, 32)),
)
DECODERS: dict[str, Callable[[bytes], Decoded]] = {
    "png": decode_png, "jpeg": decode_jpeg, "gif": decode_gif, "webp": decode_webp, "bmp": decode_bmp, "qoi": decode_qoi, "tiff": decode_tiff, "hdr": decode_hdr, "fits": decode_fits, "exr": decode_exr, "dds": decode_dds, "ico": decode_ico, "pnm": decode_pnm, "tga": decode_tga,
}
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "png": encode_png, "jpeg": encode_jpeg, "gif": lambda img: encode_gif([img]), "webp": encode_webp, "bmp": encode_bmp, "qoi": encode_qoi, "tiff": encode_tiff, "hdr": encode_hdr, "fits": encode_fits, "exr": encode_exr, "dds": encode_dds, "ico": encode_ico,
    "ppm": encode_ppm, "pgm": encode_pgm, "pbm": encode_pbm, "pam": encode_pam, "pfm": encode_pfm, "tga": encode_tga,
}


def detect(data: bytes) -> str | None:
    """Format by the first bytes."""
    return next((name for name, test in MAGIC if test(data)), None)


def decode(data: bytes, hint: str | None = None, profiles: bool = True) -> Decoded:
    """Linear frames of a file, by its ICC profile if it has one that can be read, else taken as sRGB."""
    name = detect(data) or hint
    if name not in DECODERS:
        raise ValueError(f"no decoder for {name or 'this data'}")
    try:
        found = DECODERS[name](data)
    except (struct.error, IndexError, KeyError, TypeError, AttributeError, StopIteration, zlib.error) as broken:
        raise ValueError(f"broken {name} data: {broken!r}") from broken
    if not found.linear:
        convert = (_profiled(data) if profiles else None) or to_linear
        for f in found.frames:
            f[..., :3] = convert(f[..., :3])
    return found


def _profiled(data: bytes) -> Callable[[np.ndarray], np.ndarray] | None:
    """What a file's own profile makes of its levels: of RGB and gray ones; levels of CMYK files are RGB by then."""
    content = icc.extract(data)
    try:
        profile = icc.Profile(content) if content else None
    except ValueError:
        return None
    return profile.linear if profile and profile.space in ("RGB", "GRAY") else None


def encode(img: np.ndarray, name: str) -> bytes:
    """A file of one linear frame."""
    if name not in ENCODERS:
        raise ValueError(f"no encoder for {name}")
    return ENCODERS[name](img)
