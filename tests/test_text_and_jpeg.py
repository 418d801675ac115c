import struct

import numpy as np
import pytest

from pixelloom.operators import text
from pixelloom.plans.registry import OPERATORS
from pixelloom.sources import codecs


def tiny_font() -> bytes:
    """A font whose A is a square of half an em and whose B is the A moved to the right."""
    square = struct.pack(">hhhhh", 1, 0, 0, 500, 500) + struct.pack(">HH", 3, 0) + bytes([1, 1, 1, 1]) + struct.pack(">hhhh", 0, 500, 0, -500) + struct.pack(">hhhh", 0, 0, 500, 0)
    moved = struct.pack(">hhhhh", -1, 250, 0, 750, 500) + struct.pack(">HHhh", 3, 1, 250, 0)
    glyphs = [b"", square, moved]
    offsets = [0]
    for g in glyphs:
        offsets.append(offsets[-1] + len(g) + len(g) % 4)
    glyf = b"".join(g + bytes(len(g) % 4) for g in glyphs)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">HHHHH", 66, 0xFFFF, 0, 65, 0xFFFF) + struct.pack(">hhHH", -64, 1, 0, 0)
    tables = {
        b"cmap": cmap, b"glyf": glyf, b"head": bytes(18) + struct.pack(">H", 1000) + bytes(30) + struct.pack(">hh", 1, 0), b"hhea": bytes(4) + struct.pack(">hh", 1000, -200) + bytes(26) + struct.pack(">H", 3),
        b"hmtx": struct.pack(">HhHhHh", 500, 0, 1000, 0, 1000, 0), b"loca": struct.pack(f">{len(offsets)}I", *offsets),
    }
    out, body, at = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b"", 12 + 16 * len(tables)
    for name, data in tables.items():
        out += name + struct.pack(">III", 0, at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    return out + body


def test_text_covers_what_its_outline_does():
    img = np.zeros((24, 48, 4))
    op = OPERATORS["draw_text"]
    out = op.kernel(img, **op.bind({"text": "AB", "x": 2.0, "y": 0.0, "size": 20.0, "font": tiny_font(), "color_g": 0.5}))
    want = np.zeros((24, 48))
    want[10:20, 2:12] = 1  # A: from the baseline at 20, half an em wide
    want[10:20, 27:37] = 1  # B: an em farther, moved by a quarter
    assert np.allclose(out[..., 0], want) and np.allclose(out[..., 1], want / 2) and np.allclose(out[..., 3], want)
    assert op.kernel(img, **op.bind({"text": "A"})) is img


def test_curves_are_round():
    circle = np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]], float)
    flat = text._flattened(circle, [True, False] * 4)
    x, y = flat.T
    area = abs(np.sum(x * np.roll(y, -1) - y * np.roll(x, -1))) / 2
    assert area == pytest.approx(2 + 4 / 3, abs=0.03)  # four parabolas over the square


@pytest.mark.parametrize("size", [(1, 1), (8, 8), (37, 45), (16, 7)])
def test_jpeg_comes_back(size):
    y, x = np.mgrid[0 : size[0], 0 : size[1]]
    v = np.stack([x / 50, y / 40, (x + y) / 100, np.ones_like(x, float)], -1)
    data = codecs.encode_jpeg(v, 97)
    got = codecs.decode(data).frames[0]
    assert got.shape == v.shape and np.abs(codecs.to_srgb(got) - codecs.to_srgb(v)).max() < 0.03
    assert len(codecs.encode_jpeg(np.random.default_rng(1).random((64, 64, 4)), 20)) < len(codecs.encode_jpeg(np.random.default_rng(1).random((64, 64, 4)), 90))


def test_progressive_jpeg():
    """A file made of scans by hand: first bits of DC and AC, then their last bits."""
    from pixelloom.sources import jpeg

    segment = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(0xC2, struct.pack(">BHHB", 8, 8, 8, 1) + bytes((1, 0x11, 0)))
    # DC code: 0 -> size 4; AC code: 0 -> (0, size 1), 10 -> end of block
    head += segment(0xC4, b"\0" + bytes([1] + [0] * 15) + bytes([4])) + segment(0xC4, b"\x10" + bytes([1, 1] + [0] * 14) + bytes([0x01, 0x00]))
    scan = lambda a, b, high, low, bits: segment(0xDA, bytes((1, 1, 0, a, b, high << 4 | low))) + int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    data = head + scan(0, 0, 0, 1, "0" + "1010") + scan(1, 63, 0, 1, "0" + "1" + "10") + scan(0, 0, 1, 0, "1") + scan(1, 63, 1, 0, "10" + "1") + b"\xff\xd9"
    block = np.zeros(64)
    block[0], block[1] = 21, 3  # 10 << 1 | 1, and 1 << 1 with a bit more
    flat = np.zeros(64)
    flat[jpeg.ZIGZAG] = block
    want = jpeg.DCT.T @ flat.reshape(8, 8) @ jpeg.DCT + 128
    assert np.allclose(jpeg.decode(data)[..., 0], np.clip(want, 0, 255))
