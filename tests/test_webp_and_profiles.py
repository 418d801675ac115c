"""Lossless WebP against streams written by hand and pixel-by-pixel restatements; ICC profiles against values by formula."""

import struct
import zlib

import numpy as np
import pytest

from pixelloom.sources import codecs, icc, images, webp


def levels(shape, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (*shape, 4), dtype=np.uint8)


def container(*parts):
    body = b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in parts)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (7, 1), (23, 31), (3, 600)])
@pytest.mark.parametrize("mode", [1, 2, 4, 6, 7, 8, 11, 12, 13])
def test_webp_comes_back(shape, mode):
    v = levels(shape)
    data = webp.encode(v, mode)
    assert (webp.decode(data)[0][0] == v).all()
    assert images.size_of(data[:40]) == ("webp", shape[1], shape[0])


def test_webp_as_a_file():
    img = np.random.default_rng(1).random((9, 14, 4))
    got = codecs.decode(codecs.encode(img, "webp"))
    assert (codecs.levels8(got.frames[0]) == codecs.levels8(img)).all()
    data = codecs.encode(img, "webp")
    for part in (len(data) // 2, 24, 12):
        with pytest.raises(ValueError):
            codecs.decode(data[:part], "webp")
    with pytest.raises(ValueError, match="lossy"):
        codecs.decode(container((b"VP8 ", bytes(20))))


def one(channel, left, top, right, corner, mode):
    """A channel's prediction for the modes that need no other channel, in whole numbers."""
    mean = lambda a, b: (a + b) // 2
    return {3: right, 5: mean(mean(left, right), top), 9: mean(top, right), 10: mean(mean(left, corner), mean(top, right))}[mode]


@pytest.mark.parametrize("mode", [3, 5, 9, 10])
@pytest.mark.parametrize("shape", [(1, 1), (5, 1), (6, 2), (9, 13)])
def test_modes_that_look_to_the_right(mode, shape):
    residual = levels(shape, 3)
    h, w = shape
    out = np.zeros((h * w, 4), int)
    for i in range(h * w):
        y, x = divmod(i, w)
        for c in range(4):
            if i == 0:
                guess = 255 * (c == 3)
            elif y == 0:
                guess = out[i - 1, c]
            elif x == 0:
                guess = out[i - w, c]
            else:  # the pixel after the row above is the first of this row
                guess = one(c, out[i - 1, c], out[i - w, c], out[i - w + 1, c], out[i - w - 1, c], mode)
            out[i, c] = (int(residual.reshape(-1, 4)[i, c]) + guess) % 256
    got = webp._unpredicted(np.ascontiguousarray(residual).view("<u4")[..., 0], np.full((h, w), mode << 8, np.uint32), 2)
    assert (webp._split(got).reshape(-1, 4) == out).all()


def simple(out, *symbols):
    out.put((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols))


def lengths_of(out, sizes, n):
    """A code of symbols {symbol: length} among n, its lengths written with four bits each."""
    out.put((0, 1), (15, 4), *((4 if k < 16 else 0, 3) for k in webp.LENGTH_ORDER), (0, 1))
    out.put(*((webp.reversed_bits(sizes.get(s, 0), 4), 4) for s in range(n)))
    return {s: (code, size) for s, size, code in webp.canonical([sizes.get(s, 0) for s in range(n)])}


def header(w, h):
    out = webp.Writer()
    out.put((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3))
    return out


def test_copies_and_cache():
    """Two literals, a copy of three from two pixels back, one from the row above, and a pixel of the cache."""
    out = header(4, 2)
    out.put((0, 1), (1, 1), (2, 4), (0, 1))  # no transform, a cache of four, one group
    argb = [0xFF00107F, 0xFF00207F]
    slots = [(v * webp.HASH & 0xFFFFFFFF) >> 30 for v in argb]
    green = lengths_of(out, {0x10: 2, 0x20: 2, 256 + 0: 3, 256 + 2: 3, 280 + slots[0]: 2}, 284)
    simple(out, 0)
    simple(out, 0x7F)
    simple(out, 255)
    far = lengths_of(out, {0: 1, 1: 2, 2: 2}, 40)
    # distances: the first near place is the row above, the second the pixel to the left; 122 - 120 = 2 would need more symbols
    out.put(green[0x10], green[0x20])
    out.put(green[256 + 0], far[1])  # one pixel, from the left
    out.put(green[280 + slots[0]])
    out.put(green[256 + 2], far[0])  # three pixels from the row above
    out.put(green[280 + slots[0]])
    got = webp.decode(container((b"VP8L", out.bytes())))[0][0]
    a, b = (0, 0x10, 0x7F, 255), (0, 0x20, 0x7F, 255)
    assert got.reshape(-1, 4).tolist() == [list(p) for p in (a, b, b, a, a, b, b, a)]


def test_palette_and_groups_by_place():
    out = header(10, 5)
    table = np.array([[1, 2, 3, 255], [50, 60, 70, 255], [9, 8, 7, 100]], np.uint8)  # B, G, R, A
    out.put((1, 1), (3, 2), (len(table) - 1, 8))
    webp._write_pixels(out, np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8))
    out.put((0, 1), (0, 1))
    # four indexes of two bits in a pixel, so three pixels a row; two groups of codes, by blocks of four
    out.put((1, 1), (0, 3))
    webp._write_pixels(out, np.array([[0, 0, 0, 0], [0, 1, 0, 0]], np.uint8))
    for value in (0b10_01_00_10, 0b00_00_01_01):
        for symbol in (value, 0, 0, 0, 0):
            simple(out, symbol)
    got = webp.decode(container((b"VP8L", out.bytes())))[0][0]
    top, low = [2, 0, 1, 2, 2, 0, 1, 2, 2, 0], [1, 1, 0, 0, 1, 1, 0, 0, 1, 1]
    assert (got == table[np.array([top] * 4 + [low])][..., [2, 1, 0, 3]]).all()


def test_red_and_blue_from_green():
    px = levels((4, 6), 5)
    words = np.ascontiguousarray(px).view("<u4")[..., 0]
    factors = np.full((1, 2), 0x00 << 24 | 0xF0 << 16 | 0x21 << 8 | 0x85, np.uint32)
    got = webp._split(webp._uncrossed(words, factors, 2))
    signed = lambda v: v - 256 if v > 127 else v
    for p, q in zip(px.reshape(-1, 4).astype(int).tolist(), got.reshape(-1, 4).tolist(), strict=True):
        red = (p[2] + (signed(0x85) * signed(p[1]) >> 5)) % 256
        blue = (p[0] + (signed(0x21) * signed(p[1]) >> 5) + (signed(0xF0) * signed(red) >> 5)) % 256
        assert q == [blue, p[1], red, p[3]]


def test_animation():
    a, b = levels((6, 8), 7), levels((4, 2), 8)
    a[..., 3] = 255
    b[:2, :, 3], b[2:, :, 3] = 255, 0

    def frame(v, x, y, ms, flags):
        h, w = v.shape[:2]
        inner = webp.encode(v)[12:]
        return b"ANMF", b"".join(n.to_bytes(3, "little") for n in (x // 2, y // 2, w - 1, h - 1, ms)) + bytes((flags,)) + inner

    data = container((b"VP8X", bytes((2, 0, 0, 0, 7, 0, 0, 5, 0, 0))), (b"ANIM", bytes(6)), frame(a, 0, 0, 40, 0), frame(b, 4, 2, 60, 0))
    frames, delays, _ = webp.decode(data)
    assert delays == [40, 60] and (frames[0] == a).all()
    want = a.copy()
    want[2:4, 4:6] = b[:2]
    assert (frames[1] == want).all() and images.size_of(data) == ("webp", 8, 6)


def test_places_of_short_distances():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-5:] == [(8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]


# profiles


def fixed(*values):
    return b"".join(struct.pack(">i", round(v * 65536)) for v in values)


def profile(space, pcs, tags):
    head = bytearray(128)
    head[16:20], head[20:24], head[36:40] = space, pcs, b"acsp"
    table, body, at = b"", b"", 132 + 12 * len(tags)
    for name, data in tags.items():
        data += b"\0" * (-len(data) % 4)
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data
    return bytes(head) + struct.pack(">I", len(tags)) + table + body


SRGB_CURVE = b"para\0\0\0\0\0\3\0\0" + fixed(2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)
COLUMNS = np.linalg.inv(icc.D50_TO_SRGB)


def matrix_profile(curve, columns=COLUMNS):
    tags = {bytes((c,)) + b"XYZ": b"XYZ \0\0\0\0" + fixed(*columns[:, k]) for k, c in enumerate(b"rgb")}
    return profile(b"RGB ", b"XYZ ", tags | {bytes((c,)) + b"TRC": curve for c in b"rgb"})


def test_a_profile_of_srgb_changes_nothing():
    v = np.random.default_rng(1).random((5, 6, 3))
    assert np.abs(icc.Profile(matrix_profile(SRGB_CURVE)).linear(v) - codecs.to_linear(v)).max() < 2e-4


def test_curves():
    v = np.linspace(0, 1, 11)
    assert np.allclose(icc.curve(b"curv\0\0\0\0" + struct.pack(">I", 0))(v), v)
    assert np.allclose(icc.curve(b"curv\0\0\0\0" + struct.pack(">IH", 1, 0x0233))(v), v ** (0x0233 / 256))
    assert np.allclose(icc.curve(b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 16384, 65535))(np.array([0.25, 0.75])), [8192 / 65535, 40959.5 / 65535])
    assert np.allclose(icc.curve(b"para\0\0\0\0\0\0\0\0" + fixed(1.8))(v), v**1.8, atol=1e-4)
    kind1 = icc.curve(b"para\0\0\0\0\0\1\0\0" + fixed(2, 2, -1))(v)
    assert np.allclose(kind1, np.where(v >= 0.5, (2 * v - 1) ** 2, 0), atol=1e-4)
    kind2 = icc.curve(b"para\0\0\0\0\0\2\0\0" + fixed(2, 2, -1, 0.25))(v)
    assert np.allclose(kind2, np.where(v >= 0.5, (2 * v - 1) ** 2, 0) + 0.25, atol=1e-4)
    kind4 = icc.curve(b"para\0\0\0\0\0\4\0\0" + fixed(2, 1, 0, 0.5, 0.35, 0.1, 0.2))(v)
    assert np.allclose(kind4, np.where(v >= 0.35, v**2 + 0.1, 0.5 * v + 0.2), atol=1e-4)


def test_tables_of_cmyk_into_lab():
    """A grid whose corners are white, less all inks; between them it is linear."""
    side, inputs = 2, 4
    grid = []
    for corner in range(side**inputs):
        inks = [corner >> 3 & 1, corner >> 2 & 1, corner >> 1 & 1, corner & 1]
        grid.append((65280 * (4 - sum(inks)) // 4, 32768, 32768))
    line = struct.pack(">2H", 0, 65535)
    tag = b"mft2\0\0\0\0" + bytes((inputs, 3, side, 0)) + fixed(1, 0, 0, 0, 1, 0, 0, 0, 1) + struct.pack(">2H", 2, 2) + line * inputs + np.array(grid, ">u2").tobytes() + line * 3
    p = icc.Profile(profile(b"CMYK", b"Lab ", {b"A2B0": tag}))
    got = p.linear(np.array([[0, 0, 0, 0], [1, 1, 1, 1], [0.5, 0, 0.25, 0.25]], float))
    gray = lambda light: icc.lab_to_xyz(np.array([light, 0, 0.0])) @ icc.D50_TO_SRGB.T
    assert np.allclose(got, [gray(100.0), gray(0.0), gray(75.0)], atol=1e-3)
    assert np.allclose(got[0], 1, atol=2e-3)


def test_profiles_in_files():
    img = np.random.default_rng(2).random((8, 8, 4))
    img[..., 3] = 1
    wide = matrix_profile(b"curv\0\0\0\0" + struct.pack(">IH", 1, 512))  # gamma 2
    png = codecs.encode(img, "png")
    body = b"p\0\0" + zlib.compress(wide)
    chunk = struct.pack(">I", len(body)) + b"iCCP" + body + struct.pack(">I", zlib.crc32(b"iCCP" + body))
    png = png[:33] + chunk + png[33:]
    assert icc.extract(png) == wide
    want = (codecs.levels8(img)[..., :3] / 255) ** 2
    assert np.abs(codecs.decode(png).frames[0][..., :3] - want).max() < 1e-3
    assert np.abs(codecs.decode(png, profiles=False).frames[0][..., :3] - img[..., :3]).max() < 0.006
    jpeg = codecs.encode(img, "jpeg")
    halves = wide[:100], wide[100:]
    notes = b"".join(b"\xff\xe2" + struct.pack(">H", 16 + len(h)) + b"ICC_PROFILE\0" + bytes((k + 1, 2)) + h for k, h in enumerate(halves))
    assert icc.extract(jpeg[:2] + notes + jpeg[2:]) == wide
    assert icc.extract(jpeg[:2] + notes[: 18 + 100] + jpeg[2:]) is None
    webp_file = codecs.encode(img, "webp")
    assert icc.extract(container((b"VP8X", bytes(10)), (b"ICCP", wide), (b"VP8L", dict(webp.chunks(webp_file[12:]))[b"VP8L"]))) == wide


def test_broken_profiles_are_left_alone():
    img = np.random.default_rng(2).random((4, 4, 4))
    png = codecs.encode(img, "png")
    body = b"p\0\0" + zlib.compress(matrix_profile(SRGB_CURVE)[:150])
    chunk = struct.pack(">I", len(body)) + b"iCCP" + body + struct.pack(">I", zlib.crc32(b"iCCP" + body))
    assert np.allclose(codecs.decode(png[:33] + chunk + png[33:]).frames[0], codecs.decode(png).frames[0])
    for data in (b"", bytes(200), matrix_profile(SRGB_CURVE)[:140]):
        with pytest.raises(ValueError):
            icc.Profile(data)
