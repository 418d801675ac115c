"""JPEG files: baseline and progressive decoding, baseline encoding, in numpy."""

from __future__ import annotations

import struct

import numpy as np

#: Order of coefficients, and example tables of the standard for a quality of 50.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
LUMA_STEPS = np.array([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMA_STEPS = np.full((8, 8), 99)
CHROMA_STEPS[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]

_k = np.arange(8)
#: Rows are the basis functions of the transform.
DCT = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5)


class Bits:
    """Reader of entropy-coded data, without stuffing and up to the next marker."""

    def __init__(self, data: bytes, at: int):
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0:
                end += 2
                continue
            break
        self.next = end
        self.data = data[at:end].replace(b"\xff\0", b"\xff")
        self.word, self.have, self.at = 0, 0, 0

    def fill(self, n: int) -> None:
        if self.at > len(self.data) + 16:
            raise ValueError("the data ends before the image")
        while self.have < n:
            self.word = (self.word << 8 | (self.data[self.at] if self.at < len(self.data) else 0)) & (1 << 40) - 1
            self.at += 1
            self.have += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.fill(n)
        self.have -= n
        return self.word >> self.have & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> n - 1 else v - (1 << n) + 1

    def symbol(self, table: np.ndarray) -> int:
        """table: symbol and length for each 16 bits ahead."""
        self.fill(16)
        entry = table[self.word >> self.have - 16 & 0xFFFF]
        self.have -= entry & 31
        return entry >> 5


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    out, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << 16 - length
            out[first : first + (1 << 16 - length)] = [symbols[k] << 5 | length] * (1 << 16 - length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Plane:
    def __init__(self, ident: int, h: int, v: int, steps: int):
        self.ident, self.h, self.v, self.steps = ident, h, v, steps
        self.dc = self.ac = None
        self.last = 0


def decode(data: bytes) -> np.ndarray:
    """Levels as floats from 0 to 255: gray, RGB, or CMYK."""
    at, steps, dc, ac, planes, adobe, restart = 2, {}, {}, {}, [], None, 0
    w = h = 0
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        kind = data[at + 1]
        if kind in (0xD8, 0xFF, 0) or 0xD0 <= kind <= 0xD7:
            at += 2 - (kind == 0xFF)
            continue
        if kind == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                n = 64 * (2 if body[0] >> 4 else 1)
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if body[0] >> 4 else np.uint8).astype(float)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1, 0xC2):
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit JPEG is read")
            planes = [Plane(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(p.h for p in planes), max(p.v for p in planes)
            across, down = -(-w // (8 * hmax)), -(-h // (8 * vmax))
            for p in planes:
                p.blocks = np.zeros((down * p.v, across * p.h, 64), np.int32)
                p.size = -(-(-(-h * p.v // vmax)) // 8), -(-(-(-w * p.h // hmax)) // 8)
        elif 0xC3 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("this kind of JPEG coding isn't read")
        elif kind == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            chosen = []
            for i in range(body[0]):
                p = next(p for p in planes if p.ident == body[1 + 2 * i])
                p.dc, p.ac = dc.get(body[2 + 2 * i] >> 4), ac.get(body[2 + 2 * i] & 15)
                chosen.append(p)
            first, last, shift = body[1 + 2 * body[0] :][:3]
            at = _scan(data, at, chosen, first, last, shift >> 4, shift & 15, restart, across, down)
    return _assembled(planes, steps, w, h, adobe)


def _scan(data, at, chosen, first, last, high, low, restart, across, down) -> int:
    bits = Bits(data, at)
    if len(chosen) == 1:
        rows, cols = chosen[0].size
        units = [[(chosen[0], y, x)] for y in range(rows) for x in range(cols)]
    else:
        units = [[(p, my * p.v + v, mx * p.h + u) for p in chosen for v in range(p.v) for u in range(p.h)] for my in range(down) for mx in range(across)]
    run = 0
    baseline = last == 63 and first == 0
    for p in chosen:
        p.last = 0
    for k, unit in enumerate(units):
        if restart and k and k % restart == 0:
            bits = Bits(data, bits.next + 2)
            run = 0
            for p in chosen:
                p.last = 0
        for p, y, x in unit:
            block = p.blocks[y, x]
            if first == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    p.last += bits.signed(bits.symbol(p.dc))
                    block[0] = p.last << low
            if baseline:
                i = 1
                while i < 64:
                    s = bits.symbol(p.ac)
                    if not s & 15:
                        if s != 0xF0:
                            break
                        i += 16
                        continue
                    i += s >> 4
                    if i > 63:
                        break
                    block[i] = bits.signed(s & 15)
                    i += 1
            elif first:
                run = _first_pass(bits, p, block, first, last, low, run) if not high else _later_pass(bits, p, block, first, last, low, run)
    return bits.next


def _first_pass(bits, p, block, first, last, low, run) -> int:
    if run:
        return run - 1
    i = first
    while i <= last:
        s = bits.symbol(p.ac)
        r, n = s >> 4, s & 15
        if n:
            i += r
            block[i] = bits.signed(n) << low
            i += 1
        elif r == 15:
            i += 16
        else:
            return (1 << r) - 1 + bits.take(r)
    return 0


def _later_pass(bits, p, block, first, last, low, run) -> int:
    one = 1 << low
    i = first

    def refine(i: int) -> None:
        if bits.take(1) and not abs(int(block[i])) & one:
            block[i] += one if block[i] > 0 else -one

    if not run:
        while i <= last:
            s = bits.symbol(p.ac)
            r, n = s >> 4, s & 15
            value = 0
            if n:
                value = one if bits.take(1) else -one
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while i <= last:
                if block[i]:
                    refine(i)
                elif r == 0:
                    break
                else:
                    r -= 1
                i += 1
            if n and i <= last:
                block[i] = value
            i += 1
    if run:
        for j in range(i, last + 1):
            if block[j]:
                refine(j)
        run -= 1
    return run


def _assembled(planes, steps, w, h, adobe) -> np.ndarray:
    hmax, vmax = max(p.h for p in planes), max(p.v for p in planes)
    out = []
    for p in planes:
        flat = np.zeros(p.blocks.shape)
        flat[..., ZIGZAG] = p.blocks * steps[p.steps]
        rows, cols = flat.shape[:2]
        px = np.einsum("ki,rckl,lj->ricj", DCT, flat.reshape(rows, cols, 8, 8), DCT).reshape(rows * 8, cols * 8) + 128
        out.append(np.clip(np.repeat(np.repeat(px, vmax // p.v, 0), hmax // p.h, 1)[:h, :w], 0, 255))
    v = np.stack(out, -1)
    if v.shape[-1] == 1 or (v.shape[-1] == 3 and adobe == 0):
        return v
    if v.shape[-1] == 4 and adobe != 2:
        return 255 - v if adobe is not None else v
    y, cb, cr = v[..., 0], v[..., 1] - 128, v[..., 2] - 128
    rgb = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1), 0, 255)
    return np.concatenate([255 - rgb, 255 - v[..., 3:]], -1) if v.shape[-1] == 4 else rgb


def _code_table(pairs: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Huffman code of at most 16 bits for symbols by how often they occur; no code is all ones."""
    import heapq

    heap = [(n, [s]) for s, n in pairs.items()] + [(0, [256])]
    lengths = dict.fromkeys([*pairs, 256], 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, x + y))
    count = [0] * 64
    for n in lengths.values():
        count[max(n, 1)] += 1
    for n in range(63, 16, -1):  # codes that are too long move up, as the standard does
        while count[n]:
            j = n - 2
            while not count[j]:
                j -= 1
            count[n] -= 2
            count[n - 1] += 1
            count[j + 1] += 2
            count[j] -= 1
    n = 16
    while not count[n]:
        n -= 1
    count[n] -= 1  # the reserved code
    order = sorted(pairs, key=lambda s: (lengths[s], s))
    codes, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(count[length]):
            codes[order[k]] = code, length
            code, k = code + 1, k + 1
        code <<= 1
    return bytes(count[1:17]), bytes(order), codes


def encode(levels: np.ndarray, quality: int = 85) -> bytes:
    """Baseline file of RGB levels, chroma at full resolution, with Huffman codes made for it."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip(np.floor((t * scale + 50) / 100), 1, 255) for t in (LUMA_STEPS, CHROMA_STEPS)]
    h, w = levels.shape[:2]
    r, g, b = levels[..., :3].astype(float).transpose(2, 0, 1)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    rows, cols = -(-h // 8), -(-w // 8)
    coded = []
    for k, p in enumerate(planes):
        p = np.pad(p - 128, ((0, rows * 8 - h), (0, cols * 8 - w)), mode="edge").reshape(rows, 8, cols, 8)
        c = np.einsum("ki,ricj,lj->rckl", DCT, p, DCT) / tables[min(k, 1)]
        coded.append(np.rint(c).astype(int).reshape(rows * cols, 64)[:, ZIGZAG])
    tokens = _tokens(np.stack(coded, 1))
    counts = np.bincount(tokens[0] << 8 | tokens[1], minlength=1024).reshape(4, 256)
    huff = [_code_table({int(s): int(c[s]) for s in np.flatnonzero(c)}) for c in counts]
    codes = np.zeros((2, 1024), np.int64)
    for t, (_, _, table) in enumerate(huff):
        for s, pair in table.items():
            codes[:, t << 8 | s] = pair
    code, length = codes[:, tokens[0] << 8 | tokens[1]]
    out = _packed_bits(code << tokens[3] | tokens[2], length + tokens[3]).replace(b"\xff", b"\xff\0")
    segment = lambda kind, body: bytes((0xFF, kind)) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for k, t in enumerate(tables):
        head += segment(0xDB, bytes((k,)) + t.ravel()[ZIGZAG].astype(np.uint8).tobytes())
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes((k + 1, 0x11, min(k, 1))) for k in range(3)))
    for t, place in zip(range(4), (0x00, 0x01, 0x10, 0x11), strict=True):
        head += segment(0xC4, bytes((place,)) + huff[t][0] + huff[t][1])
    return head + segment(0xDA, b"\3" + bytes((1, 0, 2, 0x11, 3, 0x11)) + b"\0\x3f\0") + out + b"\xff\xd9"


def _tokens(blocks: np.ndarray) -> np.ndarray:
    """(table, symbol, extra bits, how many) of coefficients (block, plane, 64), in the order of the file: tables 0 and 1 are for first coefficients, 2 and 3 for the rest."""
    n = blocks.shape[0] * 3
    flat = blocks.reshape(n, 64)
    plane = np.minimum(np.arange(n) % 3, 1)
    first = np.diff(blocks[..., 0], axis=0, prepend=0).reshape(n)
    unit, place = np.nonzero(flat[:, 1:])
    place = place + 1
    fresh = np.concatenate([[True], unit[1:] != unit[:-1]])[: len(unit)]
    zeros = place - np.where(fresh, 0, np.concatenate([[0], place[:-1]])[: len(unit)]) - 1
    sixteen = np.repeat(np.arange(len(unit)), zeros >> 4)
    short = np.flatnonzero(np.bincount(unit[place == 63], minlength=n) == 0)  # units that end in zeros
    value = np.concatenate([first, np.zeros(len(sixteen), np.int64), flat[unit, place], np.zeros(len(short), np.int64)])
    size = np.frexp(np.abs(value))[1].astype(np.int64)
    symbol = np.concatenate([np.zeros(n, np.int64), np.full(len(sixteen), 0xF0), (zeros & 15) << 4, np.zeros(len(short), np.int64)]) | size
    table = np.concatenate([plane, 2 + plane[unit[sixteen]], 2 + plane[unit], 2 + plane[short]])
    extra = np.where(value > 0, value, value + (1 << size) - 1)
    order = np.argsort(np.concatenate([np.arange(n) * 66, unit[sixteen] * 66 + place[sixteen], unit * 66 + place, short * 66 + 65]), kind="stable")
    return np.stack([table, symbol, extra, size])[:, order]


def _packed_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values one after the other in their lengths of bits, highest bits first, filled up with ones."""
    stop = np.cumsum(lengths)
    after = np.repeat(stop, lengths) - np.arange(stop[-1]) - 1
    bits = (np.repeat(values, lengths) >> after & 1).astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()
