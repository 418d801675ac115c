"""Lossless WebP (VP8L) in Python and numpy: still images and animations are read, still images written.

The lossy coding is not read: its default probabilities, over a thousand of them,
follow from no rule. decode() says so by an error.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the format: the order of lengths of the code that code lengths are in, and the sizes of the alphabets.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)
HASH = 0x1E35A7BD

#: Places that short distances stand for: the nearest places before a pixel, within eight columns and seven rows.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))

OPAQUE = 0xFF000000


class Bits:
    """Bits of a stream, lowest first. Reading past its end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.word, self.have = data, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.at : self.at + 8]
        self.word |= int.from_bytes(more, "little") << self.have
        self.at += len(more)
        self.have += 8 * len(more)

    def take(self, n: int) -> int:
        if self.have < n:
            self.fill()
            if self.have < n:
                raise ValueError("the data end early")
        value = self.word & ((1 << n) - 1)
        self.word >>= n
        self.have -= n
        return value


def reversed_bits(value: int, n: int) -> int:
    return int(f"{value:0{n}b}"[::-1], 2) if n else 0


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of symbols with a length."""
    out, code = [], 0
    for n in range(1, 16):
        for symbol, length in enumerate(lengths):
            if length == n:
                out.append((symbol, n, reversed_bits(code, n)))
                code += 1
        code <<= 1
    return out


class Code:
    """A prefix code: a table over as many bits as the longest one has."""

    def __init__(self, lengths: list[int]):
        codes = canonical(lengths)
        if not codes:
            raise ValueError("a code without symbols")
        if len(codes) == 1:  # takes no bits
            self.bits, self.table = 0, [codes[0][0] << 4]
            return
        if sum(1 << 15 - n for _, n, _ in codes) != 1 << 15:
            raise ValueError("a code that isn't complete")
        self.bits = codes[-1][1]
        self.table = [0] * (1 << self.bits)
        for symbol, n, code in codes:
            self.table[code :: 1 << n] = [symbol << 4 | n] * (1 << self.bits - n)

    def read(self, bits: Bits) -> int:
        if bits.have < self.bits:
            bits.fill()
        entry = self.table[bits.word & ((1 << self.bits) - 1)]
        n = entry & 15
        if n > bits.have:
            raise ValueError("the data end early")
        bits.word >>= n
        bits.have -= n
        return entry >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        for n in (8 if wide else 1, 8)[: 1 + two]:
            lengths[bits.take(n)] = 1
        return Code(lengths)
    order = LENGTH_ORDER[: 4 + bits.take(4)]
    own = [0] * len(LENGTH_ORDER)
    for k in order:
        own[k] = bits.take(3)
    code = Code(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            last = n or last
            at += 1
            continue
        value, extra, least = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[n - 16]
        run = least + bits.take(extra)
        if at + run > size:
            raise ValueError("a run of code lengths is too long")
        lengths[at : at + run] = [value] * run
        at += run
    return Code(lengths)


def _spread(bits: Bits, symbol: int) -> int:
    """Lengths and distances: the symbol gives the highest two bits, further ones follow."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def _pixels(bits: Bits, w: int, h: int, main: bool = False) -> np.ndarray:
    """ARGB words of a coded image; only the main one may choose codes by place."""
    slots = bits.take(4) if bits.take(1) else 0
    if slots > 11:
        raise ValueError("the colour cache is too large")
    choice, block = None, 0
    if main and bits.take(1):
        block = bits.take(3) + 2
        choice = (_pixels(bits, -(-w >> block), -(-h >> block)) >> 8 & 0xFFFF).astype(int).tolist()
    kinds = 1 + (max(map(max, choice)) if choice else 0)
    sizes = (ALPHABETS[0] + (1 << slots if slots else 0), *ALPHABETS[1:])
    groups = [[_read_code(bits, n) for n in sizes] for _ in range(kinds)]
    out, total = [], w * h
    cache, shift = [0] * (1 << slots), 32 - slots
    green, red, blue, alpha, far = groups[0]
    seen = 0  # pixels that the cache has taken in
    while len(out) < total:
        at = len(out)
        if choice:
            green, red, blue, alpha, far = groups[choice[at // w >> block][at % w >> block]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out.append(a << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            n = _spread(bits, s - 256)
            d = _spread(bits, far.read(bits))
            if d > len(NEAR):
                d -= len(NEAR)
            else:
                x, y = NEAR[d - 1]
                d = max(x + y * w, 1)
            if d > at or at + n > total:
                raise ValueError("a copy from outside the image")
            piece = out[at - d : at - d + n]
            out += (piece * -(-n // len(piece)))[:n]
        else:
            for v in out[seen:]:
                cache[(v * HASH & 0xFFFFFFFF) >> shift] = v
            seen = at
            out.append(cache[s - 280])
    return np.array(out, np.uint32).reshape(h, w)


def _split(words: np.ndarray) -> np.ndarray:
    """Bytes B, G, R, A of ARGB words."""
    return np.ascontiguousarray(words.astype("<u4")).view(np.uint8).reshape(*words.shape, 4)


def _blocks(v: np.ndarray, block: int, h: int, w: int) -> np.ndarray:
    return np.repeat(np.repeat(v, 1 << block, 0), 1 << block, 1)[:h, :w]


def _guess(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What a mode predicts of the pixels to the left, above, above to the right and above to the left (int16, four channels)."""
    mean = lambda a, b: a + b >> 1
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        m = mean(left, top)
        # half of the difference, rounded towards zero
        return np.clip(m + np.sign(m - corner) * (np.abs(m - corner) >> 1), 0, 255)
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: right, 4: lambda: corner, 5: lambda: mean(mean(left, right), top), 6: lambda: mean(left, corner), 7: lambda: mean(left, top),
        8: lambda: mean(corner, top), 9: lambda: mean(top, right), 10: lambda: mean(mean(left, corner), mean(top, right)),
    }
    if mode in simple:
        return simple[mode]()
    return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), left.shape)


def _unpredicted(words: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Residuals to pixels, by lines of equal x + 2 y, on which no pixel depends on another."""
    h, w = words.shape
    kind = _blocks(modes >> 8 & 15, block, h, w).astype(np.int64)
    kind[0, :], kind[:, 0] = 1, 2
    kind[0, 0] = 0
    present = np.unique(kind).tolist()
    diff = _split(words).astype(np.int16)
    # a column on the left, and one on the right that is the next row's first
    out = np.zeros((h + 1, w + 2, 4), np.int16)
    for d in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (d - w + 2) // 2), min(h, d // 2 + 1))
        x = d - 2 * y
        left, top, right, corner = out[y + 1, x], out[y, x + 1], out[y, x + 2], out[y, x]
        kinds = kind[y, x]
        guess = _guess(present[0], left, top, right, corner)
        for mode in present[1:]:
            guess = np.where((kinds == mode)[:, None], _guess(mode, left, top, right, corner), guess)
        value = diff[y, x] + guess & 255
        out[y + 1, x + 1] = value
        first = x == 0
        out[y[first], w + 1] = value[first]
    return np.ascontiguousarray(out[1:, 1:-1].astype(np.uint8)).view("<u4")[..., 0]


def _uncrossed(words: np.ndarray, factors: np.ndarray, block: int) -> np.ndarray:
    """Red and blue with what green and red foretell of them."""
    h, w = words.shape
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    f = _blocks(factors, block, h, w)
    to_red, to_blue, red_blue = (signed(f >> n & 255) for n in (0, 8, 16))
    px = _split(words).astype(np.int32)
    green = signed(px[..., 1])
    red = px[..., 2] + (to_red * green >> 5) & 255
    blue = px[..., 0] + (to_blue * green >> 5) + (red_blue * signed(red) >> 5) & 255
    return (px[..., 3] << 24 | red << 16 | px[..., 1] << 8 | blue).astype(np.uint32)


def decode_lossless(data: bytes, headless: tuple[int, int] | None = None) -> np.ndarray:
    """RGBA levels of a VP8L stream; headless: (width, height) of one without a header, as alpha planes have."""
    bits = Bits(data)
    if headless:
        w, h = headless
    else:
        if bits.take(8) != 0x2F:
            raise ValueError("no lossless stream")
        w, h = bits.take(14) + 1, bits.take(14) + 1
        bits.take(1)
        if bits.take(3):
            raise ValueError("an unknown version of the lossless stream")
    steps, wide = [], w
    while bits.take(1):
        kind = bits.take(2)
        if kind in [k for k, *_ in steps]:
            raise ValueError("a transform is given twice")
        if kind < 2:
            block = bits.take(3) + 2
            steps.append((kind, _pixels(bits, -(-wide >> block), -(-h >> block)), block, wide))
        elif kind == 2:
            steps.append((kind, None, 0, wide))
        else:
            n = bits.take(8) + 1
            table = np.cumsum(_split(_pixels(bits, n, 1)), axis=1, dtype=np.uint8).view("<u4")[0, :, 0]
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, table, pack, wide))
            wide = -(-wide >> pack)
    v = _pixels(bits, wide, h, main=True)
    for kind, side, size, width in reversed(steps):
        if kind == 0:
            v = _unpredicted(v, side, size)
        elif kind == 1:
            v = _uncrossed(v, side, size)
        elif kind == 2:
            px = _split(v).copy()
            px[..., 0] += px[..., 1]
            px[..., 2] += px[..., 1]
            v = px.view("<u4")[..., 0]
        else:
            deep = 8 >> size
            index = (v >> 8 & 255)[..., None] >> (np.arange(1 << size) * deep).astype(np.uint32) & ((1 << deep) - 1)
            index = index.reshape(h, -1)[:, :width]
            v = np.append(side, [np.uint32(0)] * (256 - len(side))).astype("<u4")[index]
    return _split(v)[..., [2, 1, 0, 3]]


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(name, body) of the parts of a container."""
    out, at = [], 0
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        if at + 8 + size > len(data):
            raise ValueError("a part ends early")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def size_of(data: bytes) -> tuple[int, int]:
    """Width and height from the header, of lossy files too."""
    name, body = data[12:16], data[20:30]
    if name == b"VP8X":
        return 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little")
    if name == b"VP8L":
        word = int.from_bytes(body[1:5], "little")
        return (word & 0x3FFF) + 1, (word >> 14 & 0x3FFF) + 1
    if name == b"VP8 ":
        w, h = struct.unpack_from("<HH", body, 6)
        return w & 0x3FFF, h & 0x3FFF
    raise ValueError("no size")


def decode(data: bytes) -> tuple[list[np.ndarray], list[int], dict[bytes, bytes]]:
    """Frames as RGBA levels, delays in milliseconds, and the parts by name (of profiles and notes)."""
    parts = chunks(data[12:])
    named = dict(parts)
    if b"ANIM" not in named:
        if b"VP8L" not in named:
            raise ValueError("lossy WebP isn't read" if b"VP8 " in named else "no image")
        return [decode_lossless(named[b"VP8L"])], [], named
    w, h = size_of(data)
    canvas, frames, delays = np.zeros((h, w, 4)), [], []
    for name, body in parts:
        if name != b"ANMF":
            continue
        x, y = (2 * int.from_bytes(body[k : k + 3], "little") for k in (0, 3))
        inner = dict(chunks(body[16:]))
        if b"VP8L" not in inner:
            raise ValueError("lossy WebP isn't read")
        drawn = decode_lossless(inner[b"VP8L"]).astype(float)
        fh, fw = drawn.shape[:2]
        box = canvas[y : y + fh, x : x + fw]
        if box.shape != drawn.shape:
            raise ValueError("a frame outside the canvas")
        if body[15] & 2:
            box[:] = drawn
        else:  # over what is there
            a, under = drawn[..., 3:] / 255, box[..., 3:] / 255 * (1 - drawn[..., 3:] / 255)
            whole = a + under
            box[..., :3] = np.where(whole > 0, (drawn[..., :3] * a + box[..., :3] * under) / np.where(whole > 0, whole, 1), 0)
            box[..., 3:] = whole * 255
        frames.append(np.rint(canvas).astype(np.uint8))
        delays.append(int.from_bytes(body[12:15], "little"))
        if body[15] & 1:
            box[:] = 0
    if not frames:
        raise ValueError("no frame")
    return frames, delays, named


class Writer:
    """Values of given lengths, lowest bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []

    def put(self, *pairs: tuple[int, int]) -> None:
        self.many(np.array([v for v, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64))

    def many(self, values: np.ndarray, lengths: np.ndarray) -> None:
        self.values.append(values.astype(np.uint64))
        self.lengths.append(lengths)

    def bytes(self) -> bytes:
        values, lengths = np.concatenate(self.values), np.concatenate(self.lengths)
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        place = (np.arange(len(begin)) - begin).astype(np.uint64)
        return np.packbits((np.repeat(values, lengths) >> place & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray, most: int = 15) -> list[int]:
    """Lengths of a Huffman code of at most `most` bits; counts are levelled until they allow it."""
    used = np.flatnonzero(counts)
    weight = {int(s): int(counts[s]) for s in used}
    while True:
        lengths = dict.fromkeys(weight, 0)
        heap = [(n, [s]) for s, n in weight.items()]
        heapq.heapify(heap)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                lengths[s] += 1
            heapq.heappush(heap, (a + b, x + y))
        if max(lengths.values()) <= most:
            return [lengths.get(s, 0) for s in range(len(counts))]
        weight = {s: n // 2 + 1 for s, n in weight.items()}


def _write_code(out: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Writes the code of symbols by their counts; gives code and length of each symbol."""
    used = np.flatnonzero(counts)
    codes, sizes = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    if len(used) < 2:  # one symbol takes no bits
        symbol = int(used[0]) if len(used) else 0
        out.put((1, 1), (0, 1), (1, 1), (symbol, 8))
        return codes, sizes
    lengths = code_lengths(counts)
    for symbol, n, code in canonical(lengths):
        codes[symbol], sizes[symbol] = code, n
    # the lengths themselves: sixteen of four bits, all the same
    out.put((0, 1), (len(LENGTH_ORDER) - 4, 4), *((4 if k < 16 else 0, 3) for k in LENGTH_ORDER), (0, 1))
    out.put(*((reversed_bits(n, 4), 4) for n in lengths))
    return codes, sizes


def _write_pixels(out: Writer, px: np.ndarray, main: bool = False) -> None:
    """A coded image of bytes B, G, R, A, each pixel by itself."""
    out.put((0, 1), *([(0, 1)] if main else []))
    flat = px.reshape(-1, 4)
    value, length = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.int64)
    for channel, size in ((1, ALPHABETS[0]), (2, 256), (0, 256), (3, 256)):
        codes, sizes = _write_code(out, np.bincount(flat[:, channel], minlength=size))
        value |= codes[flat[:, channel]] << length.astype(np.uint64)
        length = length + sizes[flat[:, channel]]
    _write_code(out, np.zeros(ALPHABETS[4], np.int64))
    out.many(value, length)


def encode(levels: np.ndarray, mode: int = 11) -> bytes:
    """A lossless file of RGBA levels: green taken off red and blue, pixels predicted by one mode, and Huffman codes."""
    h, w = levels.shape[:2]
    if not (0 < w <= 1 << 14 and 0 < h <= 1 << 14):
        raise ValueError("WebP images have sides of 1 to 16384")
    px = np.ascontiguousarray(levels[..., [2, 1, 0, 3]])
    px[..., 0] -= px[..., 1]
    px[..., 2] -= px[..., 1]
    around = np.pad(px.astype(np.int16), ((1, 0), (1, 0), (0, 0)))
    left, top, corner = around[1:, :-1], around[:-1, 1:], around[:-1, :-1]
    guess = _guess(mode, left, top, top, corner).copy()
    guess[0], guess[:, 0] = left[0], top[:, 0]
    guess[0, 0] = 0, 0, 0, 255
    out = Writer()
    out.put((0x2F, 8), (w - 1, 14), (h - 1, 14), (int((levels[..., 3] < 255).any()), 1), (0, 3), (1, 1), (2, 2), (1, 1), (0, 2), (7, 3))
    block = np.zeros((-(-w >> 9) * -(-h >> 9), 4), np.uint8)
    block[:, 1] = mode
    _write_pixels(out, block)
    out.put((0, 1))
    _write_pixels(out, (px - guess & 255).astype(np.uint8), main=True)
    body = out.bytes()
    part = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(part)) + b"WEBP" + part
