"""Lossless WebP images in binary columns: an encoder, a decoder, and Spark operators over them.

The format is the public WebP lossless bitstream: prefix codes, back-references, colour cache, and the predictor, cross-colour,
subtract-green and palette transforms. Few or large images are decoded one after the other; many small ones abreast, a symbol of each image in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, text_chunks

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD
MAX_SIDE = 1 << 14
#: Neighbour offsets of short distance codes: the nearest first, then the smaller |x|, then the right one.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
_NEAR_CODE = {p: i + 1 for i, p in enumerate(NEAR)}

#: Payload bytes a row of pixels of four samples each, and rows an image; a longer payload goes on in a further image, as images are decoded abreast.
ROW_BYTES, IMAGE_ROWS = 576, 16
#: Images from which on decoding abreast is quicker.
ABREAST = 24


# ---- bits and prefix codes -----------------------------------------------------------------------------------------


class Reader:
    """Bits of a stream, the least significant first."""

    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def bits(self, n: int) -> int:
        at = self.pos
        self.pos += n
        if self.pos > 8 * len(self.data) + 64:
            raise ValueError("the stream ends early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.pos >> 3 : (self.pos >> 3) + 4], "little") >> (self.pos & 7)


class Code:
    """A canonical prefix code, read by a table of its longest length. A lone symbol takes no bits."""

    def __init__(self, lengths: tuple[int, ...]):
        found = np.array(lengths, dtype=np.int64)
        used = np.flatnonzero(found)
        if not len(used):
            used, found = np.array([0]), np.append(found, 0)
        self.lone = int(used[0]) if len(used) == 1 else None
        self.width = 0 if self.lone is not None else int(found.max())
        if self.lone is not None:
            return
        if (1 << self.width) != int(sum(1 << (self.width - int(x)) for x in found[used])):
            raise ValueError("the prefix code isn't complete")
        order = used[np.lexsort((used, found[used]))]
        symbol = np.repeat(order, 1 << (self.width - found[order]))  # by the code's bits from the first on
        flip = np.arange(1 << self.width)
        turned = np.zeros_like(flip)
        for i in range(self.width):
            turned |= ((flip >> i) & 1) << (self.width - 1 - i)
        symbol = symbol[turned]
        self.symbols, self.lengths = symbol.tolist(), found[symbol].tolist()

    def read(self, r: Reader) -> int:
        if self.lone is not None:
            return self.lone
        at = r.peek() & ((1 << self.width) - 1)
        r.pos += self.lengths[at]
        return self.symbols[at]


@lru_cache(256)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


def read_lengths(r: Reader, size: int) -> list[int]:
    """Code lengths of the symbols of a prefix code."""
    lengths = [0] * size
    if r.bits(1):
        two = r.bits(1)
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return lengths
    n = 4 + r.bits(4)
    code = _outer_code(n, r.bits(3 * n))
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else size
    symbols, widths, mask = ([code.lone], [0], 0) if code.lone is not None else (code.symbols, code.lengths, (1 << code.width) - 1)
    data, ahead = r.data, (r.pos >> 3) + 8
    word, have = int.from_bytes(data[ahead - 8 : ahead], "little") >> (r.pos & 7), 64 - (r.pos & 7)
    at, last = 0, 8
    while at < size and left:
        left -= 1
        if have < 16:
            word |= int.from_bytes(data[ahead : ahead + 8], "little") << have
            ahead, have = ahead + 8, have + 64
        k = word & mask
        s, n = symbols[k], widths[k]
        if s < 16:
            lengths[at] = s
            at += 1
            last = s or last
        else:
            extra = 2 if s == 16 else 3 if s == 17 else 7
            run = (word >> n & ((1 << extra) - 1)) + (11 if s == 18 else 3)
            n += extra
            if at + run > size:
                raise ValueError("code lengths run over")
            if s == 16:
                lengths[at : at + run] = [last] * run
            at += run
        word >>= n
        have -= n
    r.pos = 8 * ahead - have
    if r.pos > 8 * len(data):
        raise ValueError("the stream ends early")
    return lengths


@lru_cache(256)
def _outer_code(n: int, bits: int) -> Code:
    """The code of code lengths, from n lengths of three bits each."""
    outer = [0] * 19
    for k in range(n):
        outer[CODE_LENGTH_ORDER[k]] = bits >> 3 * k & 7
    return code_of(tuple(outer))


class Writer:
    """Collects bits of numbers, the least significant first."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def bits(self, value: int, n: int) -> None:
        if n:
            self.parts.append(((value >> np.arange(n)) & 1).astype(np.uint8))

    def joined(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=np.uint8)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance of 1 or more."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def value_of(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + r.bits(n) + 1


# ---- decoding ------------------------------------------------------------------------------------------------------


class Pixels:
    """Entropy-coded pixels in order, read up to where their symbols begin."""

    def __init__(self, r: Reader, width: int, height: int, main: bool):
        self.reader, self.width, self.n = r, width, width * height
        self.cache_bits = r.bits(4) if r.bits(1) else 0
        if self.cache_bits > 11:
            raise ValueError("the colour cache is too large")
        self.tiles, self.bits, self.across = None, 0, 0
        if main and r.bits(1):
            self.bits = r.bits(3) + 2
            self.across = -(-width >> self.bits)
            self.tiles = (Pixels(r, self.across, -(-height >> self.bits), False).decode() >> 8) & 0xFFFF
        n_groups = int(self.tiles.max()) + 1 if self.tiles is not None else 1
        greens = 280 + (1 << self.cache_bits if self.cache_bits else 0)
        self.groups = [[read_lengths(r, size) for size in (greens, 256, 256, 256, 40)] for _ in range(n_groups)]

    def decode(self) -> np.ndarray:
        """All pixels, a symbol at a time."""
        r, n, bits, across, width, cache_bits = self.reader, self.n, self.bits, self.across, self.width, self.cache_bits
        groups = [[code_of(tuple(lengths)) for lengths in g] for g in self.groups]
        green, red, blue, alpha, distance = groups[0]
        pixels, cache = [0] * n, [0] * (1 << cache_bits)
        tiles = self.tiles.tolist() if self.tiles is not None else None
        at, cached = 0, 0
        while at < n:
            if tiles is not None:
                green, red, blue, alpha, distance = groups[tiles[(at // width >> bits) * across + (at % width >> bits)]]
            s = green.read(r)
            if s < 256:
                p = s << 8 | red.read(r) << 16 | blue.read(r)
                pixels[at] = p | alpha.read(r) << 24
                at += 1
            elif s < 280:
                length = value_of(s - 256, r)
                back = _distance(value_of(distance.read(r), r), width)
                if back > at or at + length > n:
                    raise ValueError("a back-reference leaves the image")
                for _ in range(length):
                    pixels[at] = pixels[at - back]
                    at += 1
            else:
                while cached < at:
                    cache[(CACHE_MULTIPLIER * pixels[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[cached]
                    cached += 1
                pixels[at] = cache[s - 280]
                at += 1
            if r.pos > 8 * len(r.data):
                raise ValueError("the stream ends early")
        return np.array(pixels, dtype=np.uint32)


class Image:
    """A WebP lossless file, read up to where the symbols of its pixels begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 26 or data[20] != 0x2F:
            raise ValueError("not a lossless WebP file")
        r = Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
        self.width, self.height = r.bits(14) + 1, r.bits(14) + 1
        r.bits(1)
        if r.bits(3):
            raise ValueError("unknown version")
        self.transforms, seen, columns = [], set(), self.width
        sub = lambda w, h: Pixels(r, w, h, False).decode()
        while r.bits(1):
            kind = r.bits(2)
            if kind in seen:
                raise ValueError("a transform stands twice")
            seen.add(kind)
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits = r.bits(3) + 2
                self.transforms.append((kind, columns, bits, sub(-(-columns >> bits), -(-self.height >> bits))))
            elif kind == PALETTE:
                size = r.bits(8) + 1
                table = np.zeros((size, 4), dtype=np.uint8)
                np.cumsum(sub(size, 1).astype("<u4").view(np.uint8).reshape(size, 4), axis=0, dtype=np.uint8, out=table)
                pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((kind, columns, pack, table.view("<u4").ravel()))
                columns = -(-columns >> pack)
            else:
                self.transforms.append((kind, columns, 0, None))
        self.pixels = Pixels(r, columns, self.height, True)


def decode(data: bytes) -> np.ndarray:
    """One WebP lossless file -> pixels uint32 ARGB (height x width)."""
    found = decode_all([data])[0]
    if isinstance(found, Exception):
        raise found
    return found


def decode_all(files: list[bytes]) -> list[np.ndarray | Exception]:
    """Pixels of each file, or what is wrong with it."""
    found: list = []
    for data in files:
        try:
            found.append(Image(data))
        except (ValueError, IndexError) as e:
            found.append(e)
    images = [i for i in found if isinstance(i, Image)]
    coded = abreast([i.pixels for i in images]) if len(images) >= ABREAST else [_tried(i.pixels.decode) for i in images]
    work = [p if isinstance(p, Exception) else p.reshape(i.height, -1) for i, p in zip(images, coded, strict=True)]
    for k in range(max((len(i.transforms) for i in images), default=0)):  # the last transform of each image, then the one before it, ...
        predicted = []
        for j, (i, p) in enumerate(zip(images, work, strict=True)):
            if k < len(i.transforms) and not isinstance(p, Exception):
                kind, wide, bits, extra = i.transforms[-1 - k]
                if kind == PREDICTOR:
                    predicted.append((j, p, bits, extra))
                else:
                    work[j] = (None, _uncross, _ungreen, _unpalette)[kind](p, wide, bits, extra)
        for (j, *_), p in zip(predicted, unpredict_all([x[1:] for x in predicted]), strict=True):
            work[j] = p
    rest = iter(work)
    return [next(rest) if isinstance(i, Image) else i for i in found]


def _tried(f):
    try:
        return f()
    except (ValueError, IndexError) as e:
        return e


_FLIP = np.zeros(1 << 15, dtype=np.int64)  # 15 bits turned round
for _i in range(15):
    _FLIP |= ((np.arange(1 << 15) >> _i) & 1) << (14 - _i)


def canonical_all(lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of several codes, in the order of owner (0, 1, ...), then of symbols, with their lengths: the order within each code, and each symbol's
    code as it stands in the stream, the first bit lowest. Codes start where the lengths before them end, in units of the longest length."""
    if not len(lengths):  # as where no image has a copy
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths, owner))
    step = (1 << 15) >> lengths[order]
    before = np.cumsum(step) - step
    first = np.flatnonzero(np.append(True, owner[order][1:] != owner[order][:-1]))
    before -= np.repeat(before[first], np.diff(np.append(first, len(order))))
    codes = np.zeros(len(lengths), dtype=np.int64)
    codes[order] = _FLIP[before & 0x7FFF]
    return order, codes


def _lookup(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of all codes one after the other (symbol, and length from bit 16 on), each one's place and mask, and which are valid."""
    size = np.array([len(c) for c in codes])
    flat = np.concatenate([np.array(c, dtype=np.int64) for c in codes])
    owner = np.repeat(np.arange(len(codes)), size)
    symbol = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    used = np.flatnonzero(flat)
    n_used = np.bincount(owner[used], minlength=len(codes))
    width = np.zeros(len(codes), dtype=np.int64)
    np.maximum.at(width, owner[used], flat[used])
    width[n_used <= 1] = 0  # a lone symbol takes no bits; a code without any stands for symbol 0
    filled = np.bincount(owner[used], weights=2.0 ** -flat[used], minlength=len(codes))
    valid = (n_used <= 1) | (filled == 1)
    place = np.cumsum(1 << width) - (1 << width)
    table = np.zeros(int((1 << width).sum()), dtype=np.int64)
    lone = used[(n_used == 1)[owner[used]]]
    table[place[owner[lone]]] = symbol[lone]
    many = used[((n_used > 1) & valid)[owner[used]]]
    if len(many):
        order, _ = canonical_all(flat[many], owner[many])
        many = many[order]
        times = 1 << (width[owner[many]] - flat[many])
        entry = np.repeat(symbol[many] | flat[many] << 16, times)
        codes_of = np.repeat(owner[many], times)
        first = np.flatnonzero(np.append(True, codes_of[1:] != codes_of[:-1]))
        index = np.arange(len(entry)) - np.repeat(first, np.diff(np.append(first, len(entry))))  # the code's bits, the first one highest
        table[place[codes_of] + (_FLIP[index] >> (15 - width[codes_of]))] = entry
    return table, place, (1 << width) - 1, valid


def abreast(images: list[Pixels]) -> list[np.ndarray | Exception]:
    """Pixels of many images: in each step, every image that isn't finished reads one symbol (of a literal, all four)."""
    n = np.array([p.n for p in images])
    out_at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), dtype=np.int64)
    sizes = np.array([len(p.reader.data) + 32 for p in images])
    data_at = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(p.reader.data + bytes(32) for p in images) + bytes(8), dtype=np.uint8).astype(np.int64)
    four = buf[:-3] | buf[1:-2] << 8 | buf[2:-1] << 16 | buf[3:] << 24  # 32 bits from each byte on
    first_group = np.cumsum([0] + [len(p.groups) for p in images])
    table, place, mask, valid = _lookup([c for p in images for g in p.groups for c in g])
    cache_bits = np.array([p.cache_bits for p in images])
    cache_at = np.cumsum(1 << cache_bits) - (1 << cache_bits)
    cache = np.zeros(int((1 << cache_bits).sum()), dtype=np.int64)
    some_cached, some_tiled = bool(cache_bits.any()), any(p.tiles is not None for p in images)
    if some_tiled:
        tile_sizes = np.array([len(p.tiles) if p.tiles is not None else 1 for p in images])
        tile_at = np.cumsum(tile_sizes) - tile_sizes
        tiles = np.concatenate([p.tiles.astype(np.int64) if p.tiles is not None else np.zeros(1, dtype=np.int64) for p in images])
        width, across, tile_bits = (np.array([v(p) for p in images]) for v in (lambda p: p.width if p.tiles is not None else 1 << 40, lambda p: p.across, lambda p: p.bits if p.tiles is not None else 62))
    wrong: dict[int, Exception] = {}
    for k, p in enumerate(images):
        if not valid[5 * first_group[k] : 5 * first_group[k + 1]].all():
            wrong[k] = ValueError("the prefix code isn't complete")
    live = np.array([k for k in range(len(images)) if k not in wrong], dtype=np.int64)
    pos = data_at * 8 + np.array([p.reader.pos for p in images])
    end = data_at * 8 + np.array([8 * len(p.reader.data) for p in images])

    def start() -> tuple:
        """What the live images look symbols up with, and where their cached colours stand."""
        code = 5 * first_group[live]
        return code, cache_at[live], 32 - cache_bits[live], *((place[code + c], mask[code + c]) for c in range(4))

    def copy(k: int, pos_k: int, at_k: int, s: int, code: int) -> tuple[int, int]:
        """A back-reference of image k: the places in its stream and its pixels after it."""

        def bits(m: int) -> int:
            nonlocal pos_k
            v = int(four[pos_k >> 3]) >> (pos_k & 7) & ((1 << m) - 1)
            pos_k += m
            return v

        def value(symbol: int) -> int:
            if symbol < 4:
                return symbol + 1
            m = (symbol - 2) >> 1
            return ((2 + (symbol & 1)) << m) + bits(m) + 1

        length = value(s - 256)
        e = int(table[place[code + 4] + (int(four[pos_k >> 3]) >> (pos_k & 7) & int(mask[code + 4]))])
        pos_k += e >> 16
        back = _distance(value(e & 0xFFFF), images[k].width)
        if back > at_k or at_k + length > n[k]:
            raise ValueError("a back-reference leaves the image")
        a = int(out_at[k]) + at_k
        new = out[a - back : a - back + length] if back >= length else np.resize(out[a - back : a], length)
        out[a : a + length] = new
        if cache_bits[k]:
            cache[cache_at[k] + ((CACHE_MULTIPLIER * new & 0xFFFFFFFF) >> (32 - cache_bits[k]))] = new  # the last of equal places stays
        return pos_k, at_k + length

    at = np.zeros(len(live), dtype=np.int64)
    pos = pos[live]
    code, slots, shift, *channels = start()
    while len(live):
        if some_tiled:
            code = 5 * (first_group[live] + tiles[tile_at[live] + ((at // width[live]) >> tile_bits[live]) * across[live] + ((at % width[live]) >> tile_bits[live])])
            channels = [(place[code + c], mask[code + c]) for c in range(4)]
        e = table[channels[0][0] + (four[pos >> 3] >> (pos & 7) & channels[0][1])]
        s = e & 0xFFFF
        pos += e >> 16
        plain = s < 256
        every = bool(plain.all())
        pixel = s << 8
        for c, by in ((1, 16), (2, 0), (3, 24)):
            e = table[channels[c][0] + (four[pos >> 3] >> (pos & 7) & channels[c][1])]
            if not every:
                e *= plain  # other symbols have no further channels
            pixel |= (e & 0xFFFF) << by
            pos += e >> 16
        here, which = out_at[live] + at, slice(None)
        copies = ()
        if not every:
            hit = np.flatnonzero(s >= 280)
            pixel[hit] = cache[slots[hit] + s[hit] - 280]
            copying = ~plain & (s < 280)
            copies = np.flatnonzero(copying)
            if len(copies):
                which = np.flatnonzero(~copying)
        out[here[which]] = pixel[which]
        if some_cached:
            cached = pixel[which]
            cache[slots[which] + ((CACHE_MULTIPLIER * cached & 0xFFFFFFFF) >> shift[which])] = cached
        at += 1
        for j in copies:
            try:
                pos[j], at[j] = copy(int(live[j]), int(pos[j]), int(at[j]) - 1, int(s[j]), int(code[j]))
            except ValueError as e:
                wrong[int(live[j])] = e
                at[j] = n[live[j]]
        over = pos > end[live]
        stop = over | (at >= n[live])
        if stop.any():
            for k in live[over]:
                wrong.setdefault(int(k), ValueError("the stream ends early"))
            live, pos, at = live[~stop], pos[~stop], at[~stop]
            code, slots, shift, *channels = start()
    return [wrong[k] if k in wrong else out[out_at[k] : out_at[k] + n[k]].astype(np.uint32) for k in range(len(images))]


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _channels(image: np.ndarray) -> np.ndarray:
    return image.astype("<u4")[..., None].view(np.uint8)  # b, g, r, a


def unpredict_all(jobs: list[tuple[np.ndarray, int, np.ndarray]]) -> list[np.ndarray]:
    """Images (residuals, tile bits, modes) with their predictions added; many of them abreast, a pixel of each image in one step."""
    if len(jobs) < ABREAST:
        return [_unpredict(*job) for job in jobs]
    n, width = (np.array([f(j[0]) for j in jobs]) for f in (lambda i: i.size, lambda i: i.shape[1]))
    bits = np.array([j[1] for j in jobs])
    base = np.cumsum(n + width + 1) - n  # zeros before each image, so that neighbours of first pixels are there
    out = np.zeros((int((n + width + 1).sum()), 4), dtype=np.int64)
    for b, (image, _, _) in zip(base, jobs, strict=True):
        out[b : b + image.size] = _channels(image).reshape(-1, 4)
    modes_at = np.cumsum([0] + [len(j[2]) for j in jobs])[:-1]
    modes = np.concatenate([(j[2] >> 8) & 15 for j in jobs]).astype(np.int64)
    live = np.arange(len(jobs))
    half = lambda a, b: (a + b) >> 1
    clamp = lambda v: np.clip(v, 0, 255)
    for t in range(int(n.max())):
        live = live[n[live] > t]
        w, here = width[live], base[live] + t
        x, y = t % w, t // w
        left, top, corner, right = out[here - 1], out[here - w], out[here - w - 1], out[here - w + 1]
        mode = modes[modes_at[live] + (y >> bits[live]) * -(-w >> bits[live]) + (x >> bits[live])]
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
        p = np.zeros_like(left)
        for m in np.unique(mode):
            k = mode == m
            p[k] = predict(int(m), left[k], top[k], corner[k], right[k], half, clamp)
        out[here] = (out[here] + p) & 255
    return [out[b : b + i.size].astype(np.uint8).view("<u4").reshape(i.shape).astype(np.uint32) for b, (i, _, _) in zip(base, jobs, strict=True)]


def _unpredict(image: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width = image.shape
    res = _channels(image).astype(np.int64).tolist()
    across = -(-width >> bits)
    modes = ((modes >> 8) & 15).tolist()
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    for y in range(height):
        row, up = res[y], res[y - 1] if y else None
        for x in range(width):
            if not y:
                p = row[x - 1] if x else [0, 0, 0, 255]
            elif not x:
                p = up[0]
            else:
                left, top, corner = row[x - 1], up[x], up[x - 1]
                right = up[x + 1] if x + 1 < width else row[0]
                p = predict(modes[(y >> bits) * across + (x >> bits)], left, top, corner, right, half, clamp)
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
    return np.array(res, dtype=np.uint8).reshape(height, width, 4).view("<u4")[..., 0].astype(np.uint32)


def predict(mode, left, top, corner, right, half, clamp):
    """The format's predictors 0 to 13 over (b, g, r, a)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        if isinstance(left, list):
            to_left, to_top = (sum(abs(t - c) for t, c in zip(near, corner, strict=True)) for near in (top, left))
            return left if to_left < to_top else top
        return np.where((np.abs(top - corner).sum(-1) < np.abs(left - corner).sum(-1))[..., None], left, top)
    if mode == 12:
        return [clamp(a + t - c) for a, t, c in zip(left, top, corner, strict=True)] if isinstance(left, list) else clamp(left + top - corner)
    if mode == 13:
        mid = half(left, top)
        if isinstance(left, list):
            return [clamp(m + int((m - c) / 2)) for m, c in zip(mid, corner, strict=True)]
        return clamp(mid + np.trunc((mid - corner) / 2).astype(np.int64))
    return [0, 0, 0, 255]


def _multipliers(extra: np.ndarray, shape: tuple[int, int], bits: int) -> list[np.ndarray]:
    height, width = shape
    tiles = extra.reshape(-(-height >> bits), -(-width >> bits))
    full = np.repeat(np.repeat(tiles, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    return [((full >> s) & 255).astype(np.uint8).view(np.int8).astype(np.int64) for s in (0, 8, 16)]  # green to red, green to blue, red to blue


def _uncross(image: np.ndarray, width: int, bits: int, extra: np.ndarray, sign: int = 1) -> np.ndarray:
    c = _channels(image)
    to_red, to_blue, red_to_blue = _multipliers(extra, image.shape, bits)
    signed = lambda a: a.astype(np.uint8).view(np.int8).astype(np.int64)
    green, old_red = signed(c[..., 1].copy()), c[..., 2].astype(np.int64)
    red = (old_red + sign * ((to_red * green) >> 5)) & 255
    source = signed(red) if sign > 0 else signed(old_red)
    blue = (c[..., 0].astype(np.int64) + sign * ((to_blue * green) >> 5) + sign * ((red_to_blue * source) >> 5)) & 255
    return (image & np.uint32(0xFF00FF00)) | (red << 16).astype(np.uint32) | blue.astype(np.uint32)


def _ungreen(image: np.ndarray, width: int, bits: int, extra: None, sign: int = 1) -> np.ndarray:
    g = ((image >> 8) & 255).astype(np.int64)
    red, blue = (((image >> 16) & 255) + sign * g) & 255, ((image & 255) + sign * g) & 255
    return (image & np.uint32(0xFF00FF00)) | (red << 16).astype(np.uint32) | blue.astype(np.uint32)


def _unpalette(image: np.ndarray, width: int, pack: int, table: np.ndarray) -> np.ndarray:
    index = (image >> 8) & 255
    if pack:
        each = 8 >> pack
        index = ((index[:, :, None] >> (each * np.arange(1 << pack))) & ((1 << each) - 1)).reshape(len(image), -1)[:, :width]
    full = np.zeros(256, dtype=np.uint32)
    full[: len(table)] = table
    return full[index]


# ---- many payloads at once -----------------------------------------------------------------------------------------

#: Code lengths of code lengths in payload images: fixed, so that nothing about them has to be counted. Symbols 15 and 16 aren't used.
_OUTER = {5: 3, 6: 3, 7: 3, 8: 3, 17: 3, 0: 4, 4: 4, 9: 4, 18: 4, 3: 5, 10: 5, 2: 6, 11: 6, 1: 7, 12: 7, 13: 7, 14: 7}
_LONGEST = 14
#: Pixels a copy has at least, and those of the window by which copies are found.
_MIN_COPY, _PROBE = 4, 3
#: Bits of the colour cache that payload images may have.
_CACHE_BITS = 8
#: Predictors that payload images may have (left, top, and the one of both that the corner favours), and bits of a tile's side.
_MODES, _TILE_BITS = (1, 2, 11), 4


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that symbols with these counts (a row an image) take, and what a used symbol costs in the code's header."""
    total = counts.sum(axis=1)
    c = np.maximum(counts, 1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(c)).sum(axis=1) + 4.5 * (counts > 0).sum(axis=1)


def _histogram(values: np.ndarray, owner: np.ndarray, images: int, size: int = 256) -> np.ndarray:
    return np.bincount(owner * size + values, minlength=images * size).reshape(images, size)


def _literal_bits(px: np.ndarray, owner: np.ndarray, images: int) -> np.ndarray:
    c = _channels(px).reshape(-1, 4)
    return sum(_entropy(_histogram(c[:, j], owner, images)) for j in range(4))


def _residuals(px: np.ndarray, at: np.ndarray, first: np.ndarray, mode: int, width: int) -> np.ndarray:
    """Pixels in some places of images, which stand one after the other, less their predictions by one mode; first: the place of each in its image."""
    c = _channels(px).reshape(-1, 4)
    beside = lambda k: c[np.maximum(at - k, 0)]
    left, top = beside(1), beside(width)
    if mode == 11:
        corner = beside(width + 1).astype(np.int16)
        p = predict(mode, left.astype(np.int16), top.astype(np.int16), corner, None, None, None).astype(np.uint8)
    else:
        p = (left if mode == 1 else top).copy()
    p[first < width] = left[first < width]
    edge = (first % width == 0) & (first > 0)
    p[edge] = top[edge]
    p[first == 0] = (0, 0, 0, 255)
    return (c[at] - p).view("<u4").ravel().astype(np.uint32)  # bytes wrap round


def _cross_multipliers(px: np.ndarray, owner: np.ndarray, images: int) -> np.ndarray:
    """The multipliers (green to red, green to blue, red to blue, packed) that leave the least squares in each image."""
    b, g, r = (((px >> np.uint32(s)).astype(np.uint8).view(np.int8).astype(np.float64)) for s in (0, 8, 16))
    total = lambda v: np.bincount(owner, weights=v, minlength=images)
    fit = lambda v, of: np.clip(np.round(32 * total(v * of) / np.maximum(total(of * of), 1)), -128, 127).astype(np.int64) & 255
    return fit(r, g) | fit(b, g) << 8 | fit(b, r) << 16


def _transformed(px: np.ndarray, owner: np.ndarray, first: np.ndarray, heights: np.ndarray, width: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """For each image the pixels under the transforms that promise the least bits, and these transforms' bits in the stream.

    Candidates for every image: none, subtract-green, each predictor, and cross-colour; and these on top of the best predictor. Sizes are estimated from every fourth row, or
    from all rows of a lower image; what is chosen is then done to the whole one.
    """
    k = len(heights)
    tried = np.flatnonzero((heights[owner] < 4) | (first // width % 4 == 1))
    some, place = owner[tried], first[tried]
    scale = heights / np.maximum(np.bincount(some, minlength=k) / width, 1)
    size = lambda candidate: scale * _literal_bits(candidate, some, k)
    base = px[tried]
    bits, plan = size(base), np.zeros((k, 2), dtype=np.int64)

    def offer(candidate: np.ndarray, step: int, choice: int) -> np.ndarray:
        """Which images choose it, so far."""
        nonlocal bits
        new = size(candidate) + 8 * 24  # the transform's own image takes some bytes
        better = new < bits
        plan[better, step] = choice
        bits = np.where(better, new, bits)
        return better

    for mode in _MODES:
        near = _residuals(px, tried, place, mode, width)
        better = offer(near, 0, mode)[some]
        base[better] = near[better]
    offer(_ungreen(base[None], width, 0, None, -1)[0], 1, 1)
    packed = _cross_multipliers(base, some, k)
    offer(_crossed(base, packed[some]), 1, 2)
    best = px.copy()
    for mode in _MODES:
        at = np.flatnonzero((plan[:, 0] == mode)[owner])
        best[at] = _residuals(px, at, first[at], mode, width)
    green, crossing = (np.flatnonzero((plan[:, 1] == step)[owner]) for step in (1, 2))
    best[green] = _ungreen(best[green][None], width, 0, None, -1)[0]
    best[crossing] = _crossed(best[crossing], packed[owner[crossing]])
    heads = [[_predictor_bits(int(m))] * bool(m) + ([_green_bits()] if s == 1 else [_cross_bits(int(packed[i]))] if s == 2 else []) for i, (m, s) in enumerate(plan)]
    return best, heads


def _crossed(px: np.ndarray, packed: np.ndarray) -> np.ndarray:
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    to_red, to_blue, red_to_blue = (signed(packed >> s) for s in (0, 8, 16))
    v = px.astype(np.int64)
    green, red = signed(v >> 8), signed(v >> 16)
    new_red = ((v >> 16) - ((to_red * green) >> 5)) & 255
    new_blue = (v - ((to_blue * green) >> 5) - ((red_to_blue * red) >> 5)) & 255
    return (px & np.uint32(0xFF00FF00)) | (new_red << 16 | new_blue).astype(np.uint32)


def _sub_image(w: Writer, value: int) -> None:
    """An image for a transform in which all tiles are alike."""
    w.bits(_TILE_BITS - 2, 3)
    w.bits(0, 1)  # no colour cache
    for lone in ((value >> 8) & 255, (value >> 16) & 255, value & 255, value >> 24, 0):  # codes of one symbol, which take no bits in the image
        w.bits(1, 1), w.bits(0, 1), w.bits(1, 1), w.bits(lone, 8)


@lru_cache(16)
def _predictor_bits(mode: int) -> np.ndarray:
    w = Writer()
    w.bits(1, 1), w.bits(PREDICTOR, 2)
    _sub_image(w, mode << 8 | 0xFF000000)
    return w.joined()


def _cross_bits(packed: int) -> np.ndarray:
    w = Writer()
    w.bits(1, 1), w.bits(CROSS_COLOUR, 2)
    _sub_image(w, packed | 0xFF000000)
    return w.joined()


@lru_cache(1)
def _green_bits() -> np.ndarray:
    w = Writer()
    w.bits(1, 1), w.bits(SUBTRACT_GREEN, 2)
    return w.joined()


def _copies(px: np.ndarray, owner: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, how far back) of stretches that stood before in the same image, from the first on. Places are over all images."""
    n = len(px)
    if n < _PROBE:
        return []
    m = n - _PROBE + 1
    key = owner[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(_PROBE):
        key = (key ^ px[j : j + m]) * np.uint64(0xD1342543DE82EF95)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, earlier = order[1:][same], order[:-1][same]
    ok = (owner[later] == owner[earlier]) & (owner[later] == owner[np.minimum(later + _MIN_COPY - 1, n - 1)]) & (later + _MIN_COPY <= n)
    for j in range(_MIN_COPY):
        ok &= px[np.minimum(later + j, n - 1)] == px[np.minimum(earlier + j, n - 1)]
    later, earlier = later[ok], earlier[ok]
    by_place = np.argsort(later)
    found, done = [], 0
    ends = start[1:]
    for at, before in zip(later[by_place].tolist(), earlier[by_place].tolist(), strict=True):
        if at < done:
            continue
        end = min(int(ends[owner[at]]), at + 4096)
        differs = np.flatnonzero(px[at:end] != px[before : before + end - at])
        length = int(differs[0]) if len(differs) else end - at
        found.append((at, length, at - before))
        done = at + length
    return found


def _lengths(counts: list[int]) -> list[int]:
    """Code lengths, at most _LONGEST, of symbols with these counts in rising order (two at least): Huffman's tree by two queues."""
    n = len(counts)
    weight, parent = list(counts), [0] * (2 * n - 1)
    a, b = 0, n
    for node in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if a < n and (b >= node or weight[a] <= weight[b]):
                k, a = a, a + 1
            else:
                k, b = b, b + 1
            total += weight[k]
            parent[k] = node
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    if max(depth[:n]) > _LONGEST:
        return _lengths([c + max(1, counts[-1] >> 11) for c in counts])
    return depth[:n]


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Code lengths for each row of counts; a row with one symbol has length 1 there."""
    rows, symbols = np.nonzero(counts)
    found = np.zeros(counts.shape, dtype=np.int64)
    times = counts[rows, symbols]
    order = np.lexsort((times, rows))
    times, edge = times[order].tolist(), np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(counts))))).tolist()
    flat: list[int] = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        flat += _lengths(times[a:b]) if b - a > 1 else [1] * (b - a)
    found[rows[order], symbols[order]] = flat
    return found


@lru_cache(1)
def _outer_codes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How a code of payload images begins, and values and lengths of the symbols of its code lengths."""
    lengths = np.zeros(19, dtype=np.int64)
    for symbol, n in _OUTER.items():
        lengths[symbol] = n
    used = np.flatnonzero(lengths)
    codes = np.zeros(19, dtype=np.int64)
    codes[used] = canonical_all(lengths[used], np.zeros(len(used), dtype=np.int64))[1]
    w = Writer()
    w.bits(0, 1), w.bits(15, 4)
    for s in CODE_LENGTH_ORDER:
        w.bits(int(lengths[s]), 3)
    w.bits(0, 1)
    return w.joined().astype(np.int64), codes, lengths


def _code_fields(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of code lengths -> (row, value, number of bits) of the fields that say them: zeros in runs, all others one by one."""
    rows, size = lengths.shape
    head, codes, widths = _outer_codes()
    used = (lengths > 0).sum(axis=1)
    lone = used <= 1
    symbol = np.where(used == 1, lengths.argmax(axis=1), 0)
    simple = np.flatnonzero(lone & (symbol < 256))
    full = np.flatnonzero(~(lone & (symbol < 256)))
    part = lengths[full]
    zero = part == 0
    flat = zero.ravel()
    edge = np.flatnonzero(np.append(True, (flat[1:] != flat[:-1]) | (np.arange(1, flat.size) % size == 0))) if flat.size else np.zeros(0, dtype=np.int64)
    run = np.diff(np.append(edge, flat.size))
    runs, run_at = run[flat[edge]], edge[flat[edge]]
    one = np.flatnonzero(~flat)
    values, bits, place = [codes[part.ravel()[one]]], [widths[part.ravel()[one]]], [one]
    at, left = run_at, runs
    while len(left):  # at most a few times: a run is no longer than the alphabet
        n = np.where(left >= 11, np.minimum(left, 138), np.where(left >= 3, np.minimum(left, 10), 1))
        which = np.where(n >= 11, 18, np.where(n >= 3, 17, 0))
        extra, extra_bits = np.where(n >= 11, n - 11, np.where(n >= 3, n - 3, 0)), np.where(n >= 11, 7, np.where(n >= 3, 3, 0))
        values.append(codes[which] | extra << widths[which])
        bits.append(widths[which] + extra_bits)
        place.append(at)
        at, left = at + n, left - n
        at, left = at[left > 0], left[left > 0]
    value, bit, where = np.concatenate(values), np.concatenate(bits), np.concatenate(place)
    order = np.argsort(where, kind="stable")
    row = full[where[order] // size]
    heads = np.repeat(full, len(head))
    row = np.concatenate((simple, heads, row))
    value = np.concatenate((1 | 1 << 2 | symbol[simple] << 3, np.tile(head, len(full)), value[order]))
    bit = np.concatenate((np.full(len(simple), 11), np.ones(len(heads), dtype=np.int64), bit[order]))
    order = np.argsort(row, kind="stable")
    return row[order], value[order], bit[order]


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.array([prefix_of(int(v)) for v in values], dtype=np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """Each payload (IMAGE_ROWS rows of ROW_BYTES at most) as a WebP lossless file: four bytes a pixel, in the order blue, green, red, alpha.

    Each image gets the transforms and the size of colour cache (or none) that promise the least bits, copies of stretches that stood before, and
    Huffman's prefix codes. All images are handled at once; only their codes are made one after the other.
    """
    k, width = len(payloads), ROW_BYTES // 4
    if not k:
        return []
    raw = np.frombuffer(b"".join(payloads), dtype="<u4").astype(np.uint32)
    n = np.array([len(p) // 4 for p in payloads])
    start = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(k), n)
    first = np.arange(len(raw)) - start[owner]
    heights = n // width
    px, heads = _transformed(raw, owner, first, heights, width)
    copies = _copies(px, owner, start)
    token = np.ones(len(px), dtype=bool)  # where a token starts
    literal = np.ones(len(px), dtype=bool)
    for at, length, _ in copies:
        token[at + 1 : at + length] = False
        literal[at : at + length] = False
    slot = ((px.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER)) & np.uint64(0xFFFFFFFF)).astype(np.int64) >> (32 - _CACHE_BITS)
    order = np.argsort(owner * (1 << _CACHE_BITS) + slot, kind="stable")
    hit = np.zeros(len(px), dtype=bool)
    hit[order[1:]] = (px[order][1:] == px[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (slot[order][1:] == slot[order][:-1])
    hit &= literal
    channels = [(px >> np.uint32(s)).astype(np.int64) & 255 for s in (8, 16, 0, 24)]  # in the order of the stream
    size = 280 + (1 << _CACHE_BITS)

    counted = lambda which: [_histogram(c[which], owner[which], k) for c in channels]
    green, *rest = counted(literal)
    without = [np.pad(green, ((0, 0), (0, size - 256))), *rest]
    green, *rest = counted(hit)
    slots = _histogram(slot[hit], owner[hit], k, 1 << _CACHE_BITS)
    with_cache = [without[0] - np.pad(green, ((0, 0), (0, size - 256))), *(a - b for a, b in zip(without[1:], rest, strict=True))]
    with_cache[0][:, 280:] += slots
    use_cache = sum(map(_entropy, with_cache)) + 5 < sum(map(_entropy, without))
    counts = [np.where(use_cache[:, None], a, b) for a, b in zip(with_cache, without, strict=True)]
    hit &= use_cache[owner]
    at, length, back = (np.array(x, dtype=np.int64) for x in (zip(*copies, strict=True) if copies else ((), (), ())))
    l_symbol, l_extra, l_bits = _prefixes(length)
    near = np.array([_NEAR_CODE.get((int(b % width), int(b // width))) or _NEAR_CODE.get((int(b % width) - width, int(b // width) + 1)) or int(b) + 120 for b in back], dtype=np.int64)
    d_symbol, d_extra, d_bits = _prefixes(near)
    np.add.at(counts[0], (owner[at], 256 + l_symbol), 1)
    counts.append(_histogram(d_symbol, owner[at], k, 40))
    lengths = [_code_lengths(c) for c in counts]
    values = []
    for x in lengths:  # codes of all symbols; a lone one takes no bits
        used = np.flatnonzero(x.ravel())
        code = np.zeros(x.size, dtype=np.int64)
        code[used] = canonical_all(x.ravel()[used], used // x.shape[1])[1]
        values.append(code.reshape(x.shape))
    taken = [np.where((x > 0).sum(axis=1, keepdims=True) > 1, x, 0) for x in lengths]
    # the fields of a token as one number: a literal's channels; a cached colour; or length, its extra bits, distance, its extra bits: 60 bits at most
    packed = [(v | t << 16).ravel() for v, t in zip(values, taken, strict=True)]
    widths = [x.shape[1] for x in lengths]
    where = np.flatnonzero(token)
    own = owner[where]
    field, bits = np.zeros(len(where), dtype=np.int64), np.zeros(len(where), dtype=np.int64)

    def joined(fields: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        value, n = fields[0]
        for v, m in fields[1:]:
            value, n = value | v << n, n + m
        return value, n

    def coded(c: int, image: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = packed[c][image * widths[c] + symbol]
        return e & 0xFFFF, e >> 16

    plain, cached = np.flatnonzero((literal & ~hit)[where]), np.flatnonzero(hit[where])
    place, image = where[plain], own[plain]
    field[plain], bits[plain] = joined([coded(c, image, channels[c][place]) for c in range(4)])
    field[cached], bits[cached] = coded(0, own[cached], 280 + slot[where[cached]])
    if len(at):
        t, o = np.searchsorted(where, at), owner[at]
        field[t], bits[t] = joined([coded(0, o, 256 + l_symbol), (l_extra, l_bits), coded(4, o, d_symbol), (d_extra, d_bits)])
    # what comes before the tokens of each image
    sections: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # image, value, bits; in the order of the stream
    everyone = np.arange(k)
    transparent = np.bincount(owner, weights=(raw >> 24 != 255), minlength=k) > 0
    sections.append((everyone, np.full(k, 0x2F), np.full(k, 8)))
    sections.append((everyone, (width - 1) | (heights - 1) << 14 | transparent.astype(np.int64) << 28, np.full(k, 32)))
    extra = [(i, b) for i, parts in enumerate(heads) for b in parts]
    if extra:
        sections.append((np.concatenate([np.full(len(b), i) for i, b in extra]), np.concatenate([b for _, b in extra]).astype(np.int64), np.ones(sum(len(b) for _, b in extra), dtype=np.int64)))
    # no more transforms; the colour cache, if any; one group of codes
    sections.append((everyone, np.where(use_cache, 1 << 1 | _CACHE_BITS << 2, 0), np.where(use_cache, 7, 3)))
    for c, x in enumerate(lengths):
        if c == 0:
            narrow, wide = np.flatnonzero(~use_cache), np.flatnonzero(use_cache)
            for rows, part in ((narrow, x[narrow, :280]), (wide, x[wide])):
                row, value, bit = _code_fields(part)
                sections.append((rows[row], value, bit))
        else:
            sections.append(_code_fields(x))
    sections.append((own, field, bits))
    image = np.concatenate([x for x, _, _ in sections])
    order = np.argsort(image, kind="stable")
    order = order[np.concatenate([b for _, _, b in sections])[order] > 0]
    image, value, bit = image[order], np.concatenate([v for _, v, _ in sections])[order].astype(np.uint64), np.concatenate([b for _, _, b in sections])[order]
    # each image starts on a byte
    n_bits = np.bincount(image, weights=bit, minlength=k).astype(np.int64)
    n_bytes = (n_bits + 7) >> 3
    begin = np.cumsum(n_bytes) - n_bytes
    image_first = np.cumsum(n_bits) - n_bits
    place = begin[image] * 8 + np.cumsum(bit) - bit - image_first[image]
    word, within = place >> 6, (place & 63).astype(np.uint64)
    out = np.zeros((int(n_bytes.sum()) >> 3) + 2, dtype="<u8")
    edge = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    out[word[edge]] = np.bitwise_or.reduceat(value << within, edge)
    over = np.flatnonzero((place & 63) + bit > 64)  # one field a word at most goes on in the next one
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - within[over])
    stream = out.tobytes()
    found = []
    for b, size_ in zip(begin.tolist(), n_bytes.tolist(), strict=True):
        body = stream[b : b + size_] + b"\0" * (size_ & 1)
        found.append(b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + size_.to_bytes(4, "little") + body)
    return found


def _grouped(parts: list[bytes], work, most: int = CHUNK_BYTES) -> Iterator:
    """What work(parts) gives, for as many parts at once as most bytes hold: images of a very long text don't stand in memory together."""
    at, size = 0, 0
    for i, x in enumerate(parts):
        if i > at and size + len(x) > most:
            yield from work(parts[at:i])
            at, size = i, 0
        size += len(x)
    yield from work(parts[at:])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload of whole rows as one or more images that stand one after the other."""
    most = ROW_BYTES * IMAGE_ROWS
    cut = [[p[at : at + most] for at in range(0, len(p), most)] for p in payloads]
    images = _grouped([x for parts in cut for x in parts], encode_images)
    return [b"".join(next(images) for _ in parts) for parts in cut]


def decode_payloads(media: list[bytes]) -> list[tuple[bytes, int] | Exception]:
    """Payload and pixel rows of each value of one or more images, or what is wrong with it."""
    cut: list[list[bytes]] = []
    for m in media:
        parts, at = [], 0
        while at < len(m):
            size = 8 + int.from_bytes(m[at + 4 : at + 8], "little")
            parts.append(m[at : at + size])
            at += size
        cut.append(parts)
    images = _grouped([x for parts in cut for x in parts], decode_all)
    found: list = []
    for parts in cut:
        arrays = [next(images) for _ in parts]
        bad = next((a for a in arrays if isinstance(a, Exception)), None if arrays else ValueError("no image"))
        found.append(bad or (b"".join(a.astype("<u4").tobytes() for a in arrays), sum(len(a) for a in arrays)))
    return found


def padded(text: bytes) -> bytes:
    """The text and bytes 255 up to a positive multiple of ROW_BYTES."""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b"\xff")


def features(payload: bytes) -> str:
    """Rows, mean, deviation, distinct values and bits of entropy of the samples, and the mean step between neighbours."""
    px = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(px, minlength=256) / len(px)
    used = share[share > 0]
    step = np.abs(np.diff(px.astype(np.int16))).mean()
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(max(0.0, share @ np.arange(256) ** 2 - mean**2)))
    return f"rows={len(px) // ROW_BYTES} mean={mean:.3f} sd={deviation:.3f} distinct={len(used)} entropy={-(used @ np.log2(used)) + 0.0:.3f} step={step:.3f}"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, media (lossless WebP images of the padded text).

    Null counts as empty; an empty text is one row of padding. A text of over IMAGE_ROWS rows becomes several images in one value; texts may be of any length.
    Equal texts give equal media, wherever they stand. Rows may repeat, ids may be null; no rows give no rows. Other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                media = encode_payloads([padded(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the same with pixels (the decoded samples, blue, green, red and alpha of each pixel, row after row), height, feature, error.

    A null or damaged image gives an error instead of stopping the job, and nulls for the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, media in text_chunks(batch, "media"):
                found = decode_payloads(media)
                good = [None if isinstance(f, Exception) else f for f in found]
                arrays = [
                    pa.array([f and f[0] for f in good], pa.binary()),
                    pa.array([f and f[1] for f in good], pa.int64()),
                    pa.array([f and features(f[0]) for f in good], pa.string()),
                    pa.array([str(f) if isinstance(f, Exception) else None for f in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_bytes", "media")), *arrays], names=["doc_id", "n_bytes", "media", "pixels", "height", "feature", "error"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, pixels binary, height long, feature string, error string")


def digest(read: DataFrame) -> DataFrame:
    """Digests of read_media(), beside its pixel arrays."""
    return read.select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.substring("pixels", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "height", "pixels",
    )
