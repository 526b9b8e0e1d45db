"""A general encoder of lossless WebP images, for tests of the decoder: any predictor, cross-colour, palette, cache and code groups, as asked for."""

import heapq
from collections import Counter
from functools import lru_cache

import numpy as np

from orrery.llm import webp
from orrery.llm.webp import CACHE_MULTIPLIER, CODE_LENGTH_ORDER, CROSS_COLOUR, MAX_SIDE, PALETTE, PREDICTOR, SUBTRACT_GREEN, _channels, _NEAR_CODE, _uncross, _ungreen, predict, prefix_of


class Writer(webp.Writer):
    """Codes go the most significant bit first."""

    def codes(self, values: np.ndarray, n: int) -> None:
        if n and len(values):
            self.parts.append(((values[:, None] >> np.arange(n - 1, -1, -1)) & 1).astype(np.uint8).ravel())


def huffman(weights: dict[int, int], size: int, most: int = 15) -> tuple[int, ...]:
    """Code lengths of at most the given bits; rare symbols' weights are raised until it holds."""
    lengths = [0] * size
    if len(weights) < 2:
        for s in weights:
            lengths[s] = 1
        return tuple(lengths)
    floor = 1
    while True:
        heap = [(max(w, floor), s, (s,)) for s, w in weights.items()]
        heapq.heapify(heap)
        depth = Counter()
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            depth.update(a[2] + b[2])
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                lengths[s] = d
            return tuple(lengths)
        floor *= 2


def canonical(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Symbol -> its code and length; a lone symbol has none."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    found, code, last = {}, 0, 0
    for n, s in used:
        code <<= n - last
        found[s] = (code, n)
        code, last = code + 1, n
    return found


def _write_symbols(w: Writer, codes: dict[int, tuple[int, int]], symbol: int) -> None:
    code, n = codes[symbol]
    w.codes(np.array([code]), n)


@lru_cache(256)
def code_bits(lengths: tuple[int, ...]) -> np.ndarray:
    """How a code stands in the stream."""
    w = Writer()
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (used or [0])[0] < 256:
        s = (used or [0])[0]
        w.bits(1, 1), w.bits(0, 1), w.bits(1, 1), w.bits(s, 8)
        return w.joined()
    tokens: list[tuple[int, int, int]] = []  # symbol, extra value, extra bits
    at = 0
    while at < len(lengths):
        run = 1
        while at + run < len(lengths) and lengths[at + run] == lengths[at]:
            run += 1
        value, at = lengths[at], at + run
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run:
            if value == 0 and run >= 11:
                n = min(run, 138)
                tokens.append((18, n - 11, 7))
            elif value == 0 and run >= 3:
                n = min(run, 10)
                tokens.append((17, n - 3, 3))
            elif value and run >= 3:
                n = min(run, 6)
                tokens.append((16, n - 3, 2))
            else:
                n = 1
                tokens.append((value, 0, 0))
            run -= n
    outer = huffman(Counter(t[0] for t in tokens), 19, 7)
    codes = canonical(outer)
    count = max((k + 1 for k, s in enumerate(CODE_LENGTH_ORDER) if outer[s]), default=4)
    w.bits(0, 1)
    w.bits(max(count, 4) - 4, 4)
    for k in range(max(count, 4)):
        w.bits(outer[CODE_LENGTH_ORDER[k]], 3)
    w.bits(0, 1)
    for s, extra, n in tokens:
        _write_symbols(w, codes, s)
        w.bits(extra, n)
    return w.joined()


def _file(w: Writer, width: int, height: int, alpha: bool) -> bytes:
    head = Writer()
    head.bits(width - 1, 14), head.bits(height - 1, 14), head.bits(int(alpha), 1), head.bits(0, 3)
    body = b"\x2f" + np.packbits(np.concatenate((*head.parts, *w.parts)), bitorder="little").tobytes()
    size = len(body)
    body += b"\0" * (size & 1)
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body


def encode(image: np.ndarray, *, green: bool = False, cross: np.ndarray | None = None, modes: np.ndarray | None = None, tile_bits: int = 3, palette: bool = False, cache_bits: int = 0, meta: np.ndarray | None = None) -> bytes:
    """Pixels uint32 ARGB (height x width) -> a WebP lossless file, with Huffman codes, back-references and the transforms asked for.

    modes: predictor of each tile; cross: multipliers of each tile; meta: number of the code group of each tile.
    """
    height, width = image.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise ValueError("an image has 1 to 16384 pixels a side")
    w = Writer()
    alpha = bool((image >> 24 != 255).any())
    columns = width
    if modes is not None:
        w.bits(1, 1), w.bits(PREDICTOR, 2), w.bits(tile_bits - 2, 3)
        _write_pixels(w, (modes.astype(np.uint32) << 8 | np.uint32(0xFF000000)).ravel(), modes.shape[1], 0, None, False)
        image = _predicted(image, modes, tile_bits)
    if cross is not None:
        w.bits(1, 1), w.bits(CROSS_COLOUR, 2), w.bits(tile_bits - 2, 3)
        _write_pixels(w, cross.astype(np.uint32).ravel(), cross.shape[1], 0, None, False)
        image = _uncross(image, width, tile_bits, cross.astype(np.uint32).ravel(), -1)
    if green:
        w.bits(1, 1), w.bits(SUBTRACT_GREEN, 2)
        image = _ungreen(image, width, 0, None, -1)
    if palette:
        image, columns = _write_palette(w, image)
    w.bits(0, 1)
    _write_pixels(w, image.ravel(), columns, cache_bits, meta, True, tile_bits)
    return _file(w, width, height, alpha)


def _predicted(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = image.shape
    px = _channels(image).astype(np.int64).tolist()
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: 0 if v < 0 else 255 if v > 255 else v
    out = np.zeros((height, width, 4), dtype=np.uint8)
    for y in range(height):
        for x in range(width):
            if not y:
                p = px[y][x - 1] if x else [0, 0, 0, 255]
            elif not x:
                p = px[y - 1][0]
            else:
                right = px[y - 1][x + 1] if x + 1 < width else px[y][0]
                p = predict(int(modes[y >> bits, x >> bits]), px[y][x - 1], px[y - 1][x], px[y - 1][x - 1], right, half, clamp)
            out[y, x] = [(a - b) & 255 for a, b in zip(px[y][x], p, strict=True)]
    return out.view("<u4")[..., 0].astype(np.uint32)


def _write_palette(w: Writer, image: np.ndarray) -> tuple[np.ndarray, int]:
    table, index = np.unique(image, return_inverse=True)
    if len(table) > 256:
        raise ValueError("over 256 colours")
    w.bits(1, 1), w.bits(PALETTE, 2), w.bits(len(table) - 1, 8)
    steps = _channels(table).reshape(-1, 4)
    steps = np.diff(steps, axis=0, prepend=np.zeros((1, 4), dtype=np.uint8)).astype(np.uint8)
    _write_pixels(w, np.ascontiguousarray(steps).view("<u4").ravel().astype(np.uint32), len(table), 0, None, False)
    return _bundled(index.reshape(image.shape), len(table))


def _bundled(index: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
    height, width = index.shape
    columns = -(-width >> pack)
    if pack:
        each = 8 >> pack
        wide = np.zeros((height, columns << pack), dtype=np.int64)
        wide[:, :width] = index
        index = (wide.reshape(height, columns, 1 << pack) << (each * np.arange(1 << pack))).sum(axis=2)
    return index.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000), columns


def _tokens(pixels: list[int], width: int, cache_bits: int) -> list[tuple]:
    """Literals (at, pixel), cached colours (at, None, slot) and copies (at, length, distance code, 0), greedily."""
    out, seen, cache = [], {}, {}
    slot = lambda p: (CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
    at, n = 0, len(pixels)
    while at < n:
        key = tuple(pixels[at : at + 4])
        start = seen.get(key) if len(key) == 4 else None
        length = 0
        if start is not None:
            while length < 4096 and at + length < n and pixels[start + length] == pixels[at + length]:
                length += 1
        if length >= 4 and at - start + 120 <= 1 << 20:
            back = at - start
            y, x = divmod(back, width)
            code = _NEAR_CODE.get((x, y)) or _NEAR_CODE.get((x - width, y + 1)) or back + 120
            out.append((at, length, code, 0))
        else:
            length = 1
            s = slot(pixels[at]) if cache_bits else None
            out.append((at, None, s) if cache_bits and cache.get(s) == pixels[at] else (at, pixels[at]))
        for i in range(at, at + length):
            seen[tuple(pixels[i : i + 4])] = i
            if cache_bits:
                cache[slot(pixels[i])] = pixels[i]
        at += length
    return out


def _write_pixels(w: Writer, pixels: np.ndarray, width: int, cache_bits: int, meta: np.ndarray | None, main: bool, tile_bits: int = 3) -> None:
    w.bits(int(bool(cache_bits)), 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(int(meta is not None), 1)
        if meta is not None:
            w.bits(tile_bits - 2, 3)
            _write_pixels(w, (meta.astype(np.uint32) << 8 | np.uint32(0xFF000000)).ravel(), meta.shape[1], 0, None, False)
    tokens = _tokens(pixels.tolist(), width, cache_bits)
    group = (lambda at: int(meta[at // width >> tile_bits, at % width >> tile_bits])) if meta is not None else (lambda at: 0)
    n_groups = int(meta.max()) + 1 if meta is not None else 1
    counts = [[Counter() for _ in range(5)] for _ in range(n_groups)]
    for t in tokens:
        c = counts[group(t[0])]
        if len(t) == 2:
            for k, s in enumerate((8, 16, 0, 24)):
                c[k][(t[1] >> s) & 255] += 1
        elif len(t) == 3:
            c[0][280 + t[2]] += 1
        else:
            c[0][256 + prefix_of(t[1])[0]] += 1
            c[4][prefix_of(t[2])[0]] += 1
    codes = []
    for c in counts:
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        lengths = [huffman(dict(x), size) for x, size in zip(c, sizes, strict=True)]
        for n in lengths:
            w.parts.append(code_bits(n))
        codes.append([canonical(n) for n in lengths])
    for t in tokens:
        c = codes[group(t[0])]
        if len(t) == 2:
            for k, s in enumerate((8, 16, 0, 24)):
                _write_symbols(w, c[k], (t[1] >> s) & 255)
        elif len(t) == 3:
            _write_symbols(w, c[0], 280 + t[2])
        else:
            for code, value, base in ((c[0], t[1], 256), (c[4], t[2], 0)):
                s, extra, n = prefix_of(value)
                _write_symbols(w, code, base + s)
                w.bits(extra, n)
