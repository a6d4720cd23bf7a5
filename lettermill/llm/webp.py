"""Lossless WebP (operator 10): a full decoder, and an encoder for byte payloads.

`decode` reads any VP8L stream: prefix codes, meta prefix groups, back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. `encode_payloads` writes payloads as RGBA pixels with back-references,
and a colour cache and a predictor where they save bytes; `decode_payloads` decodes
many such images in lockstep, one symbol of each image per step, and passes any
other stream to `decode`.
"""
from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import row_blocks, scratch, task, text_bytes

ROW = 64  # payload bytes of an image row: 16 RGBA pixels
MAX_ROWS = 256  # longer payloads become several images
MAX_BITS = 11  # longest code that the encoder gives out
LOCKSTEP_BYTES = 4 << 20
LOCKSTEP = 1024  # images coded together
CACHE_BITS = (4, 7)  # sizes of the colour cache that the encoder tries

# Fixed values of the format: the order in which code-length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD

# Short distance codes: neighbours by distance, then lower rows first, then left before right.
NEIGHBOURS = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0),
)
_REVERSED = np.array([int(f"{i:0{MAX_BITS}b}"[::-1], 2) for i in range(1 << MAX_BITS)])


class Bits:
    """Reads little-endian bit fields."""

    __slots__ = ("data", "pos")

    def __init__(self, data: bytes, pos: int = 0) -> None:
        self.data, self.pos = data, pos

    def peek(self, n: int) -> int:
        p = self.pos
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.pos += n
        return got


class PrefixCode:
    """A canonical code as a table over its longest length."""

    __slots__ = ("longest", "table")

    def __init__(self, lengths: Sequence[int]) -> None:
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if not used:
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.longest, self.table = 0, [(0, used[0][1])]
            return
        self.longest = used[-1][0]
        if sum(1 << (self.longest - n) for n, _ in used) != 1 << self.longest:
            raise ValueError("a prefix code that isn't complete")
        self.table = [(0, 0)] * (1 << self.longest)
        code, last = 0, used[0][0]
        for n, s in used:
            code <<= n - last
            last = n
            step = 1 << n
            back = int(f"{code:0{n}b}"[::-1], 2)
            self.table[back::step] = [(n, s)] * len(range(back, len(self.table), step))
            code += 1

    def read(self, bits: Bits) -> int:
        n, s = self.table[bits.peek(self.longest)] if self.longest else self.table[0]
        bits.pos += n
        return s


_inner_code = functools.lru_cache(16)(PrefixCode)  # codes of code lengths: most streams share one


def read_lengths(bits: Bits, alphabet: int) -> list[int]:
    """Code lengths of one prefix code."""
    out = [0] * alphabet
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        out[first] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    inner = [0] * 19
    for k in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[k]] = bits.read(3)
    code = _inner_code(tuple(inner))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, longest = code.table, code.longest
    mask, data, pos = (1 << longest) - 1, bits.data, bits.pos
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        window = int.from_bytes(data[pos >> 3 : (pos >> 3) + 4], "little") >> (pos & 7)
        n, s = table[window & mask]
        pos += n
        window >>= n
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
            continue
        wide, base = ((2, 3), (3, 3), (7, 11))[s - 16]
        repeat = base + (window & ((1 << wide) - 1))
        pos += wide
        if at + repeat > alphabet:
            raise ValueError("code lengths run over the alphabet")
        if s == 16:
            out[at : at + repeat] = [last] * repeat
        at += repeat
    bits.pos = pos
    return out


def _sub(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _spread(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, top: bool) -> list[int]:
    """ARGB values of one entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    block, groups_at, tile, groups = 0, None, 0, 1
    if top and bits.read(1):
        tile = bits.read(3) + 2
        block = _sub(width, tile)
        groups_at = [p >> 8 & 0xFFFF for p in _pixels(bits, block, _sub(height, tile), False)]
        groups = max(groups_at) + 1
    sizes = (256 + 24 + len(cache), 256, 256, 256, 40)
    codes = [[PrefixCode(read_lengths(bits, n)) for n in sizes] for _ in range(groups)]
    total, out, shift = width * height, [], 32 - cache_bits
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, far = codes[groups_at[(at // width >> tile) * block + (at % width >> tile)] if groups_at else 0]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            new = [a << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            n = _spread(bits, s - 256)
            d = _spread(bits, far.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = NEIGHBOURS[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference out of the image")
            new = (out[at - d : at - d + n] * (n // d + 1))[:n]
        else:
            new = [cache[s - 280]]
        out += new
        if cache:
            for p in new:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
    return out


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _each(f, *args: int) -> int:
    """f on each channel."""
    out = 0
    for shift in (0, 8, 16, 24):
        out |= f(*(x >> shift & 255 for x in args)) << shift
    return out


def _mean(a: int, b: int) -> int:
    return _each(lambda x, y: (x + y) >> 1, a, b)


def _clamp(x: int) -> int:
    return 0 if x < 0 else min(x, 255)


def _select(left: int, up: int, corner: int) -> int:
    """Whichever of left and up is nearer to left + up - corner."""
    to_left = to_up = 0
    for shift in (0, 8, 16, 24):
        p, q, c = (x >> shift & 255 for x in (left, up, corner))
        to_left += abs(q - c)
        to_up += abs(p - c)
    return left if to_left < to_up else up


# By mode number: the prediction from left, up, up-right and up-left.
_PREDICTORS = (
    lambda L, T, TR, TL: 0xFF000000,
    lambda L, T, TR, TL: L,
    lambda L, T, TR, TL: T,
    lambda L, T, TR, TL: TR,
    lambda L, T, TR, TL: TL,
    lambda L, T, TR, TL: _mean(_mean(L, TR), T),
    lambda L, T, TR, TL: _mean(L, TL),
    lambda L, T, TR, TL: _mean(L, T),
    lambda L, T, TR, TL: _mean(TL, T),
    lambda L, T, TR, TL: _mean(T, TR),
    lambda L, T, TR, TL: _mean(_mean(L, TL), _mean(T, TR)),
    lambda L, T, TR, TL: _select(L, T, TL),
    lambda L, T, TR, TL: _each(lambda a, b, c: _clamp(a + b - c), L, T, TL),
    lambda L, T, TR, TL: _each(lambda m, c: _clamp(m + int((m - c) / 2)), _mean(L, T), TL),
    lambda L, T, TR, TL: 0xFF000000,
    lambda L, T, TR, TL: 0xFF000000,
)


def _unpredict(px: list[int], width: int, height: int, tile: int, modes: list[int]) -> list[int]:
    out: list[int] = []
    block = _sub(width, tile)
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not y:
                guess = out[i - 1] if x else 0xFF000000
            elif not x:
                guess = out[i - width]
            else:
                mode = modes[(y >> tile) * block + (x >> tile)] >> 8 & 15
                guess = _PREDICTORS[mode](out[i - 1], out[i - width], out[i - width + 1], out[i - width - 1])
            out.append(_add(px[i], guess))
    return out


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _uncross(px: list[int], width: int, height: int, tile: int, factors: list[int]) -> list[int]:
    out, block = [], _sub(width, tile)
    for i, p in enumerate(px):
        f = factors[(i // width >> tile) * block + (i % width >> tile)]
        g = _signed(p >> 8 & 255)
        r = (p >> 16) + (_signed(f & 255) * g >> 5) & 255
        b = p + (_signed(f >> 8 & 255) * g >> 5) + (_signed(f >> 16 & 255) * _signed(r) >> 5) & 255
        out.append(p & 0xFF00FF00 | r << 16 | b)
    return out


def _unindex(px: list[int], width: int, height: int, bits: int, palette: list[int]) -> list[int]:
    if not bits:
        return [palette[g] if (g := p >> 8 & 255) < len(palette) else 0 for p in px]
    packed, per, wide = _sub(width, bits), 1 << bits, 8 >> bits
    out = []
    for y in range(height):
        for x in range(width):
            k = px[y * packed + (x >> bits)] >> (8 + (x & (per - 1)) * wide) & ((1 << wide) - 1)
            out.append(palette[k] if k < len(palette) else 0)
    return out


def chunk_of(media: bytes, at: int = 0) -> tuple[bytes, int]:
    """The VP8L data of the RIFF file at `at`, and where the file ends."""
    if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = int.from_bytes(media[at + 16 : at + 20], "little")
    return media[at + 20 : at + 20 + size], at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")


def decode(stream: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and RGBA pixels (height, width, 4) of a VP8L stream."""
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    has_alpha = bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            tile = bits.read(3) + 2
            data = _pixels(bits, _sub(inner, tile), _sub(height, tile), False)
            undo.append((_unpredict if kind == 0 else _uncross, inner, tile, data))
        elif kind == 2:
            undo.append((None, inner, 0, []))
        else:
            n = bits.read(8) + 1
            palette = _pixels(bits, n, 1, False)
            for i in range(1, n):
                palette[i] = _add(palette[i], palette[i - 1])
            tile = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((_unindex, inner, tile, palette))
            inner = _sub(inner, tile)
    px = _pixels(bits, inner, height, True)
    for f, w, tile, data in reversed(undo):
        px = f(px, w, height, tile, data) if f else [p & 0xFF00FF00 | (p & 0x00FF00FF) + (p >> 8 & 255) * 0x10001 & 0x00FF00FF for p in px]
    argb = np.array(px, np.uint32).reshape(height, width)
    out = np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24 if has_alpha else np.full_like(argb, 255)], -1)
    return width, height, out.astype(np.uint8)


def code_lengths(counts: dict[int, int], most: int = MAX_BITS) -> dict[int, int]:
    """Huffman code lengths of at most `most` bits."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    items = sorted((n, s) for s, n in counts.items())
    total, floor, m = sum(counts.values()), 0, len(items)
    while True:
        weight = [n + floor for n, _ in items]
        parent, i, j = [0] * (2 * m - 1), 0, m
        for k in range(m, 2 * m - 1):  # leaves and inner nodes both come in ascending order
            both = 0
            for _ in range(2):
                if i < m and (j == k or weight[i] <= weight[j]):
                    both += weight[i]
                    parent[i] = k
                    i += 1
                else:
                    both += weight[j]
                    parent[j] = k
                    j += 1
            weight.append(both)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:m]) <= most:
            return {s: d for (_, s), d in zip(items, depth[:m], strict=True)}
        floor = 2 * floor + 1 + (total >> 12)


def canonical(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in canonical order, their lengths and bit-reversed codes; symbols come in ascending order."""
    order = np.argsort(lengths, kind="stable")
    lengths = lengths[order]
    span = 1 << MAX_BITS - lengths
    return symbols[order], lengths, _REVERSED[np.cumsum(span) - span]


def lookup(lengths: list[int]) -> np.ndarray:
    """A code as a table over the next MAX_BITS bits: symbol << 4 | length."""
    lengths = np.array(lengths)
    symbols = np.flatnonzero(lengths)
    if len(symbols) == 1:
        return np.full(1 << MAX_BITS, symbols[0] << 4)
    symbols, lengths, _ = canonical(symbols, lengths[symbols])
    whole = np.repeat(symbols << 4 | lengths, 1 << MAX_BITS - lengths)
    if len(whole) != 1 << MAX_BITS:
        raise ValueError("a prefix code that isn't complete")
    return whole[_REVERSED]


#: 16 code-length symbols, each with a code of four bits.
_LENGTH_CODE = {s: int(f"{k:04b}"[::-1], 2) for k, s in enumerate((*range(13), 16, 17, 18))}


def code_bits(lengths: dict[int, int]) -> tuple[int, int]:
    """A prefix code's description as an integer and its number of bits."""
    if len(lengths) == 1:
        return 0b101 | next(iter(lengths)) << 3, 11
    value, n = 12 << 1, 5
    for _ in range(16):
        value |= 4 << n
        n += 3
    tokens, before = [], -1
    for s in sorted(lengths):
        gap = s - before - 1
        while gap:
            if gap >= 11:
                run = min(gap, 138)
                tokens.append((18, run - 11, 7))
            elif gap >= 3:
                run = min(gap, 10)
                tokens.append((17, run - 3, 3))
            else:
                run = 1
                tokens.append((0, 0, 0))
            gap -= run
        tokens.append((lengths[s], 0, 0))
        before = s
    wide = 3 if len(tokens) <= 257 else 4  # the number of tokens has 2 + 2 * wide bits
    value |= (1 | wide << 1 | (len(tokens) - 2) << 4) << n
    n += 6 + 2 * wide
    for s, extra, more in tokens:
        value |= (_LENGTH_CODE[s] | extra << 4) << n
        n += 4 + more
    return value, n


_LITERALS, _GREEN = 256, 280 + (1 << max(CACHE_BITS))  # alphabets, the second with lengths and the largest cache
_MASK = (1 << MAX_BITS) - 1

# A predictor transform of one tile, mode 2 (the pixel above): the lowest bit comes first.
_UP_FIELDS = ((1, 1), (0, 2), (7, 3), (0, 1), (0b101 | 2 << 3, 11), (1, 4), (1, 4), (1, 4), (1, 4))


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def _cost(key: np.ndarray, images: int) -> np.ndarray:
    """Bits of each image's bytes under an ideal code; keys are image * 256 + byte."""
    n = np.bincount(key, minlength=256 * images).reshape(-1, 256)
    total = n.sum(1)
    return total * np.log2(total) - (n * np.log2(np.maximum(n, 1))).sum(1)


def _slots(argb: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Colour cache slots."""
    return ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> (32 - np.asarray(bits)).astype(np.uint64)).astype(np.int64)


def _repeats(argb: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of back-references: disjoint runs that stand earlier in their image."""
    none = np.zeros(0, np.int64)
    if len(argb) < 3:
        return none, none, none
    x = argb.astype(np.uint64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:]
    h = (h + owner[:-2].astype(np.uint64)) * np.uint64(0x165667B19E3779F9)
    order = np.argsort(h, kind="stable")
    before, at = order[:-1], order[1:]
    same = (h[before] == h[at]) & (owner[before] == owner[at + 2])
    for k in range(3):
        same &= argb[before + k] == argb[at + k]
    far = np.zeros(len(argb), np.int64)
    far[at[same]] = at[same] - before[same]
    fresh = far > 0
    fresh[1:] &= (far[1:] != far[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(fresh)
    if not len(start):
        return none, none, none
    n = np.bincount(np.cumsum(fresh)[far > 0] - 1)
    end = np.minimum(start + n + 2, np.append(start[1:], len(argb)))
    keep = end - start >= 3
    return start[keep], (end - start)[keep], far[start[keep]]


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number, of lengths or distances."""
    u = value - 1
    high = np.frexp(np.maximum(u, 1).astype(np.float64))[1].astype(np.int64) - 1
    wide = np.where(u < 4, 0, high - 1)
    return np.where(u < 4, u, 2 * high + (u >> np.maximum(high - 1, 0) & 1)), u & ((1 << wide) - 1), wide


def encode_images(parts: list[bytes]) -> list[bytes]:
    """WebP files of payload parts, each whole rows.

    Each image has the predictor "above" and a colour cache if they save bits by
    an estimate from its own bytes, and a back-reference for every run of three
    pixels or more that stands before. An image's file depends on its bytes alone.
    """
    if not parts:
        return []
    images = len(parts)
    sizes = np.array([len(p) // 4 for p in parts])
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(images), sizes)
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, ROW // 4, 4)
    rest = raw.copy()
    rest[1:] -= raw[:-1]
    top = first // (ROW // 4)
    rest[top, 1:] = raw[top, 1:] - raw[top, :-1]
    rest[top, 0] = raw[top, 0] - np.array([0, 0, 0, 255], np.uint8)
    raw, rest = raw.reshape(-1, 4), rest.reshape(-1, 4)
    at = (owner << 8)[:, None]
    cost = _cost((at | raw).reshape(-1), images)
    other = _cost((at | rest).reshape(-1), images)
    up = other + 80 < cost
    px = np.where(up[owner][:, None], rest, raw).astype(np.int64)
    argb = (px[:, 3] << 24 | px[:, 0] << 16 | px[:, 1] << 8 | px[:, 2]).astype(np.uint32)
    literal_bits = np.minimum(cost, other) / sizes

    start, length, far = _repeats(argb, owner)
    depth = np.zeros(len(argb) + 1, np.int64)
    depth[start] += 1
    np.add.at(depth, start + length, -1)
    free = np.cumsum(depth[:-1]) == 0  # pixels in no back-reference
    cache, saved, hit = np.zeros(images, np.int64), np.zeros(images), np.zeros(len(argb), bool)
    for bits in CACHE_BITS:
        key = owner << bits | _slots(argb, bits)
        order = np.argsort(key, kind="stable")
        own = np.zeros(len(argb), bool)
        own[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        own &= free
        hits = np.bincount(owner[own], minlength=images)
        gain = hits * (literal_bits - bits - 1) - 5 * np.minimum(hits, 1 << bits)
        better = gain > saved
        cache[better], saved[better] = bits, gain[better]
        hit = np.where(better[owner], own, hit)

    is_ref = np.zeros(len(argb), bool)
    is_ref[start] = True
    token = np.flatnonzero(free | is_ref)
    who, is_ref, hit = owner[token], is_ref[token], hit[token]
    literal = ~is_ref & ~hit
    size, size_extra, size_wide = _prefix(length)
    step, step_extra, step_wide = _prefix(far + 120)
    green = px[token, 1]
    green[hit] = 280 + _slots(argb[token[hit]], cache[who[hit]])
    green[is_ref] = 256 + size
    colours = px[token[literal]][:, [0, 2, 3]]
    tables = []
    for alphabet, key in (
        (_GREEN, who * _GREEN + green),
        (_LITERALS, (who[literal][:, None] * _LITERALS + colours).reshape(-1)),
        (40, who[is_ref] * 40 + step),
    ):
        counts = np.bincount(key, minlength=alphabet * images).reshape(images, alphabet)
        tables.append((counts, np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.uint64)))
    heads, head_bits = [], np.zeros(images, np.int64)
    for k, p in enumerate(parts):
        fields = [(0x2F, 8), (ROW // 4 - 1, 14), (len(p) // ROW - 1, 14), (1, 1), (0, 3)]
        fields += _UP_FIELDS if up[k] else ()
        fields += [(0, 1), (1 | int(cache[k]) << 1, 5) if cache[k] else (0, 1), (0, 1)]  # no more transforms, cache, one group
        for (counts, wide, codes), times in zip(tables, (1, 3, 1), strict=True):
            used = np.flatnonzero(counts[k])
            if not len(used):  # no distances: symbol 0 alone
                fields.append((1, 4))
                continue
            lengths = code_lengths(dict(zip(used.tolist(), counts[k][used].tolist(), strict=True)))
            if len(lengths) > 1:
                s, n, code = canonical(used, np.array([lengths[s] for s in used.tolist()]))
                wide[k, s], codes[k, s] = n, code
            fields += [code_bits(lengths)] * times
        value = n = 0
        for v, w in fields:
            value |= v << n
            n += w
        heads.append(value)
        head_bits[k] = n
    n, value = np.zeros((len(token), 4), np.int64), np.zeros((len(token), 4), np.uint64)
    (_, wide, codes), (_, wide_c, codes_c), (_, wide_d, codes_d) = tables
    n[:, 0], value[:, 0] = wide[who, green], codes[who, green]
    n[literal, 1:], value[literal, 1:] = (x[who[literal][:, None], colours] for x in (wide_c, codes_c))
    n[is_ref, 1:] = np.stack([size_wide, wide_d[who[is_ref], step], step_wide], 1)
    value[is_ref, 1:] = np.stack([size_extra.astype(np.uint64), codes_d[who[is_ref], step], step_extra.astype(np.uint64)], 1)
    return _files(heads, head_bits, np.repeat(who, 4), n.reshape(-1), value.reshape(-1))


def _files(heads: list[int], head_bits: np.ndarray, owner: np.ndarray, n: np.ndarray, value: np.ndarray) -> list[bytes]:
    """Files of heads, each followed by its bit fields: widths n and values, in order of their owners."""
    fields = np.bincount(owner, minlength=len(heads))
    first = np.cumsum(fields) - fields
    ends = np.cumsum(n)
    before = ends - n
    body = ends[first + fields - 1] - before[first]
    words = (head_bits + body + 31) // 32 + 1
    base = np.cumsum(words) - words
    at = before - before[first][owner] + head_bits[owner]
    place = base[owner] + (at >> 5)
    value = value << (at & 31).astype(np.uint64)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    summed = np.add.reduceat(value, starts)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    out[place[starts]] += summed & np.uint64(0xFFFFFFFF)
    out[place[starts] + 1] += summed >> np.uint64(32)
    packed = out.astype("<u4").tobytes()
    files = []
    for k, head in enumerate(heads):
        size = int(head_bits[k] + body[k] + 7) // 8
        raw = packed[4 * int(base[k]) : 4 * int(base[k]) + size]
        h = (int(head_bits[k]) + 7) // 8
        raw = (head | int.from_bytes(raw[:h], "little")).to_bytes(h, "little") + raw[h:]
        raw_size = len(raw)
        raw += b"\0" * (raw_size & 1)
        files.append(b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + raw_size.to_bytes(4, "little") + raw)
    return files


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload: one WebP file per 16 KiB."""
    step = ROW * MAX_ROWS
    parts = [p[i : i + step] for p in payloads for i in range(0, len(p), step)]
    files = iter([f for i in range(0, len(parts), LOCKSTEP) for f in encode_images(parts[i : i + LOCKSTEP])])
    return [b"".join([next(files) for _ in range(0, len(p), step)]) for p in payloads]


@dataclass
class Head:
    """What comes before the pixels of a stream that can be decoded in lockstep."""

    width: int
    height: int
    up: bool  # predictor "above"
    cache_bits: int
    codes: list[list[int]]  # code lengths: green, the other channels, distances
    pos: int


def read_head(stream: bytes) -> Head | None:
    """A stream's head, or None if it needs the general decoder."""
    bits = Bits(stream)
    if bits.read(8) != 0x2F:
        return None
    width, height = bits.read(14) + 1, bits.read(14) + 1
    if not bits.read(1) or bits.read(3):  # alpha, version
        return None
    up = bits.read(1)
    if up:
        if bits.read(2):
            return None
        tile = bits.read(3) + 2
        if any(m >> 8 & 15 != 2 for m in _pixels(bits, _sub(width, tile), _sub(height, tile), False)) or bits.read(1):
            return None
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > max(CACHE_BITS) or bits.read(1):
        return None
    green = read_lengths(bits, 280 + (1 << cache_bits if cache_bits else 0))
    at = bits.pos
    colour = read_lengths(bits, 256)
    size = bits.pos - at
    one = Bits(stream, at).peek(size)
    for _ in range(2):
        if bits.peek(size) != one:
            return None
        bits.pos += size
    codes = [green, colour, read_lengths(bits, 40)]
    if max(map(max, codes)) > MAX_BITS:
        return None
    return Head(width, height, bool(up), cache_bits, codes, bits.pos)


def _lockstep(streams: list[bytes], heads: list[Head]) -> list[np.ndarray]:
    """ARGB pixels of each image before transforms are undone: one symbol of every image per step."""
    images = len(heads)
    table = np.zeros((3, images, 1 << MAX_BITS), np.uint16)
    for j, head in enumerate(heads):
        for k, lengths in enumerate(head.codes):
            table[k, j] = lookup(lengths)
    green, colour, steps = table.reshape(3, -1)
    stream_bytes = np.array([len(s) for s in streams])
    pos = 8 * (np.cumsum(stream_bytes) - stream_bytes) + np.array([h.pos for h in heads])
    data = np.frombuffer(b"".join(streams) + bytes(4), np.uint8).astype(np.uint32)
    window = (data[:-2] | data[1:-1] << 8 | data[2:] << 16).astype(np.int64)
    sizes = np.array([h.width * h.height for h in heads])
    base = np.cumsum(sizes) - sizes
    stop, out = base + sizes, np.zeros(int(sizes.sum()), np.uint32)
    at, widths = base.copy(), np.array([h.width for h in heads])
    cache_bits = np.array([h.cache_bits for h in heads])
    most = max(CACHE_BITS)
    cache = np.zeros(images << most, np.uint32)

    def look(codes: np.ndarray, who: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = codes[who << MAX_BITS | window[p >> 3] >> (p & 7) & _MASK].astype(np.int64)
        return entry >> 4, p + (entry & 15)

    def spread(symbol: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.maximum((symbol - 2) >> 1, 0)
        more = window[p >> 3] >> (p & 7) & ((1 << extra) - 1)
        return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + more + 1), p + extra

    live = np.arange(images)
    while len(live):
        s, p = look(green, live, pos[live])
        plain = s < 256
        new = np.zeros(len(live), np.int64)
        who, q = live[plain], p[plain]
        red, q = look(colour, who, q)
        blue, q = look(colour, who, q)
        alpha, q = look(colour, who, q)
        new[plain] = alpha << 24 | red << 16 | s[plain] << 8 | blue
        p[plain] = q
        cached = s >= 280
        if cached.any():
            new[cached] = cache[live[cached] << most | s[cached] - 280]
        pos[live] = p
        ref = np.flatnonzero(~plain & ~cached)
        one = live
        if len(ref):
            who = live[ref]
            n, q = spread(s[ref] - 256, p[ref])
            d, q = look(steps, who, q)
            d, q = spread(d, q)
            pos[who] = q
            near = np.flatnonzero(d <= 120)
            for i in near.tolist():
                x, y = NEIGHBOURS[d[i] - 1]
                d[i] = max(1, x + y * int(widths[who[i]])) + 120
            d -= 120
            if (d > at[who] - base[who]).any() or (at[who] + n > stop[who]).any():
                raise ValueError("a back-reference out of the image")
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            px = out[np.repeat(at[who] - d, n) + k % np.repeat(d, n)]
            out[np.repeat(at[who], n) + k] = px
            lane = np.repeat(who, n)
            cache[lane << most | _slots(px, cache_bits[lane])] = px  # of equal slots the last stays
            at[who] += n
            keep = np.ones(len(live), bool)
            keep[ref] = False
            one, new = live[keep], new[keep]
        px = new.astype(np.uint32)
        out[at[one]] = px
        cache[one << most | _slots(px, cache_bits[one])] = px
        at[one] += 1
        live = live[at[live] < stop[live]]
    return np.split(out, base[1:])


def decode_images(streams: list[bytes]) -> list[np.ndarray]:
    """RGBA bytes of each stream."""
    out: list = [None] * len(streams)
    heads = {}
    for k, s in enumerate(streams):
        if (head := read_head(s)) is not None:
            heads[k] = head
        else:
            out[k] = decode(s)[2].reshape(-1)
    todo = sorted(heads, key=lambda k: -heads[k].width * heads[k].height)
    for i in range(0, len(todo), LOCKSTEP):
        own = todo[i : i + LOCKSTEP]
        for k, argb in zip(own, _lockstep([streams[k] for k in own], [heads[k] for k in own]), strict=True):
            px = argb.astype("<u4").view(np.uint8).reshape(heads[k].height, heads[k].width, 4)[..., [2, 1, 0, 3]]
            if heads[k].up:  # the first row goes by the pixel to the left, all others by the one above
                px[0, 0, 3:] += np.uint8(255)
                px[0] = np.cumsum(px[0], 0, np.uint8)
                px = np.cumsum(px, 0, np.uint8)
            out[k] = px.reshape(-1)
    return out


def decode_payloads(media: list[bytes]) -> list[bytes]:
    streams, owner = [], []
    for k, m in enumerate(media):
        at = 0
        while at < len(m):
            stream, at = chunk_of(m, at)
            streams.append(stream)
            owner.append(k)
    parts: list[list[bytes]] = [[] for _ in media]
    for k, px in zip(owner, decode_images(streams), strict=True):
        parts[k].append(px.tobytes())
    return [b"".join(p) for p in parts]


def feature_of(payload: bytes) -> str:
    """Rows, mean of the bytes in hundredths, distinct bytes, and the commonest byte."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    mean = int(100 * (counts * np.arange(256)).sum()) // len(payload)
    return f"{len(payload) // ROW}:{mean}:{int((counts > 0).sum())}:{int(counts.argmax())}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, rows in row_blocks(batch.column(1), LOCKSTEP_BYTES):
            media = encode_payloads([pad(r) for r in rows])
            n = [len(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        for i, j, rows in row_blocks(batch.column(2), LOCKSTEP_BYTES // 2):
            payloads = decode_payloads(rows)
            cols = [
                pa.array([len(p) for p in payloads], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-ROW:]) for p in payloads], pa.int64()),
                pa.array([len(m) for m in rows], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in rows]),
                pa.array([feature_of(p) for p in payloads]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *cols], names)


def store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes each text's payload as lossless WebP in a binary media column."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), text_bytes(text_col).alias("t"))
    rows.mapInArrow(task(_stored), f"doc_id {kind}, n_bytes long, media binary").write.option("compression", "uncompressed").parquet(folder)


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Decodes a stored media column; digests and a feature of each row's pixels."""
    media = spark.read.parquet(folder)
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(task(_read), schema)


def media_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as lossless WebP and reads them back; one row per input row.

    Null and empty texts are 64 zero bytes; a very long text is one image, in a
    block of its own; repeated rows give equal values; a null id stays null; other
    columns are ignored; an empty table gives no rows.
    """
    folder = scratch(docs.sparkSession, "media")
    store(docs, folder, id_col, text_col)
    return features(docs.sparkSession, folder)
