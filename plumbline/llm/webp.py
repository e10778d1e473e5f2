"""Media columns: bytes stored as lossless WebP (VP8L) images, and the decoder that reads them back.

The decoder covers the format: prefix codes with meta codes, back-references with the neighbourhood
distance map, the colour cache, and the inverse predictor, cross-colour, subtract-green and palette
transforms.  The encoder stores a payload as 8-bit samples of a grey palette image (a pixel a byte) with
one prefix code a document and a back-reference over the padding; options turn on the other transforms.

Decoding walks many images side by side: one numpy step reads the next symbol of every image.  An image
that meets something other than a plain literal, and the last few long images, go on one by one.

Defined results: null texts are empty, so their payload is 576 bytes of 255; texts over the largest
image become several images one after the other; equal texts give equal bytes; repeated rows repeat;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, slim, texts

UNIT, WIDTH, MAX_SIDE = 576, 576, 16_383
#: Fixed values of the format: the order in which lengths of the code-length code are stored, and transform numbers.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER, OPAQUE = 0x1E35A7BD, 0xFF000000
#: Bits of the longest main code that this encoder makes; images under decoding at a time; images left for one by one.
LONGEST, LANE_BYTES, FEW_LANES = 11, 10_000_000, 8


# ---------------------------------------------------------------- bits and prefix codes


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0
        self.parts: list[bytes] = []

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.n
        self.n += bits
        if self.n >= 512:
            whole = self.n >> 3
            self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def put_array(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        """Many codes at once: each is spread over the four bytes that can hold it, then bytes are added up."""
        at = np.cumsum(lengths, dtype=np.int64)
        total = int(at[-1])
        at = at - lengths + self.n
        held = np.zeros(((self.n + total + 7) >> 3) + 4, np.uint8)
        spread = codes.astype(np.uint64) << (at & 7).astype(np.uint64)
        first = at >> 3
        for k in range(3):
            part = (spread >> np.uint64(8 * k)).astype(np.int64) & 255
            held[: len(held)] += np.bincount(first + k, part, len(held)).astype(np.uint8)
        raw = int.from_bytes(held.tobytes(), "little") | self.value
        self.value, self.n = raw, self.n + total
        whole = self.n >> 3
        self.parts.append((raw & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
        self.value >>= 8 * whole
        self.n -= 8 * whole

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) >> 3, "little")


class BitReader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self) -> int:
        """At least 24 bits from here on, zeros behind the end."""
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 4], "little") >> (self.at & 7)

    def get(self, bits: int) -> int:
        at, k = self.at, self.at >> 3
        self.at = at + bits
        return int.from_bytes(self.data[k : k + 4], "little") >> (at & 7) & ((1 << bits) - 1)


def code_lengths(counts: Sequence[int], longest: int) -> list[int]:
    """Lengths of a prefix code for the counts, none above ``longest``."""
    lengths = [0] * len(counts)
    used = [(c, s) for s, c in enumerate(counts) if c]
    if len(used) == 1:
        lengths[used[0][1]] = 1
    floor = 1
    while len(used) > 1:
        # leaves are numbered from 0, joined nodes from there on; a node's number is above its children's
        heap = [(max(c, floor), k) for k, (c, _) in enumerate(used)]
        heapq.heapify(heap)
        above = [0] * (2 * len(used) - 1)
        for k in range(len(used), len(above)):
            a = heapq.heappop(heap)
            b = heapq.heapreplace(heap, (a[0] + heap[0][0], k))
            above[a[1]] = above[b[1]] = k
        depth = [0] * len(above)
        for k in range(len(above) - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        lengths = [0] * len(counts)
        for k, (_, s) in enumerate(used):
            lengths[s] = depth[k]
        if max(depth) <= longest:
            break
        floor = max(2 * floor, 2 + sum(c for c, _ in used) >> longest)  # rare symbols count as if more frequent
    return lengths


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code with its first bit lowest, length)."""
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - before
        before = n
        out[s] = (_reversed_list(n)[code], n)
        code += 1
    return out


def lookup(lengths: Sequence[int]) -> tuple[np.ndarray, int]:
    """(table, bits): the next ``bits`` bits -> symbol * 16 + length.  A lone symbol takes no bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        raise ValueError("a prefix code without symbols")
    if len(used) == 1:
        return np.array([used[0][1] << 4], np.int32), 0
    used.sort()
    n = np.array([x[0] for x in used])
    bits = int(n[-1])
    spans = 1 << (bits - n)
    if int(spans.sum()) != 1 << bits:
        raise ValueError("a prefix code that is not complete")
    # in order of codes whose first bit is highest, then with the bits of the index reversed
    straight = np.repeat(np.array([(s << 4) | k for k, s in used], np.int32), spans)
    return straight[_reversed(bits)], bits


@lru_cache(maxsize=16)
def _reversed(bits: int) -> np.ndarray:
    index, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for _ in range(bits):
        out, index = out << 1 | index & 1, index >> 1
    return out


@lru_cache(maxsize=16)
def _reversed_list(bits: int) -> list[int]:
    return _reversed(bits).tolist()


def _run_lengths(lengths: Sequence[int]) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra, extra bits), runs of zeros and of repeats joined."""
    out, i, before = [], 0, 8
    end = len(lengths)
    while end and not lengths[end - 1]:
        end -= 1
    while i < len(lengths):
        j = i if i < end else len(lengths)  # behind the last length all are zero
        while j < end and lengths[j] == lengths[i]:
            j += 1
        n, v = j - i, lengths[i]
        i = j
        if v:
            if v != before:
                out.append((v, 0, 0))
                n -= 1
            before = v
            while n >= 3:
                k = min(n, 6)
                out.append((16, k - 3, 2))
                n -= k
        else:
            while n >= 3:
                k = min(n, 138)
                out.append((17, k - 3, 3) if k < 11 else (18, k - 11, 7))
                n -= k
        out += [(v, 0, 0)] * n
    return out


def write_code(out: BitWriter, counts: Sequence[int], longest: int = 15) -> dict[int, tuple[int, int]]:
    """Write a prefix code for the counts; symbol -> (code, length), with length 0 for a lone symbol."""
    used = [s for s, c in enumerate(counts) if c] if any(counts) else []
    if len(used) <= 2 and all(s < 256 for s in used):
        if len(used) < 2:
            write_lone(out, used[0] if used else 0)
            return {used[0] if used else 0: (0, 0)}
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(int(used[0] > 1), 1)
        out.put(used[0], 8 if used[0] > 1 else 1)
        out.put(used[1], 8)
        return {used[0]: (0, 1), used[1]: (1, 1)}
    lengths = code_lengths(counts, longest)
    runs = _run_lengths(lengths)
    tally = [0] * 19
    for s, _, _ in runs:
        tally[s] += 1
    short = code_lengths(tally, 7)
    codes = canonical(short)
    if len(codes) == 1:
        codes = {s: (0, 0) for s in codes}
    stored = max(i for i, s in enumerate(LENGTH_ORDER) if short[s]) + 1
    stored = max(stored, 4)
    out.put(0, 1)
    out.put(stored - 4, 4)
    for s in LENGTH_ORDER[:stored]:
        out.put(short[s], 3)
    out.put(0, 1)  # all symbols are listed
    for s, extra, bits in runs:
        out.put(*codes[s])
        if bits:
            out.put(extra, bits)
    if len(used) == 1:
        return {used[0]: (0, 0)}
    return canonical(lengths)


def write_lone(out: BitWriter, symbol: int) -> None:
    """A prefix code of one symbol below 256, which then takes no bits."""
    out.put(1 | int(symbol > 1) << 2, 3)
    out.put(symbol, 8 if symbol > 1 else 1)


def read_code(bits: BitReader, symbols: int) -> tuple[np.ndarray, int]:
    lengths = [0] * symbols
    if bits.get(1):
        two, wide = bits.get(1), bits.get(1)
        first = bits.get(8 if wide else 1)
        if not two:
            return np.array([first << 4], np.int32), 0
        lengths[first] = lengths[bits.get(8)] = 1
        return lookup(lengths)
    short = [0] * 19
    for i in range(4 + bits.get(4)):
        short[LENGTH_ORDER[i]] = bits.get(3)
    table, n = lookup(short)
    table, mask = table.tolist(), (1 << n) - 1
    left = 2 + bits.get(2 + 2 * bits.get(3)) if bits.get(1) else symbols
    at, before = 0, 8
    data, pos = bits.data, bits.at
    while at < symbols and left:
        left -= 1
        k = pos >> 3
        window = int.from_bytes(data[k : k + 4], "little") >> (pos & 7)
        e = table[window & mask]
        s = e >> 4
        window >>= e & 15
        pos += e & 15
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            value, extra, base = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
            k = base + (window & ((1 << extra) - 1))
            pos += extra
            if at + k > symbols:
                raise ValueError("code lengths run over")
            if value:
                lengths[at : at + k] = [value] * k
            at += k
    bits.at = pos
    return lookup(lengths)


def value_code(n: int) -> tuple[int, int, int]:
    """A length or distance from 1 on as (prefix symbol, extra bits, their number)."""
    n -= 1
    if n < 4:
        return n, 0, 0
    high = n.bit_length() - 1
    second = n >> (high - 1) & 1
    return 2 * high + second, n & ((1 << (high - 1)) - 1), high - 1


def read_value(symbol: int, bits: BitReader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.get(extra) + 1


@lru_cache(maxsize=1)
def neighbours() -> list[tuple[int, int]]:
    """Distance codes 1 to 120: offsets (left, up) by rising distance, nearer columns and the left side first."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


# ---------------------------------------------------------------- entropy-coded images


def _cache_key(argb: int, bits: int) -> int:
    return (argb * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - bits)


def tokens_of(pixels: list[int], cache_bits: int = 0, references: bool = False) -> list[tuple]:
    """Pixels as ("p", argb), ("c", cache key) and ("r", length, distance) tokens, greedily."""
    out: list[tuple] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    last: dict[tuple, int] = {}
    i, n = 0, len(pixels)
    while i < n:
        step = 1
        start = last.get(tuple(pixels[i : i + 3])) if references else None
        if start is not None:
            k = 0
            while i + k < n and k < 4096 and pixels[start + k] == pixels[i + k]:
                k += 1
            if k >= 4:
                out.append(("r", k, i - start))
                step = k
        if step == 1:
            key = _cache_key(pixels[i], cache_bits) if cache_bits else 0
            out.append(("c", key) if cache_bits and cache[key] == pixels[i] else ("p", pixels[i]))
        for j in range(i, i + step):
            if references:
                last[tuple(pixels[j : j + 3])] = j
            if cache_bits:
                cache[_cache_key(pixels[j], cache_bits)] = pixels[j]
        i += step
    return out


def write_image(out: BitWriter, tokens: list[tuple], main: bool, cache_bits: int = 0, longest: int = 15) -> None:
    """An entropy-coded image with one group of prefix codes."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # one meta prefix code
    counts = [[0] * (280 + (1 << cache_bits if cache_bits else 0)), [0] * 256, [0] * 256, [0] * 256, [0] * 40]
    literals = [t[1] for t in tokens if t[0] == "p"]
    for k, shift in enumerate((8, 16, 0, 24)):
        for value, n in Counter([v >> shift & 255 for v in literals]).items():
            counts[k][value] = n
    for t in tokens:
        if t[0] == "p":
            continue
        if t[0] == "c":
            counts[0][280 + t[1]] += 1
        else:
            counts[0][256 + value_code(t[1])[0]] += 1
            counts[4][value_code(t[2] + 120)[0]] += 1
    green, red, blue, alpha, distance = (write_code(out, c, longest) for c in counts)
    said = [(code, shift) for code, shift in ((green, 8), (red, 16), (blue, 0), (alpha, 24)) if len(code) > 1]
    for t in tokens:
        if t[0] == "p":
            for code, shift in said:
                out.put(*code[t[1] >> shift & 255])
        elif t[0] == "c":
            out.put(*green[280 + t[1]])
        else:
            for code, base, value in ((green, 256, t[1]), (distance, 0, t[2] + 120)):
                symbol, extra, bits = value_code(value)
                out.put(*code[base + symbol])
                out.put(extra, bits)


class Codes:
    """The five prefix codes of a group."""

    def __init__(self, bits: BitReader, cache_bits: int):
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        self.tables = [read_code(bits, n) for n in sizes]
        self.lists: list | None = None

    def ready(self) -> list[tuple[list[int], int]]:
        if self.lists is None:
            self.lists = [(t.tolist(), (1 << n) - 1) for t, n in self.tables]
        return self.lists


class ImageHead:
    """What stands before the pixels of an entropy-coded image."""

    def __init__(self, bits: BitReader, width: int, height: int, main: bool):
        self.width, self.height = width, height
        self.cache_bits = bits.get(4) if bits.get(1) else 0
        self.meta_bits, self.meta = 0, None
        groups = 1
        if main and bits.get(1):
            self.meta_bits = bits.get(3) + 2
            w, h = ((x + (1 << self.meta_bits) - 1) >> self.meta_bits for x in (width, height))
            self.meta = [p >> 8 & 0xFFFF for p in read_image(bits, w, h, False)]
            groups = max(self.meta) + 1
        self.codes = [Codes(bits, self.cache_bits) for _ in range(groups)]


def read_pixels(bits: BitReader, head: ImageHead, pixels: list[int] | None = None) -> list[int]:
    """The rest of an image's pixels behind those given."""
    pixels = [] if pixels is None else pixels
    width, total, cache_bits = head.width, head.width * head.height, head.cache_bits
    cache = [0] * (1 << cache_bits) if cache_bits else []
    cached = 0
    across = (width + (1 << head.meta_bits) - 1) >> head.meta_bits
    tables = head.codes[0].ready()
    # where only green takes bits, the other channels are the same all over
    flat = len(head.codes) == 1 and not any(mask for _, mask in tables[1:4])
    rest = sum((t[0] >> 4) << shift for (t, _), shift in zip(tables[1:4], (16, 0, 24)))
    plain = flat and not cache_bits
    data = bits.data
    while (n := len(pixels)) < total:
        if plain:  # literals one after the other, without the general case's detours
            table, mask = tables[0]
            at, left = bits.at, total - n
            while left:
                k = at >> 3
                e = table[int.from_bytes(data[k : k + 4], "little") >> (at & 7) & mask]
                if e >= 4096:
                    break
                at += e & 15
                pixels.append((e >> 4) << 8 | rest)
                left -= 1
            bits.at = at
            if not left:
                break
            n = total - left
        if head.meta:
            tables = head.codes[head.meta[(n // width >> head.meta_bits) * across + (n % width >> head.meta_bits)]].ready()
        table, mask = tables[0]
        e = table[bits.peek() & mask]
        bits.at += e & 15
        s = e >> 4
        if s < 256 and flat:
            pixels.append(s << 8 | rest)
        elif s < 256:
            value = s << 8
            for (table, mask), shift in zip(tables[1:4], (16, 0, 24)):
                e = table[bits.peek() & mask]
                bits.at += e & 15
                value |= (e >> 4) << shift
            pixels.append(value)
        elif s < 280:
            length = read_value(s - 256, bits)
            table, mask = tables[4]
            e = table[bits.peek() & mask]
            bits.at += e & 15
            distance = read_value(e >> 4, bits)
            if distance > 120:
                distance -= 120
            else:
                left, up = neighbours()[distance - 1]
                distance = max(1, left + up * width)
            if distance > n or n + length > total:
                raise ValueError("a back-reference out of the image")
            if distance >= length:
                pixels += pixels[n - distance : n - distance + length]
            else:
                unit = pixels[n - distance :]
                pixels += (unit * (length // distance + 1))[:length]
        else:
            pixels.append(cache[s - 280])
        if cache_bits:
            # the cache holds all pixels before the next symbol
            for p in pixels[cached:]:
                cache[_cache_key(p, cache_bits)] = p
            cached = len(pixels)
    return pixels


def read_image(bits: BitReader, width: int, height: int, main: bool) -> list[int]:
    return read_pixels(bits, ImageHead(bits, width, height, main))


# ---------------------------------------------------------------- transforms on arrays (height, width, A R G B)


def channels(argb: np.ndarray) -> np.ndarray:
    return (argb[..., None] >> np.array([24, 16, 8, 0])) & 255


def argb(parts: np.ndarray) -> np.ndarray:
    return (parts.astype(np.int64) << np.array([24, 16, 8, 0])).sum(axis=-1)


def _average(a, b):
    return (a + b) // 2


def predict(mode: int, left, top, top_left, top_right):
    """The predicted channels of a pixel (lists of four)."""
    if mode == 0:
        return (255, 0, 0, 0)
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    each = list(zip(left, top, top_left, top_right))
    if mode == 5:
        return [_average(_average(a, d), b) for a, b, c, d in each]
    if mode == 6:
        return [_average(a, c) for a, b, c, d in each]
    if mode == 7:
        return [_average(a, b) for a, b, c, d in each]
    if mode == 8:
        return [_average(c, b) for a, b, c, d in each]
    if mode == 9:
        return [_average(b, d) for a, b, c, d in each]
    if mode == 10:
        return [_average(_average(a, c), _average(b, d)) for a, b, c, d in each]
    if mode == 11:
        to_left = sum(abs(b - c) for a, b, c, d in each)
        to_top = sum(abs(a - c) for a, b, c, d in each)
        return left if to_left < to_top else top
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return [clamp(a + b - c) for a, b, c, d in each]
    if mode == 13:
        return [clamp(_average(a, b) + int((_average(a, b) - c) / 2)) for a, b, c, d in each]
    return (255, 0, 0, 0)


def predictor(image: np.ndarray, bits: int, modes: np.ndarray, inverse: bool) -> np.ndarray:
    """Add (inverse) or subtract the prediction of every pixel, with a mode a block."""
    height, width, _ = image.shape
    source = image.tolist()
    out = [[None] * width for _ in range(height)]
    known = out if inverse else source
    sign = 1 if inverse else -1
    for y in range(height):
        for x in range(width):
            if x == y == 0:
                guess = (255, 0, 0, 0)
            elif y == 0:
                guess = known[0][x - 1]
            elif x == 0:
                guess = known[y - 1][0]
            else:
                # right of the last column stands the first pixel of the same row
                beyond = known[y - 1][x + 1] if x + 1 < width else known[y][0]
                guess = predict(int(modes[y >> bits][x >> bits]), known[y][x - 1], known[y - 1][x], known[y - 1][x - 1], beyond)
            out[y][x] = [(v + sign * g) & 255 for v, g in zip(source[y][x], guess)]
    return np.array(out, dtype=np.int64).reshape(image.shape)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v + 128) % 256 - 128


def cross_colour(image: np.ndarray, bits: int, factors: np.ndarray, inverse: bool) -> np.ndarray:
    """Add or subtract green's share of red and blue, and red's of blue; factors: (.., A R G B) a block."""
    height, width, _ = image.shape
    block = factors[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    red_to_blue, green_to_blue, green_to_red = (_signed(block[..., k]) for k in (1, 2, 3))
    out = image.copy()
    green, sign = _signed(image[..., 2]), 1 if inverse else -1
    red = (image[..., 1] + sign * (green_to_red * green >> 5)) & 255
    seen = _signed(red if inverse else image[..., 1])
    out[..., 1] = red
    out[..., 3] = (image[..., 3] + sign * (green_to_blue * green >> 5) + sign * (red_to_blue * seen >> 5)) & 255
    return out


def subtract_green(image: np.ndarray, inverse: bool) -> np.ndarray:
    out = image.copy()
    for k in (1, 3):
        out[..., k] = (image[..., k] + (image[..., 2] if inverse else -image[..., 2])) & 255
    return out


def bundle_bits(colours: int) -> int:
    """Pixels to a sample are 2 to this power."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def bundle(indices: np.ndarray, bits: int) -> np.ndarray:
    height, width = indices.shape
    each, depth = 1 << bits, 8 >> bits
    held = np.zeros((height, -(-width // each) * each), np.int64)
    held[:, :width] = indices
    return (held.reshape(height, -1, each) << (np.arange(each) * depth)).sum(axis=2)


def unbundle(samples: np.ndarray, bits: int, width: int) -> np.ndarray:
    each, depth = 1 << bits, 8 >> bits
    out = (samples[..., None] >> (np.arange(each) * depth)) & ((1 << depth) - 1)
    return out.reshape(samples.shape[0], -1)[:, :width]


# ---------------------------------------------------------------- files


def _file(data: bytes) -> bytes:
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def _head(out: BitWriter, width: int, height: int, alpha: bool) -> None:
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)


def encode_argb(image: np.ndarray, transforms: Sequence[int] = (), cache_bits: int = 0, references: bool = False, block_bits: int = 3) -> bytes:
    """A WebP file of an (height, width) array of ARGB numbers, with any of the format's tools."""
    height, width = image.shape
    out = BitWriter()
    _head(out, width, height, True)
    parts = channels(image.astype(np.int64))
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        h, w = ((n + (1 << block_bits) - 1) >> block_bits for n in parts.shape[:2])
        if kind == PREDICTOR:
            modes = (np.arange(h * w) % 14).reshape(h, w)
            out.put(block_bits - 2, 3)
            write_image(out, tokens_of((modes << 8).ravel().tolist()), False)
            parts = predictor(parts, block_bits, modes, False)
        elif kind == CROSS_COLOUR:
            factors = np.stack([np.full((h, w), 255), *((np.arange(h * w).reshape(h, w) * k + k) & 255 for k in (3, 7, 11))], axis=-1)
            out.put(block_bits - 2, 3)
            write_image(out, tokens_of(argb(factors).ravel().tolist()), False)
            parts = cross_colour(parts, block_bits, factors, False)
        elif kind == SUBTRACT_GREEN:
            parts = subtract_green(parts, False)
        else:
            colours, indices = np.unique(argb(parts), return_inverse=True)
            bits = bundle_bits(len(colours))
            _write_palette(out, channels(colours))
            samples = bundle(indices.reshape(parts.shape[:2]), bits)
            parts = channels(samples << 8 | OPAQUE)
    out.put(0, 1)
    write_image(out, tokens_of(argb(parts).ravel().tolist(), cache_bits, references), True, cache_bits)
    return _file(out.bytes())


def _write_palette(out: BitWriter, colours: np.ndarray) -> None:
    """The colours, each as the difference to the one before."""
    out.put(len(colours) - 1, 8)
    steps = np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.int64)) & 255
    write_image(out, tokens_of(argb(steps).tolist()), False)


def encode_payload(payload: bytes) -> bytes:
    """A payload (a multiple of 576 bytes) as WebP files of 8-bit samples, one behind the other."""
    step = WIDTH * MAX_SIDE
    return b"".join(_encode_samples(payload[i : i + step]) for i in range(0, len(payload), step))


def _encode_samples(payload: bytes) -> bytes:
    samples = np.frombuffer(payload, np.uint8)
    present = np.flatnonzero(np.bincount(samples, minlength=256))
    width, height = WIDTH, len(samples) // WIDTH
    out = BitWriter()
    _head(out, width, height, False)
    out.put(1, 1)
    out.put(PALETTE, 2)
    colours = np.zeros((len(present), 4), np.int64)
    colours[:, 0], colours[:, 2] = 255, present  # the sample is the green channel
    _write_palette(out, colours)
    out.put(0, 1)
    index = np.zeros(256, np.uint8)
    index[present] = np.arange(len(present))
    values = index[samples]
    bits = bundle_bits(len(present))
    if bits:
        values = bundle(values.reshape(height, width).astype(np.int64), bits).astype(np.uint8).ravel()
    # the padding's run is one back-reference to the sample before
    run = len(values) - 1 - int(np.flatnonzero(values != values[-1])[-1]) if (values != values[-1]).any() else len(values)
    keep = len(values) - (run - 1 if run >= 8 else 0)
    counts = np.zeros(280, np.int64)
    counts[:256] = np.bincount(values[:keep], minlength=256)
    tail = []
    left = len(values) - keep
    while left:
        k = min(left, 4096)
        tail.append(value_code(k))
        counts[256 + tail[-1][0]] += 1
        left -= k
    out.put(0, 1)  # no colour cache
    out.put(0, 1)  # one meta prefix code
    green = write_code(out, counts.tolist(), LONGEST)
    for lone in (0, 0, 255, value_code(2)[0]):  # red, blue, alpha; distance code 2 is the pixel to the left
        write_lone(out, lone)
    codes, lengths = np.zeros(280, np.int64), np.zeros(280, np.int64)
    for s, (code, n) in green.items():
        codes[s], lengths[s] = code, n
    if lengths[values[:keep]].any():
        out.put_array(codes[values[:keep]], lengths[values[:keep]])
    for symbol, extra, n in tail:
        out.put(*green[256 + symbol])
        out.put(extra, n)
    return _file(out.bytes())


class Picture:
    """A file under decoding: transforms and codes are read, pixels still to come."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        self.bits = bits = BitReader(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
        if bits.get(8) != 0x2F:
            raise ValueError("not a lossless WebP stream")
        self.width, self.height, self.alpha = bits.get(14) + 1, bits.get(14) + 1, bits.get(1)
        if bits.get(3):
            raise ValueError("an unknown version")
        self.transforms: list[tuple] = []
        width = self.width
        while bits.get(1):
            kind = bits.get(2)
            if kind in (PREDICTOR, CROSS_COLOUR):
                n = bits.get(3) + 2
                w, h = ((x + (1 << n) - 1) >> n for x in (width, self.height))
                data_image = channels(np.array(read_image(bits, w, h, False), np.int64).reshape(h, w))
                self.transforms.append((kind, n, data_image))
            elif kind == SUBTRACT_GREEN:
                self.transforms.append((kind,))
            else:
                n = bits.get(8) + 1
                steps = channels(np.array(read_image(bits, n, 1, False), np.int64))
                pack = bundle_bits(n)
                self.transforms.append((kind, pack, np.cumsum(steps, axis=0) & 255, width))
                width = (width + (1 << pack) - 1) >> pack
        self.head = ImageHead(bits, width, self.height, True)

    def plain(self) -> bool:
        """One group of codes, all but green with a lone symbol: a literal is one symbol."""
        h = self.head
        return not h.cache_bits and len(h.codes) == 1 and all(n == 0 for _, n in h.codes[0].tables[1:4]) and h.codes[0].tables[0][1] > 0

    def finish(self, pixels: list[int] | np.ndarray) -> np.ndarray:
        """The picture (height, width, A R G B) from its coded pixels."""
        image = channels(np.asarray(pixels, np.int64).reshape(self.height, self.head.width))
        for kind, *rest in reversed(self.transforms):
            if kind == PREDICTOR:
                image = predictor(image, rest[0], rest[1][..., 2], True)
            elif kind == CROSS_COLOUR:
                image = cross_colour(image, rest[0], rest[1], True)
            elif kind == SUBTRACT_GREEN:
                image = subtract_green(image, True)
            else:
                pack, colours, width = rest
                held = np.zeros((256, 4), np.int64)
                held[: len(colours)] = colours
                image = held[unbundle(image[..., 2], pack, width)]
        if not self.alpha:
            image[..., 0] = 255
        return image


def decode(data: bytes) -> np.ndarray:
    """A WebP file as an array (height, width, A R G B)."""
    picture = Picture(data)
    return picture.finish(read_pixels(picture.bits, picture.head))


def _split_files(media: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(media[at : at + size])
        at += size
    return out


def decode_samples(files: list[bytes]) -> list[np.ndarray]:
    """The green samples of many files; those with plain literals are walked side by side."""
    pictures = [Picture(f) for f in files]
    coded: list[np.ndarray | list[int] | None] = [None] * len(files)
    lanes = [i for i, p in enumerate(pictures) if p.plain()]
    if len(lanes) >= FEW_LANES:
        _walk(pictures, lanes, coded)
    out = []
    for p, done in zip(pictures, coded):
        if done is None or isinstance(done, list):
            done = np.array(read_pixels(p.bits, p.head, done), np.int64)
            green = done >> 8 & 255
        else:
            green = done
        if len(p.transforms) == 1 and p.transforms[0][0] == PALETTE:
            _, pack, colours, width = p.transforms[0]
            held = np.zeros(256, np.uint8)
            held[: len(colours)] = colours[:, 2]
            green = green.reshape(p.height, -1)
            out.append(held[unbundle(green, pack, width) if pack else green].ravel())
        else:
            out.append(p.finish(done if green is not done else green << 8)[..., 2].astype(np.uint8).ravel())
    return out


def _walk(pictures: list[Picture], lanes: list[int], coded: list) -> None:
    """Read the literals of many images in step; ``coded`` gets whole images, or a start to go on from."""
    lanes = sorted(lanes, key=lambda i: -pictures[i].head.width * pictures[i].height)
    totals = np.array([pictures[i].head.width * pictures[i].height for i in lanes])
    streams = [pictures[i].bits.data for i in lanes]
    begins = np.cumsum([0] + [len(s) + 4 for s in streams])
    raw = np.frombuffer(b"".join(s + b"\0\0\0\0" for s in streams) + b"\0\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
    del raw
    tables = [pictures[i].head.codes[0].tables[0] for i in lanes]
    bases = np.cumsum([0] + [len(t) for t, _ in tables])[:-1]
    table = np.concatenate([t for t, _ in tables])
    # what is no literal takes no bits: its lane stands still and is found afterwards
    table = np.where(table >= 256 << 4, table & ~15, table).astype(np.int32)
    masks = np.array([(1 << n) - 1 for _, n in tables], np.uint32)
    at = np.array([pictures[i].bits.at for i in lanes], np.int64) + begins[:-1] * 8
    first = np.cumsum(np.concatenate([[0], totals]))[:-1]
    out = np.zeros(int(totals.sum()), np.uint16)
    step, active = 0, len(lanes)
    while active >= FEW_LANES:
        until = int(totals[active - 1])
        a, where, base, mask = at[:active], first[:active] + step, bases[:active], masks[:active]
        for _ in range(step, until):
            e = table[base + ((words[a >> 3] >> (a & 7).astype(np.uint32)) & mask)]
            out[where] = e >> 4
            a += e & 15
            where += 1
        step = until
        active = int(np.searchsorted(-totals, -step, "left"))
    for k, i in enumerate(lanes):
        done = min(step, int(totals[k]))
        mine = out[first[k] : first[k] + done]
        stuck = np.flatnonzero(mine >= 256)
        if not len(stuck) and done == totals[k]:
            coded[i] = mine
            continue
        # go on one by one from the first symbol that is no literal
        p = pictures[i]
        p.bits.at = int(at[k] - begins[k] * 8)
        rest = sum((int(t[0]) >> 4) << shift for (t, _), shift in zip(p.head.codes[0].tables[1:4], (16, 0, 24)))
        mine = mine[: stuck[0]] if len(stuck) else mine
        coded[i] = (mine.astype(np.int64) << 8 | rest).tolist()


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\xff" * ((-len(raw)) % UNIT or (0 if raw else UNIT)), len(raw)


def feature(samples: np.ndarray) -> str:
    """Samples, distinct values, mean and entropy in bits, and the mean step between neighbours."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    mean = float((np.arange(256) * counts).sum() / len(samples))
    steps = float(np.abs(np.diff(samples.astype(np.int16))).mean())
    return f"n={len(samples)};k={len(p)};mean={mean:.3f};bits={-(p * np.log2(p)).sum() + 0.0:.3f};step={steps:.3f}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Store each text as WebP, read the stored bytes back and describe both."""
    bounded_batches(docs.sparkSession)
    schema = SCHEMA + (", media binary" if with_media else "")

    def rows(ids: list, held: list[tuple[bytes, int]]) -> pa.RecordBatch:
        media = [encode_payload(p) for p, _ in held]
        parts = [_split_files(m) for m in media]
        samples = iter(decode_samples([f for fs in parts for f in fs]))
        out = []
        for doc, (_, n), m, fs in zip(ids, held, media, parts):
            got = [next(samples) for _ in fs]
            got = got[0] if len(got) == 1 else np.concatenate(got)
            back = got.tobytes()
            row = (doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(got))
            out.append((*row, m) if with_media else row)
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
                ids.append(doc)
                held.append(payload_of(text))
                size += len(held[-1][0])
                if size >= LANE_BYTES:
                    yield rows(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield rows(ids, held)

    return slim(docs).mapInArrow(run, schema)
