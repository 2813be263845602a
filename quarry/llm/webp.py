"""Media columns in lossless WebP: a writer for byte payloads, and a reader of the whole lossless format that gives pixel arrays.

The writer stores each image in the form that is estimated to be smallest: its colours by a palette (packed where they are few), by differences to
the pixel on the left or above, with green subtracted, or plain; then back-references to earlier pixels, the colour cache where it pays, and prefix
codes made for the image. The reader decodes prefix codes (also several groups chosen by a meta image), back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms. Where an image has one group of codes, the lengths of the codes at all
bits are looked up at once and only the way from pixel to pixel is walked; references and cache hits are followed for all pixels together.

A null text is an empty payload; payloads are filled with blanks to a positive multiple of 192 bytes, one row of 64 RGB pixels each; over MOST_ROWS
rows, as very long texts have, go to further images, stored one behind the other. Of forms of equal size the first in the order above counts. Repeated
rows give repeated media, equal texts equal ones. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, payload

WIDTH, MOST_ROWS = 64, 1024
#: Bits in which the reader looks for several code lengths at once.
SEVERAL = 12
ROW = 3 * WIDTH
#: Fixed values of the format: the order in which the lengths of the length code stand.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Fixed value of the format: the factor of the colour cache's hash.
CACHE_FACTOR = 0x1E35A7BD
#: The 120 short distance codes: (x, y) before the pixel, the nearest first, then the smaller x, then to the left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
PIXEL_SCHEMA = "doc_id long, n_bytes long, media binary, pixels binary, feature string"


class WebpError(ValueError):
    """A file that breaks the format."""


class Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + ((self.at & 7) + n + 7 >> 3)], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise WebpError("the image is cut short")
        out = self.peek(n)
        self.at += n
        return out


@functools.cache
def turned(n: int) -> np.ndarray:
    """The numbers of n bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols in the order of their codes, the codes' lengths, their shares of all numbers of the greatest length's bits); one symbol takes no bits."""
    order = lengths.nonzero()[0]
    if len(order) < 2:
        return order if len(order) else np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64)
    sizes = lengths[order]
    by_size = sizes.argsort(kind="stable")
    order, sizes = order[by_size], sizes[by_size]
    return order, sizes, np.left_shift(1, sizes[-1] - sizes)


class PrefixCode:
    """A canonical code as a table: the next bits, the first in the lowest place, give symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.order, sizes, shares = canonical(lengths)
        self.single = len(self.order) == 1
        self.most = int(sizes[-1])
        if shares.sum() != 1 << self.most:
            raise WebpError("a prefix code is not complete")
        self.table = np.empty(1 << self.most, np.int32)
        self.table[turned(self.most)] = (self.order << 4 | sizes).repeat(shares)
        self.mask = (1 << self.most) - 1
        self._list: list[int] | None = None

    @property
    def listed(self) -> list[int]:
        if self._list is None:
            self._list = self.table.tolist()
        return self._list

    @functools.cached_property
    def several(self) -> list[tuple[list[int], int, int] | None]:
        """Of a code of code lengths, by the next SEVERAL bits: (the lengths that its whole tokens there give, the bits of these, the last length that is
        not 0); filled in as it is asked. A repetition of a length that stands before is left for the reader."""
        return [None] * (1 << SEVERAL)

    def lengths_of(self, window: int) -> tuple[list[int], int, int]:
        found, used, before = [], 0, 0
        while True:
            s = self.listed[window >> used & self.mask]
            k, s = s & 15, s >> 4
            extra = 0 if s < 16 else 2 if s == 16 else 3 if s == 17 else 7
            if used + k + extra > SEVERAL or s == 16 or not k:
                break
            if s < 16:
                found.append(s)
                before = s or before
            else:
                found += [0] * ((3 if s == 17 else 11) + (window >> used + k & ((1 << extra) - 1)))
            used += k + extra
        self.several[window] = found, used, before
        return self.several[window]

    def symbol(self, bits: Bits) -> int:
        found = self.listed[bits.peek(self.most)]
        bits.read(found & 15)
        return found >> 4


@functools.lru_cache(1_000)
def _code_of_lengths(lengths: tuple[int, ...]) -> PrefixCode:
    return PrefixCode(np.array(lengths))


@functools.lru_cache(10_000)
def _code_of_symbols(alphabet: int, *symbols: int) -> PrefixCode:
    lengths = np.zeros(max(alphabet, 256), np.int64)
    lengths[list(symbols)] = 1
    return PrefixCode(lengths)


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        n = bits.read(1) + 1
        first = bits.read(8 if bits.read(1) else 1)
        return _code_of_symbols(alphabet, first, bits.read(8)) if n == 2 else _code_of_symbols(alphabet, first)
    of_lengths = [0] * 19
    n = 4 + bits.read(4)
    given = bits.read(3 * n)
    for k in range(n):
        of_lengths[LENGTH_ORDER[k]] = given >> 3 * k & 7
    inner, left, several = _code_of_lengths(tuple(of_lengths)), alphabet, None
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    else:  # no number of tokens is given, so many can be read at once
        several = inner.several
    table, mask, used = inner.listed, (1 << inner.most) - 1, 0
    found, before, begin, ahead, have = [], 8, bits.at, 0, 0
    while several:
        if used + SEVERAL > have:
            bits.at = begin + used
            ahead, have = bits.peek(240), used + 240
        window = ahead & ((1 << SEVERAL) - 1)
        some, k, last = several[window] or inner.lengths_of(window)
        if k and len(found) + len(some) <= alphabet:
            found += some
            before = last or before
        elif (s := table[window & mask]) >> 4 == 16 and len(found) < alphabet:
            k = s & 15
            found += [before] * (3 + (window >> k & 3))
            k += 2
        else:
            break
        ahead >>= k
        used += k
    while left and len(found) < alphabet:
        left -= 1
        if used + 14 > have:  # a symbol takes at most 14 bits; a short window is shifted quickly
            bits.at = begin + used
            ahead, have = bits.peek(240), used + 240
        s = table[ahead & mask]
        ahead >>= s & 15
        used += s & 15
        s >>= 4
        if s < 16:
            found.append(s)
            before = s or before
        elif s == 16:
            found += [before] * (3 + (ahead & 3))
            ahead >>= 2
            used += 2
        elif s == 17:
            found += [0] * (3 + (ahead & 7))
            ahead >>= 3
            used += 3
        else:
            found += [0] * (11 + (ahead & 127))
            ahead >>= 7
            used += 7
    bits.at = begin + used
    if bits.at > 8 * len(bits.data):
        raise WebpError("the image is cut short")
    if len(found) > alphabet:
        raise WebpError("too many code lengths")
    return PrefixCode(np.frombuffer(bytes(found), np.uint8).astype(np.int64))


def _value(bits: Bits, s: int) -> int:
    """The number of a length or distance symbol."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    """Pixels back, of a distance code: the short ones name a place nearby."""
    return code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB numbers, (height, width)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, shift, n_groups = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        meta = (read_image(bits, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False) >> 8) & 0xFFFF
        n_groups = int(meta.max()) + 1
    groups = [[read_code(bits, n) for n in (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
    n = width * height
    if meta is None:
        return _one_group(bits, groups[0], cache_bits, width, n).reshape(height, width)
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    at = cached = 0
    while at < n:
        green, red, blue, alpha, distance = groups[int(meta[(at // width) >> shift, (at % width) >> shift])] if meta is not None else groups[0]
        s = green.symbol(bits)
        if s < 256:
            r = red.symbol(bits)
            b = blue.symbol(bits)
            out[at] = alpha.symbol(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = _value(bits, s - 256)
            d = _distance(_value(bits, distance.symbol(bits)), width)
            if d > at or at + length > n:
                raise WebpError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - d]
            at += length
        else:
            while cached < at:
                cache[(CACHE_FACTOR * out[cached] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def _one_group(bits: Bits, group: list[PrefixCode], cache_bits: int, width: int, n: int) -> np.ndarray:
    """n pixels coded by one group. From every bit on, the length of a pixel that would begin there is found; a walk then takes the bits at which pixels begin."""
    green, red, blue, alpha, distance = group
    others = [(red, 16), (blue, 0), (alpha, 24)]
    if green.single and green.order[0] < 256 and all(c.single for c, _ in others):
        return np.full(n, sum(int(c.order[0]) << shift for c, shift in [(green, 8), *others]), np.uint32)
    start, begin = bits.at & 7, bits.at >> 3
    most = max(sum(c.most for c in group[:4]), 58)
    raw = np.frombuffer(bits.data, np.uint8, min(len(bits.data) - begin, (n * most >> 3) + 9), begin)
    end = 8 * len(raw)
    wide = np.concatenate([raw, np.zeros(24, np.uint8)]).astype(np.int64)
    wide = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    ahead = (wide[:, None] >> np.arange(8)).reshape(-1)  # at least 25 bits from each bit on; no pixel takes as many bits as are added at the end
    of_green = green.table.take(ahead & green.mask, mode="clip")
    following = np.arange(len(ahead)) + (of_green & 15)
    rare = (of_green >= 256 << 4).nonzero()[0]
    rare_after = np.where(of_green[rare] < 280 << 4, -1, following[rare])
    for code, _ in others:
        if not code.single:
            following += (code.table & 15).take((ahead & code.mask), mode="clip").take(following, mode="clip")
    following[rare] = rare_after
    following[end:] = -1
    second = following[following]  # -1 leads to the last place, and so to itself
    fourth = second[second]

    def value(s: int, at: int) -> tuple[int, int]:
        if s < 4:
            return s + 1, at
        extra = (s - 2) >> 1
        return ((2 + (s & 1)) << extra) + (int(ahead[at]) & ((1 << extra) - 1)) + 1, at + extra

    begins: list[int] = []
    ones: list[int] = []
    copies: list[tuple[int, int, int, int]] = []
    step, leap, note, alone = memoryview(following), memoryview(fourth), begins.append, ones.append
    at, o = 0, start
    while at < n:
        to = leap[o]
        if to >= 0 and at + 4 <= n:
            note(o)
            o = to
            at += 4
            continue
        alone(len(begins))
        note(o)
        to = step[o]
        if to >= 0:
            o = to
            at += 1
            continue
        if o >= end:
            raise WebpError("the image is cut short")
        found = int(of_green[o])
        length, o = value((found >> 4) - 256, o + (found & 15))
        if o > end:
            raise WebpError("the image is cut short")
        found = int(distance.table[ahead[o] & distance.mask])
        d, o = value(found >> 4, o + (found & 15))
        d = _distance(d, width)
        if d > at or at + length > n:
            raise WebpError("a back-reference leaves the image")
        copies.append((len(begins) - 1, at, length, d))
        at += length
    if o > end:
        raise WebpError("the image is cut short")
    bits.at += o - start
    first = np.array(begins, np.int64)
    each = np.full(len(first), 4)
    each[ones] = 1
    third = second[first]
    first = np.stack([first, following[first], third, following[third]], 1)[np.arange(4) < each[:, None]]
    last = np.cumsum(each) - 1
    symbol = of_green[first] >> 4
    literal = symbol < 256
    place, colour = first[literal], symbol[literal].astype(np.uint32) << np.uint32(8)
    place = place + (of_green[place] & 15)
    for code, shift in others:
        found = code.table[ahead[place] & code.mask]
        colour |= (found >> 4).astype(np.uint32) << np.uint32(shift)
        place = place + (found & 15)
    if len(colour) == n:
        return colour
    counts = np.ones(len(first), np.int64)
    source = np.arange(n + 1)
    if copies:
        k, at, length, d = np.array(copies, np.int64).T
        counts[last[k]] = length
        ends = np.cumsum(length)
        copied = np.arange(ends[-1]) + np.repeat(at - ends + length, length)
        source[copied] = copied - np.repeat(d, length)
    where = np.cumsum(counts) - counts
    pixels = np.zeros(n + 1, np.uint32)  # the last one, 0, is what an empty cell of the cache holds
    pixels[where[literal]] = colour
    hits = where[symbol >= 280]
    if len(hits):
        cell = np.full(n + 1, -1, np.int64)
        cell[where[literal]] = (colour * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
        cell[hits] = symbol[symbol >= 280] - 280
        cell = cell[_roots(source)][:n]
        order = np.argsort(cell, kind="stable")
        before = np.full(n, n, np.int64)
        same = cell[order[1:]] == cell[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        source[hits] = before[hits]
    return pixels[_roots(source)][:n]


def _roots(source: np.ndarray) -> np.ndarray:
    """Where the pointers end, which lead to earlier places or to themselves."""
    while ((further := source[source]) != source).any():
        source = further
    return source


def _split(p: np.ndarray) -> np.ndarray:
    """ARGB numbers as channels a, r, g, b."""
    return np.stack([(p >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_left, top_right) -> list[int]:
    """One pixel's prediction, channel by channel, as the format fixes it for its 14 modes."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    bound = lambda v: min(255, max(0, v))
    if mode == 0:
        return [255, 0, 0, 0]
    if mode <= 4:
        return list((left, top, top_right, top_left)[mode - 1])
    if mode <= 10:
        return {5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left), 7: lambda: half(left, top), 8: lambda: half(top_left, top), 9: lambda: half(top, top_right), 10: lambda: half(half(left, top_left), half(top, top_right))}[mode]()
    if mode == 11:
        to_left = sum(abs(t - tl) for t, tl in zip(top, top_left, strict=True))
        to_top = sum(abs(a - tl) for a, tl in zip(left, top_left, strict=True))
        return list(left if to_left < to_top else top)
    if mode == 12:
        return [bound(a + t - tl) for a, t, tl in zip(left, top, top_left, strict=True)]
    if mode == 13:
        mean = half(left, top)
        return [bound(m + int((m - tl) / 2)) for m, tl in zip(mean, top_left, strict=True)]
    return [255, 0, 0, 0]


def _invert_predictor(p: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = p.shape
    kinds = (modes >> 8) & 15
    if (kinds == kinds[0, 0]).all() and kinds[0, 0] in (1, 2):  # sums along rows, or down columns
        c = _split(p)
        c[0, 0, 0] += 255
        first, other = (0, 1) if kinds[0, 0] == 1 else (1, 0)
        edge = (slice(None), 0) if first == 0 else (0, slice(None))
        c[edge] = np.cumsum(c[edge], 0) & 255
        return _join(np.cumsum(c, other))
    c = _split(p).tolist()
    kinds = kinds.tolist()
    for y in range(height):
        row, above = c[y], c[y - 1] if y else None
        for x in range(width):
            if not y:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                guess = above[0]
            else:
                guess = predict(kinds[y >> shift][x >> shift], row[x - 1], above[x], above[x - 1], above[x + 1] if x + 1 < width else row[0])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], guess, strict=True)]
    return _join(np.array(c))


def _signed(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int32) & 255
    return v - 256 * (v > 127)


def _invert_cross_colour(p: np.ndarray, factors: np.ndarray, shift: int) -> np.ndarray:
    height, width = p.shape
    c, f = _split(p), _split(factors)
    f = _signed(f[np.arange(height)[:, None] >> shift, np.arange(width)[None] >> shift])
    green = _signed(c[..., 2])
    red = c[..., 1] + ((f[..., 3] * green) >> 5)
    c[..., 1] = red & 255
    c[..., 3] += ((f[..., 2] * green) >> 5) + ((f[..., 1] * _signed(c[..., 1])) >> 5)
    return _join(c)


def decode_stream(data: bytes) -> np.ndarray:
    """ARGB numbers, (height, width), of a VP8L chunk."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise WebpError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebpError("unknown version")
    full, done, todo = width, set(), []
    while bits.read(1):
        kind = bits.read(2)
        if kind in done:
            raise WebpError("a transform stands twice")
        done.add(kind)
        if kind < 2:
            shift = bits.read(3) + 2
            side = 1 << shift
            todo.append((kind, read_image(bits, (full + side - 1) >> shift, (height + side - 1) >> shift, False), shift, full))
        elif kind == 2:
            todo.append((kind, None, 0, full))
        else:
            size = bits.read(8) + 1
            palette = _join(np.cumsum(_split(read_image(bits, size, 1, False)[0]), 0))
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, palette, pack, full))
            full = (full + (1 << pack) - 1) >> pack
    p = read_image(bits, full, height, True)
    for kind, extra, shift, wide in reversed(todo):
        if kind == 0:
            p = _invert_predictor(p, extra, shift)
        elif kind == 1:
            p = _invert_cross_colour(p, extra, shift)
        elif kind == 2:
            c = _split(p)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            p = _join(c)
        else:
            index = (p >> 8) & 255
            if shift:
                each = 8 >> shift
                index = (index[..., None] >> (np.arange(1 << shift) * each)) & ((1 << each) - 1)
                index = index.reshape(height, -1)[:, :wide]
            p = np.where(index < len(extra), extra[np.minimum(index, len(extra) - 1)], 0).astype(np.uint32)
    return p


def images(content: bytes) -> Iterator[np.ndarray]:
    """The images of WebP files that stand one behind the other."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != b"RIFF" or content[at + 8 : at + 16] != b"WEBPVP8L" or at + 20 > len(content):
            raise WebpError("no lossless WebP file")
        whole, n = struct.unpack_from("<I", content, at + 4)[0], struct.unpack_from("<I", content, at + 16)[0]
        if at + 8 + whole > len(content) or n + 12 > whole:
            raise WebpError("the file is cut short")
        yield decode_stream(content[at + 20 : at + 20 + n])
        at += 8 + whole + (whole & 1)


class Tokens:
    """Bits to write as numbers with their lengths, the first bit in the lowest place."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def add(self, value: int, n: int) -> None:
        self.few.append((value, n))

    def _close(self) -> None:
        if self.few:
            values, sizes = zip(*self.few, strict=True)
            self.values.append(np.array(values, np.uint64))
            self.sizes.append(np.array(sizes, np.int64))
            self.few = []

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._close()
        self.values.append(values)
        self.sizes.append(sizes)

    def bytes(self) -> bytes:
        self._close()
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word, place = begins >> 6, (begins & 63).astype(np.uint64)
        edges = np.concatenate([[0], (word[1:] != word[:-1]).nonzero()[0] + 1])
        out = np.zeros(int(word[-1]) + 2, "<u8")
        out[word[edges]] = np.bitwise_or.reduceat(values << place, edges)
        out[word[edges] + 1] |= np.bitwise_or.reduceat(values >> np.uint64(1) >> (np.uint64(63) - place), edges)
        return out.tobytes()[: int(ends[-1]) + 7 >> 3]


#: More than any number of pixels.
_LAST = 1 << 62


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of an optimal prefix code; where one would exceed `most`, counts are halved until none does."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        order = used[counts[used].argsort(kind="stable")]
        n = len(order)
        # Places from n on are inner nodes; what is not made yet, and what stands behind the last symbol, comes last.
        weights = [*counts[order].tolist(), *[_LAST] * n]
        parent = [0] * (2 * n - 1)
        leaf, inner = 0, n
        x, y = weights[0], _LAST
        for node in range(n, 2 * n - 1):
            if x <= y:
                total = x
                parent[leaf] = node
                leaf += 1
                x = weights[leaf] if leaf < n else _LAST
            else:
                total = y
                parent[inner] = node
                inner += 1
                y = weights[inner]
            if x <= y:
                total += x
                parent[leaf] = node
                leaf += 1
                x = weights[leaf] if leaf < n else _LAST
            else:
                total += y
                parent[inner] = node
                inner += 1
                y = weights[inner]
            weights[node] = total
            if inner == node:
                y = total
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= most:
            lengths[order] = depth[:n]
            return lengths
        counts = (counts + 1) >> 1


def _codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, how many) of each symbol."""
    value, size = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    order, sizes, shares = canonical(lengths)
    value[order] = turned(int(sizes[-1]))[shares.cumsum() - shares]
    size[order] = sizes
    return value, size


#: The code of code lengths that the writer uses: four bits, five for the rare ones; its description and its bits.
_LENGTHS = [5 if s in (1, 11, 12, 13, 14, 15) else 4 for s in range(19)]
_LENGTHS_HEAD = (15 << 1 | sum(_LENGTHS[s] << (5 + 3 * k) for k, s in enumerate(LENGTH_ORDER)), 63)
_LENGTH_BITS = _codes(np.array(_LENGTHS))
_LENGTH_LISTS = [x.tolist() for x in _LENGTH_BITS]
_RUNS = {True: ((16, 3, 6, 2),), False: ((18, 11, 138, 7), (17, 3, 10, 3))}


@functools.cache
def _run(length: int, n: int) -> list[tuple[int, int]]:
    """The tokens of a run of n equal code lengths, at most 63 bits in each; not to be changed."""
    value, size = (x[length] for x in _LENGTH_LISTS)
    put = [(value, size)] if length else []
    n -= len(put)
    for s, least, greatest, extra in _RUNS[length > 0]:
        while n >= least:
            take = min(n, greatest)
            put.append((_LENGTH_LISTS[0][s] | (take - least) << _LENGTH_LISTS[1][s], _LENGTH_LISTS[1][s] + extra))
            n -= take
    out = [(0, 0)]
    for more, k in [*put, *[(value, size)] * n]:
        if out[-1][1] + k > 63:
            out.append((0, 0))
        v, at = out[-1]
        out[-1] = (v | more << at, at + k)
    return out


@functools.lru_cache(10_000)
def _codes_of(n: int, *symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """_codes() of one or two symbols of n; not to be changed."""
    lengths = np.zeros(n, np.int64)
    lengths[list(symbols)] = 1
    return _codes(lengths)


def _write_code(out: Tokens, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Describes a code for symbols of these counts; returns the symbols' bits."""
    used = counts.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first, *second = used.tolist() or [0]
        out.add(1 | len(second) << 1 | 1 << 2 | first << 3, 11)
        if second:
            out.add(second[0], 8)
        return _codes_of(len(counts), first, *second)
    lengths = code_lengths(counts)
    out.add(*_LENGTHS_HEAD)
    used = lengths.nonzero()[0]
    put, end, before, times = out.few, 0, 0, 0
    for at, length in zip(used.tolist(), lengths[used].tolist(), strict=True):
        if at == end and length == before:
            times += 1
        else:
            if times:
                put += _run(before, times)
            if at > end:
                put += _run(0, at - end)
            before, times = length, 1
        end = at + 1
    put += _run(before, times)
    if end < len(lengths):
        put += _run(0, len(lengths) - end)
    return _codes(lengths)


def _symbol(v: int) -> tuple[int, int, int]:
    """(symbol, extra bits, how many) of a length or distance code."""
    if v <= 4:
        return v - 1, 0, 0
    extra = (v - 1).bit_length() - 2
    return 2 * extra + 2 + ((v - 1) >> extra & 1), (v - 1) & ((1 << extra) - 1), extra


_KEY = np.uint64(0xFFFFFFFFFFFF0000)


def references(p: np.ndarray, least: int = 4, most: int = 4096) -> list[tuple[int, int, int]]:
    """(place, length, distance) of stretches that stand at an earlier place too, from left to right: runs of places whose next `least` pixels
    last stood the same distance back."""
    if len(p) <= least:
        return []
    n = len(p) - least + 1
    key = p[:n].astype(np.uint64)
    for k in range(1, least):
        key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ p[k : n + k]
    # The key's first 48 bits are sorted with the place behind them, of which an image has at most 2^16.
    key = (key * np.uint64(0x9E3779B97F4A7C15)) & _KEY | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & ~_KEY).view(np.int64)
    key &= _KEY
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return []
    here, before = order[same + 1], order[same]
    true = np.ones(len(here), bool)
    for k in range(least):
        true &= p[here + k] == p[before + k]
    far = np.zeros(n, np.int64)
    far[here[true]] = (here - before)[true]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(far)) + 1, [n]])
    found, end = [], 0
    starts, stops = edges[:-1], edges[1:]
    keep = far[starts] > 0
    for a, b, d in zip(starts[keep].tolist(), stops[keep].tolist(), far[starts[keep]].tolist(), strict=True):
        a, b = max(a, end), b + least - 1
        while b - a >= least:
            found.append((a, min(b - a, most), d))
            a += found[-1][1]
            end = a
    return found


def cache_hits(p: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the pixel stands in the colour cache, its cell)."""
    cell = (p * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
    order = cell.astype(np.uint16).argsort(kind="stable")
    hit = np.zeros(len(p), bool)
    hit[order[1:]] = p[order[1:]] == p[order[:-1]]  # equal colours have equal cells
    return hit, cell.astype(np.int64)


@functools.cache
def _near(width: int) -> dict[int, int]:
    """The short codes of distances."""
    return {d: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if (d := x + y * width) > 0}


def _channel_counts(channels: np.ndarray, some: np.ndarray) -> np.ndarray:
    """How often each value stands in each of three channels at some of the pixels."""
    return np.bincount((channels.compress(some, 1) + _TWELVE[:3]).ravel(), minlength=3 * 256).reshape(3, 256)


def _write_image(out: Tokens, p: np.ndarray, width: int, main: bool, cache_bits: int = 0) -> None:
    """Pixels (ARGB numbers) with back-references and, where it pays, the colour cache of cache_bits."""
    found = references(p) if main else []
    literal = np.ones(len(p), bool)
    for a, length, _ in found:
        literal[a : a + length] = False
    channels = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4).T[[1, 2, 0, 3]].astype(np.int64)  # green, red, blue, alpha
    hit = np.zeros(len(p), bool)
    if cache_bits:
        hit, cell = cache_hits(p, cache_bits)
        hit &= literal
        share = hit.sum() / max(1, literal.sum())
        bits = _entropy(_channel_counts(channels[:3], literal)).sum()
        used = np.count_nonzero(np.bincount(cell[hit]))
        gain = hit.sum() * (bits / max(1, literal.sum()) - np.log2(max(1, used)) + np.log2(share)) + (literal & ~hit).sum() * np.log2(1 - share) - 6 * used if 0 < share < 1 else 0.0
        if gain <= CACHE_GAIN * bits:
            hit[:], cache_bits = False, 0
    plain = literal & ~hit
    symbol = np.where(hit, cell + 280, channels[0]) if cache_bits else channels[0].copy()
    near = _near(width)
    sizes = [_symbol(length) for _, length, _ in found]
    far = [_symbol(near.get(d, d + 120)) for _, _, d in found]
    begins = np.array([a for a, _, _ in found], np.int64)
    symbol[begins] = np.array([256 + s for s, _, _ in sizes], np.int64)
    first = literal.copy()
    first[begins] = True
    counts = [np.bincount(symbol[first], minlength=280 + ((1 << cache_bits) if cache_bits else 0)), *_channel_counts(channels[1:], plain)]
    out.add(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.add(0, 1)
    codes = [_write_code(out, c) for c in counts]
    of_distance = _write_code(out, np.bincount([s for s, _, _ in far], minlength=40) if far else np.zeros(40, np.int64))
    value, size = codes[0][0][symbol], codes[0][1][symbol]
    for (bits, n), c in zip(codes[1:], channels[1:], strict=True):
        if not n.any():  # one symbol, which takes no bits
            continue
        value |= np.where(plain, bits[c], np.uint64(0)) << size.astype(np.uint64)
        size = size + np.where(plain, n[c], 0)
    if found:
        (_, extra, n), (s, more, m) = np.array(sizes, np.int64).T, np.array(far, np.int64).T
        at = size[begins]
        v = value[begins] | extra.astype(np.uint64) << at.astype(np.uint64)
        at = at + n
        v |= of_distance[0][s] << at.astype(np.uint64)
        at += of_distance[1][s]
        value[begins], size[begins] = v | more.astype(np.uint64) << at.astype(np.uint64), at + m
    out.extend(value[first], size[first])


@functools.cache
def _count_bits() -> np.ndarray:
    """n log2 n of all numbers of pixels that an image can have."""
    n = np.arange(MOST_ROWS * WIDTH + 1)
    return n * np.log2(np.maximum(n, 1))


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits of the symbols counted in each row by an ideal code, and six for each symbol that its description takes."""
    bits = _count_bits()
    return bits[counts.sum(-1)] - bits.take(counts, mode="clip").sum(-1) + 6 * np.count_nonzero(counts, -1)


#: Bits of the colour cache, and the share of the pixels' bits that it has to save.
CACHE_BITS, CACHE_GAIN = 8, 0.05
#: Where the counts of each channel of each form begin among all.
_TWELVE = 256 * np.arange(12)[:, None]


def _write_stream(p: np.ndarray) -> bytes:
    """A lossless stream of (height, WIDTH) ARGB numbers in the form that is estimated to be smallest."""
    height, n = len(p), p.size
    out = Tokens()
    out.add(0x2F, 8)
    out.add((WIDTH - 1) | (height - 1) << 14, 32)
    flat = p.reshape(-1)
    ordered = np.sort(flat)
    colours = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]
    c = np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(height, WIDTH, 4)[..., 2::-1].transpose(2, 0, 1)  # red, green, blue
    forms = np.empty((4, 3, height, WIDTH), np.uint8)
    left, above, no_green, plain = forms
    for form in forms:
        form[:] = c
    left[..., 1:] -= c[..., :-1]
    left[:, 1:, 0] -= c[:, :-1, 0]
    above[:, 1:] -= c[:, :-1]
    above[:, 0, 1:] -= c[:, 0, :-1]
    no_green[::2] -= c[1]
    counts = np.bincount((forms.reshape(12, n) + _TWELVE).reshape(-1), minlength=12 * 256).reshape(4, 3, 256)
    costs = _entropy(counts).sum(1)
    if len(colours) <= 256:
        pack = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        cost = 24 * len(colours) + _entropy(np.unique(flat, return_counts=True)[1]) if not pack else 24 * len(colours) + n * (8 >> pack)
        if cost <= costs.min():
            index = np.searchsorted(colours, flat)
            out.add(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
            steps = np.diff(_split(colours), axis=0, prepend=0)
            _write_image(out, _join(steps), len(colours), False)
            out.add(0, 1)
            index, wide = index.reshape(height, WIDTH), WIDTH >> pack
            if pack:
                index = (index.reshape(height, wide, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(-1)
            _write_image(out, index.reshape(-1).astype(np.uint32) << np.uint32(8) | np.uint32(255 << 24), wide, True)
            return out.bytes()
    best = int(costs.argmin())
    if best < 2:
        out.add(1 | 0 << 1 | 7 << 3, 6)
        modes = np.full(-(-height // 512), (best + 1) << 8 | 255 << 24, np.uint32)
        _write_image(out, modes, 1, False)
    elif best == 2:
        out.add(1 | 2 << 1, 3)
    out.add(0, 1)
    red, green, blue = forms[best].reshape(3, n).astype(np.uint32)
    alpha = np.uint32(0 if best < 2 else 255 << 24)  # a difference to the pixel before is none in alpha, the first pixel's too
    _write_image(out, red << np.uint32(16) | green << np.uint32(8) | blue | alpha, WIDTH, True, CACHE_BITS)
    return out.bytes()


def wrap(stream: bytes) -> bytes:
    """A VP8L stream as a WebP file of even length."""
    stream += b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream


def encode(data: bytes) -> bytes:
    """Bytes, a multiple of 192, as images of 64 RGB pixels a row."""
    out = []
    for k in range(0, len(data), MOST_ROWS * ROW):
        rgb = np.frombuffer(data[k : k + MOST_ROWS * ROW], np.uint8).reshape(-1, WIDTH, 3)
        argb = np.full((len(rgb), WIDTH, 4), 255, np.uint8)
        argb[..., :3] = rgb[..., ::-1]
        out.append(wrap(_write_stream(argb.view("<u4")[..., 0])))
    return b"".join(out)


def decode(content: bytes) -> bytes:
    """The RGB bytes of images that stand one behind the other."""
    parts = []
    for p in images(content):
        parts.append(np.ascontiguousarray(p, "<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].tobytes())
    return b"".join(parts)


def feature(pixels: bytes) -> str:
    """Rows, and for red, green and blue the mean and the mean step from one pixel to the next, in thousandths."""
    rgb = np.ascontiguousarray(np.frombuffer(pixels, np.uint8).reshape(-1, 3).T, np.int16)
    n = rgb.shape[1]
    mean = rgb.sum(1, np.int64) * 1000 // n
    step = np.abs(rgb[:, 1:] - rgb[:, :-1]).sum(1, np.int64) * 1000 // max(1, n - 1)
    return f"rows={n // WIDTH};mean={','.join(map(str, mean))};step={','.join(map(str, step))}"


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
            texts = [x.as_py() for x in batch.column(1)]
            media = [encode(t + b" " * (max(1, -(-len(t) // ROW)) * ROW - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
            pixels = [decode(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pixels, pa.binary()), pa.array([feature(p) for p in pixels], pa.string())], names=PIXEL_SCHEMA.split()[::2])


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media table (doc_id, n_bytes, media) in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), payload(text_col).alias("text"))
    return materialize(rows.mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary"), "media")


def read_media(media: DataFrame) -> DataFrame:
    """PIXEL_SCHEMA: each row's stored bytes, its pixels (RGB) and a feature of them."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode_batches, PIXEL_SCHEMA)
