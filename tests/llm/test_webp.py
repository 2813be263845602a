"""The reader against images written here with every feature of the format."""

import itertools
import os
import random

import numpy as np
import pytest

from quarry.llm import webp as W


class BitList:
    """Bits to write, the first in the lowest place of the first byte."""

    def __init__(self):
        self.bits = []

    def add(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]
        return self



def code_lengths(symbols):
    """Complete lengths for the symbols: 1, 2, 3, ... and the last two equal."""
    symbols = sorted(symbols)
    return {s: min(k + 1, len(symbols) - 1) for k, s in enumerate(symbols)} if len(symbols) > 1 else {symbols[0]: 0}


class Code:
    def __init__(self, bits, symbols, alphabet):
        symbols = sorted(set(symbols))[:]
        if len(symbols) <= 2 and symbols[-1] < 256:
            bits.add(1, 1).add(len(symbols) - 1, 1).add(1, 1).add(symbols[0], 8)
            if len(symbols) == 2:
                bits.add(symbols[1], 8)
            self.codes = {symbols[0]: (0, len(symbols) - 1)} | ({symbols[1]: (1, 1)} if len(symbols) == 2 else {})
            return
        if len(symbols) > 15:  # all of one length
            size = 1 << (len(symbols) - 1).bit_length()
            spare = [s for s in range(alphabet) if s not in symbols]
            symbols = sorted([*symbols, *spare[: size - len(symbols)]])
            lengths = dict.fromkeys(symbols, size.bit_length() - 1)
        else:
            lengths = code_lengths(symbols)
        bits.add(0, 1).add(15, 4)
        for _ in range(19):
            pass
        for s in W.LENGTH_ORDER:
            bits.add(4 if s < 16 else 0, 3)
        bits.add(0, 1)
        for s in range(alphabet):
            bits.bits += [int(b) for b in f"{lengths.get(s, 0):04b}"]
        self.codes, code, last = {}, 0, 0
        for n, s in sorted((n, s) for s, n in lengths.items()):
            code <<= n - last
            last = n
            self.codes[s] = (code, n)
            code += 1

    def put(self, bits, s):
        code, n = self.codes[s]
        bits.bits += [int(b) for b in f"{code:0{n}b}"] if n else []


def prefix(value):
    for s in range(40):
        extra = max(0, (s - 2) >> 1) if s >= 4 else 0
        low = s + 1 if s < 4 else ((2 + (s & 1)) << extra) + 1
        if low <= value < low + (1 << extra):
            return s, value - low, extra
    raise AssertionError(value)


def put_image(bits, pixels, main, cache_bits=0, refs=False, groups=False):
    """Entropy-coded pixels, also with a colour cache, back-references and two groups of codes."""
    height, width = pixels.shape
    flat = [int(p) for p in pixels.reshape(-1)]
    bits.add(int(cache_bits > 0), 1)
    if cache_bits:
        bits.add(cache_bits, 4)
    meta = None
    if main:
        bits.add(int(groups), 1)
        if groups:
            bits.add(0, 3)
            side = ((height + 3) // 4, (width + 3) // 4)
            meta = np.arange(side[0] * side[1]).reshape(side) % 2
            put_image(bits, meta.astype(np.uint32) << 8, False)
    ops, cache, at = [], {}, 0
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        run = 0
        for back in (1, width, width + 1, 200):
            n = 0
            while refs and back <= at and at + n < len(flat) and flat[at + n] == flat[at + n - back]:
                n += 1
            if n > run:
                run, best = n, back
        if run >= 3:
            near = [k for k, (x, y) in enumerate(W.NEAR) if max(1, x + y * width) == best]
            ops.append((at, "ref", run, near[0] + 1 if near else best + 120))
        elif cache_bits and cache.get(slot(flat[at])) == flat[at]:
            run = 1
            ops.append((at, "cache", slot(flat[at]), 0))
        else:
            run = 1
            ops.append((at, "pixel", flat[at], 0))
        for p in flat[at : at + run]:
            if cache_bits:
                cache[slot(p)] = p
        at += run
    of = lambda at: int(meta[(at // width) >> 2, (at % width) >> 2]) if meta is not None else 0
    codes = []
    for g in range(2 if groups and meta.max() else 1):
        used = [[], [], [], [], []]
        for at, kind, a, b in ops:
            if of(at) != g:
                continue
            if kind == "pixel":
                for k, shift in enumerate((8, 16, 0, 24)):
                    used[k].append(a >> shift & 255)
            elif kind == "cache":
                used[0].append(280 + a)
            else:
                used[0].append(256 + prefix(a)[0])
                used[4].append(prefix(b)[0])
        codes.append([Code(bits, u or [0], n) for u, n in zip(used, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True)])
    for at, kind, a, b in ops:
        c = codes[of(at)]
        if kind == "pixel":
            for k, shift in enumerate((8, 16, 0, 24)):
                c[k].put(bits, a >> shift & 255)
        elif kind == "cache":
            c[0].put(bits, 280 + a)
        else:
            for k, v, base in ((0, a, 256), (4, b, 0)):
                s, rest, extra = prefix(v)
                c[k].put(bits, base + s)
                bits.add(rest, extra)


def stream(width, height):
    return BitList().add(0x2F, 8).add(width - 1, 14).add(height - 1, 14).add(1, 1).add(0, 3)


def pack(bits):
    return np.packbits(np.array(bits.bits, np.uint8), bitorder="little").tobytes()


def picture(width, height, colours=40, seed=0):
    rng = random.Random(seed)
    few = [rng.getrandbits(32) for _ in range(colours)]
    flat = []
    while len(flat) < width * height:
        flat += rng.choice([[rng.choice(few)] * rng.randint(1, 9), flat[-rng.randint(1, 60) :][: rng.randint(1, 40)] or [few[0]]])
    return np.array(flat[: width * height], np.uint32).reshape(height, width)


@pytest.mark.parametrize(("cache", "refs", "groups"), [(0, False, False), (0, True, False), (4, False, False), (3, True, True), (0, False, True)])
def test_entropy(cache, refs, groups):
    p = picture(23, 17, seed=cache)
    bits = stream(23, 17).add(0, 1)
    put_image(bits, p, True, cache, refs, groups)
    assert (W.decode_stream(pack(bits)) == p).all()


def test_predictor():
    p = picture(19, 18, 300)
    side = (5, 5)
    modes = np.arange(25).reshape(side) % 14
    c = W._split(p)
    residual = c.copy()
    for y in range(18):
        for x in range(19):
            if y == 0:
                guess = c[y, x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = c[y - 1, 0]
            else:
                right = c[y - 1, x + 1] if x + 1 < 19 else c[y, 0]
                guess = W.predict(int(modes[y >> 2, x >> 2]), c[y, x - 1].tolist(), c[y - 1, x].tolist(), c[y - 1, x - 1].tolist(), right.tolist())
            residual[y, x] = (c[y, x] - np.array(guess)) & 255
    bits = stream(19, 18).add(1, 1).add(0, 2).add(0, 3)
    put_image(bits, modes.astype(np.uint32) << 8, False)
    bits.add(0, 1)
    put_image(bits, W._join(residual), True)
    assert (W.decode_stream(pack(bits)) == p).all()


def test_prediction_modes():
    left, top, corner, right = [10, 200, 3, 4], [20, 100, 255, 0], [30, 50, 7, 9], [40, 60, 0, 255]
    want = {0: [255, 0, 0, 0], 1: left, 2: top, 3: right, 4: corner, 5: [22, 115, 128, 64], 6: [20, 125, 5, 6], 7: [15, 150, 129, 2], 8: [25, 75, 131, 4], 9: [30, 80, 127, 127], 12: [0, 250, 251, 0], 13: [8, 200, 190, 0]}
    for mode, guess in want.items():
        assert W.predict(mode, left, top, corner, right) == guess, mode


def test_colours():
    p = picture(12, 9, 200)
    c = W._split(p)
    factors = np.array([[0x00F30512 + k * 3 for k in range(3)] for _ in range(3)], np.uint32)
    f = W._signed(W._split(factors)[np.arange(9)[:, None] >> 2, np.arange(12)[None] >> 2])
    green, red = W._signed(c[..., 2]), W._signed(c[..., 1])
    moved = c.copy()
    moved[..., 3] -= ((f[..., 2] * green) >> 5) + ((f[..., 1] * red) >> 5)
    moved[..., 1] -= (f[..., 3] * green) >> 5
    moved &= 255
    moved[..., 1] -= moved[..., 2]
    moved[..., 3] -= moved[..., 2]
    bits = stream(12, 9).add(1, 1).add(1, 2).add(0, 3)
    put_image(bits, factors, False)
    bits.add(1, 1).add(2, 2).add(0, 1)
    put_image(bits, W._join(moved), True, 2, True)
    assert (W.decode_stream(pack(bits)) == p).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 13, 100])
def test_palette(colours):
    palette = np.array([random.Random(k).getrandbits(32) for k in range(colours)], np.uint32)
    index = np.random.default_rng(colours).integers(0, colours, (7, 13))
    pack_bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each, wide = 8 >> pack_bits, -(-13 // (1 << pack_bits))
    packed = np.zeros((7, wide), np.uint32)
    for x in range(13):
        packed[:, x >> pack_bits] |= (index[:, x] << (each * (x & (1 << pack_bits) - 1))).astype(np.uint32)
    deltas = W._join(np.diff(W._split(palette), axis=0, prepend=0))
    bits = stream(13, 7).add(1, 1).add(3, 2).add(colours - 1, 8)
    put_image(bits, deltas[None], False)
    bits.add(0, 1)
    put_image(bits, packed << np.uint32(8), True)
    assert (W.decode_stream(pack(bits)) == palette[index]).all()


def test_round_trip():
    for n in (1, 5, W.MOST_ROWS + 3):
        data = os.urandom(192 * n)
        assert W.decode(W.encode(data)) == data
    with pytest.raises(W.WebpError):
        W.decode(W.encode(b" " * 192)[:-20])
    with pytest.raises(W.WebpError):
        W.decode(b"no image at all, not even one of these")


def transforms(content):
    """Kinds of the first transform of each image, and whether its pixels use a colour cache."""
    found, at = [], 0
    while at < len(content):
        bits = W.Bits(content[at + 20 :])
        bits.read(40)
        found.append(bits.read(2) if bits.read(1) else None)
        at += 8 + int.from_bytes(content[at + 4 : at + 8], "little")
    return found


def test_writer_forms():
    """The writer takes each of its forms where it fits, and the reader undoes it."""
    rng = np.random.default_rng(3)
    ramp = (np.cumsum(rng.integers(0, 3, (40, 192)), 1) % 256).astype(np.uint8)
    across = np.repeat(rng.integers(0, 256, (1, 64, 3)), 40, 0) + rng.integers(0, 2, (40, 64, 3))
    green = rng.integers(0, 256, (40, 64, 1)) + rng.integers(0, 2, (40, 64, 3)) * [1, 0, 1]
    text = " ".join(map(str, rng.integers(0, 10**9, 900))).encode()
    cases = {"left": (ramp.tobytes(), 0), "above": (across.astype(np.uint8).tobytes(), 0), "green": (green.astype(np.uint8).tobytes(), 2), "two colours": (b"ab" * 96 * 3, 3), "palette": (rng.integers(0, 256, (40, 3))[rng.integers(0, 40, 640)].astype(np.uint8).tobytes(), 3), "plain": (text[: len(text) // 192 * 192], None)}
    for name, (data, kind) in cases.items():
        media = W.encode(data)
        assert W.decode(media) == data and len(media) < len(data), name
        assert transforms(media) == [kind], name


def test_references_and_cache():
    p = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 9, 9, 9, 9, 9, 9, 9], np.uint32)
    assert W.references(p) == [(5, 4, 5), (10, 6, 1)]
    hit, cell = W.cache_hits(np.array([7, 8, 7, 7], np.uint32), 8)
    assert hit.tolist() == [False, False, True, True] and cell[0] == cell[2]
    rng = np.random.default_rng(4)
    for size in (2, 3, 20, 300):
        counts = rng.integers(0, 50, size) ** 3 + 1
        lengths = W.code_lengths(counts, 12)
        assert lengths.max() <= 12 and (0.5 ** lengths[lengths > 0]).sum() == 1
    fib = [1, 1]
    while len(fib) < 30:
        fib.append(fib[-1] + fib[-2])
    assert W.code_lengths(np.array(fib), 15).max() <= 15


@pytest.mark.parametrize("seed", range(6))
def test_round_trip_of_texts(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(1, 9, 60)] + ["é", "漢字", "\n", "\0"]
    for n in (0, 1, 30, 400, 3000):
        text = " ".join(words[k] for k in rng.integers(0, len(words), n)).encode()
        text += text[: len(text) // 3] * int(rng.integers(0, 3))
        data = text + b" " * (max(1, -(-len(text) // 192)) * 192 - len(text))
        media = W.encode(data)
        assert W.decode(media) == data and W.encode(data) == media


def test_bits_are_packed_in_words():
    """Tokens of no bits, of 63 and across the borders of words, as a plain string of bits has them."""
    deal = random.Random(9)
    for n in (1, 2, 40, 700):
        sizes = [deal.choice([0, 1, 5, 8, 31, 32, 33, 63]) for _ in range(n)] + [3]
        values = [deal.getrandbits(k) if k else 0 for k in sizes]
        out = W.Tokens()
        out.add(values[0], sizes[0])
        out.extend(np.array(values[1:], np.uint64), np.array(sizes[1:], np.int64))
        whole = sum(v << at for v, at in zip(values, itertools.accumulate([0, *sizes]), strict=False))
        assert out.bytes() == whole.to_bytes((sum(sizes) + 7) // 8, "little")


def test_codes_of_few_symbols_are_made_once():
    """Every image has codes of one symbol (alpha, distances): the writer and the reader make each of them once, not once an image."""
    texts = [bytes(random.Random(k).randrange(32, 127) for _ in range(192 * 30)) for k in range(12)]
    W._codes_of.cache_clear()
    W._code_of_symbols.cache_clear()
    assert [W.decode(W.encode(t)) for t in texts] == texts
    assert W._codes_of.cache_info().misses < len(texts) <= W._codes_of.cache_info().hits
    assert W._code_of_symbols.cache_info().misses < len(texts) <= W._code_of_symbols.cache_info().hits


@pytest.mark.parametrize("alphabet", [40, 256, 280, 536])
def test_code_lengths_are_read_several_at_once(alphabet):
    """Descriptions of codes with gaps, runs and single lengths are few tokens, and read back to their last bit."""
    rng = np.random.default_rng(alphabet)
    dense, sparse = rng.integers(1, 9, alphabet), np.where(rng.random(alphabet) < 0.1, rng.integers(1, 10**4, alphabet), 0)
    first, last = np.zeros(alphabet, np.int64), np.zeros(alphabet, np.int64)
    first[:5], last[-5:] = range(1, 6), range(1, 6)
    for counts in (np.ones(alphabet, np.int64), dense, sparse + (np.arange(alphabet) < 3), first, last, 1 << np.minimum(np.arange(alphabet), 14)):
        out = W.Tokens()
        W._write_code(out, counts)
        assert len(out.few) <= 1 + 2 * np.count_nonzero(counts)
        size = sum(n for _, n in out.few)
        bits = W.Bits(out.bytes() + b"\xa5" * 8)
        found = W.read_code(bits, alphabet)
        assert bits.at == size
        assert (found.table == W.PrefixCode(W.code_lengths(counts)).table).all()
    assert any(W._code_of_lengths(tuple(W._LENGTHS)).several)
