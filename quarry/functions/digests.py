"""MD5 of many short words and word pairs at once: a step of the digest is done for all of them, in arrays."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Bytes of a word whose pairs surely fit one block of the digest (64 bytes with its end and length); those with longer words go one by one.
SHORT = 26
#: Digests that are worked on together, so that their state stays in the CPU's cache.
TOGETHER = 1 << 14
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_STEPS = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]


def _heads(blocks: np.ndarray) -> np.ndarray:
    """The first 64 bits of the MD5 of messages of one block each, (n, 64) bytes with their ends and lengths."""
    m = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(len(blocks), v, np.uint32) for v in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += m[_WORDS[i]]
        f += _STEPS[i]
        turn = _TURNS[i // 16][i % 4]
        np.right_shift(f, np.uint32(32 - turn), out=g)
        np.left_shift(f, np.uint32(turn), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()


def _head(message: bytes) -> int:
    return int.from_bytes(hashlib.md5(message, usedforsecurity=False).digest()[:8])


def md5_heads(words: list[bytes], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The first 64 bits of the MD5 of each word, then of each pair of words (numbers of words, first and second) with a blank between them."""
    sizes = np.array([len(w) for w in words], np.int64)
    short = sizes <= SHORT
    out = np.empty(len(words) + len(first), np.uint64)
    # A row holds a word and the bit that ends a message; what is behind it is zero.
    rows = np.frombuffer(b"".join([w[:SHORT].ljust(SHORT + 1, b"\0") for w in words]), np.uint8).reshape(-1, SHORT + 1).copy()
    rows[short.nonzero()[0], sizes[short]] = 0x80
    for j in (~short).nonzero()[0].tolist():
        out[j] = _head(words[j])
    plain = short.nonzero()[0]
    for at in range(0, len(plain), TOGETHER):
        some = plain[at : at + TOGETHER]
        blocks = np.zeros((len(some), 64), np.uint8)
        blocks[:, : SHORT + 1] = rows[some]
        blocks.view("<u8")[:, 7] = 8 * sizes[some]
        out[some] = _heads(blocks)
    both = short[first] & short[second]
    for j in (~both).nonzero()[0].tolist():
        out[len(words) + j] = _head(words[first[j]] + b" " + words[second[j]])
    # Pairs whose first words are of one length stand together, so that their second words begin at one place.
    plain = both.nonzero()[0]
    plain = plain[sizes[first[plain]].astype(np.uint8).argsort(kind="stable")]
    for at in range(0, len(plain), TOGETHER):
        some = plain[at : at + TOGETHER]
        ahead, behind, length = rows[first[some]], rows[second[some]], sizes[first[some]]
        blocks = np.zeros((len(some), 64), np.uint8)
        edges = [0, *((length[1:] != length[:-1]).nonzero()[0] + 1).tolist(), len(some)]
        for begin, end in zip(edges, edges[1:], strict=False):
            n = int(length[begin])
            blocks[begin:end, :n] = ahead[begin:end, :n]
            blocks[begin:end, n] = 0x20
            blocks[begin:end, n + 1 : n + SHORT + 2] = behind[begin:end]
        blocks.view("<u8")[:, 7] = 8 * (length + 1 + sizes[second[some]])
        out[len(words) + some] = _heads(blocks)
    return out
