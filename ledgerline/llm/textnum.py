"""Word hashes as arrays: what a task does with a batch of texts at once, with numpy instead of a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A task works on about so many bytes of text at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
U = np.uint64
_BASE, _GOLD = U(0x9E3779B97F4A7C15 | 1), U(0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each bit depends on all."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def times(constant: int, n: int) -> np.uint64:
    """constant * n modulo 2^64."""
    return U((constant * n) & ((1 << 64) - 1))


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, row after the last, their UTF-8 bytes), null as empty."""
    first, raws, size = 0, [], 0
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if raws and size + len(raw) > limit:
            yield first, k, raws
            first, raws, size = k, [], 0
        raws.append(raw)
        size += len(raw)
    if raws:
        yield first, len(texts), raws


def hash_words(raws: list[bytes], lower: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and the offsets at which each text's words start (one more than texts). A word is
    taken in blocks of 8 bytes, each mixed with its number before they are added up; different seeds hash independently."""
    ends_at = np.cumsum([len(r) + 1 for r in raws])
    buf = np.frombuffer(b" ".join(raws) + b" " * 8, np.uint8)
    space = SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.searchsorted(starts, ends_at)])
    if not len(starts):
        return np.zeros(0, U), offsets
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    lengths = ends - starts
    blocks = (lengths + 7) // 8
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(starts, blocks) + 8 * number
    value = np.ndarray(len(buf) - 7, "<u8", buf.tobytes(), strides=(1,))[at].astype(U)
    over = np.maximum(8 * (number + 1) - np.repeat(lengths, blocks), 0).astype(U)  # bytes of the block behind the word
    value = (value << (U(8) * over)) + over
    tweak = mix(number.astype(U) + U(1) + times(0xA24BAED4963EE407, seed))
    h = np.add.reduceat(mix(mix(value ^ tweak) + tweak), first)
    return mix(h + lengths.astype(U) * _GOLD), offsets


def windows(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of width consecutive words that lies in one text, and where it starts, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    left = np.zeros(len(h), np.int64)  # words from here to the text's end
    sizes = np.diff(offsets)
    left[:] = np.repeat(offsets[1:], sizes) - np.arange(len(h))
    at = np.flatnonzero(left >= width)
    if width <= 8:
        g = np.zeros(len(at), U)
        for j in range(width):
            g = g * _GOLD + h[at + j]
    else:
        p = powers(len(h), _GOLD)
        total = np.concatenate([np.zeros(1, U), np.cumsum(h * p, dtype=U)])
        g = (total[at + width] - total[at]) * powers(len(h), inverse(_GOLD))[at]
    return mix(g + U(width)), at


def shingles(h: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in text order, and their offsets. A text with fewer words than width has its
    whole sequence as one; a text without words has none."""
    g, at = windows(h, offsets, width)
    sizes = np.diff(offsets)
    doc = np.searchsorted(offsets, at, side="right") - 1
    few = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(few):
        whole = np.zeros(len(few), U)
        for k, d in enumerate(few):
            for j in range(offsets[d], offsets[d + 1]):
                whole[k : k + 1] = whole[k : k + 1] * _GOLD + h[j]
        g = np.concatenate([g, mix(whole + U(1) + U(width) * sizes[few].astype(U))])
        doc = np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    _, first = np.unique(mix(g + (doc.astype(U) + U(1)) * _BASE), return_index=True)
    first.sort()
    g, doc = g[first], doc[first]
    return g, np.searchsorted(doc, np.arange(len(sizes) + 1))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values, modulo 2^64."""
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return total[offsets[1:]] - total[offsets[:-1]]
