"""Hashes of the words of many texts at once, as array operations over their bytes.

Words are runs of bytes other than space and 0x09-0x0D. A word's hash is a polynomial of random 64-bit
numbers, one for each byte value, taken from running sums over the buffer and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed together; longer texts are cut between words.
CHUNK = 1 << 20
U = np.uint64
SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_BASE = int(_random.integers(1, 1 << 61)) * 8 + 5
_WHITE = np.zeros(256, bool)
_WHITE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(2 * CHUNK + 2, base, U)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _hash(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a buffer that ends in white space, and where they start."""
    up, down = _tables()
    buf = np.frombuffer(data, np.uint8)
    white = _WHITE[buf]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    if not white[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about CHUNK bytes, cut at white space; a word over twice as long is hashed by itself."""
    at = 0
    while len(text) - at > CHUNK:
        cut = max(text.rfind(bytes([s]), at, at + CHUNK) for s in SPACES)
        if cut < 0:
            found = [i for i in (text.find(bytes([s]), at + CHUNK) for s in SPACES) if i >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def _long(text: bytes) -> np.ndarray:
    out = []
    for p in _pieces(text):
        if len(p) <= 2 * CHUNK:
            out.append(_hash(p + b" ")[0])
        else:
            import xxhash

            out.append(np.array([xxhash.xxh3_64_intdigest(w) for w in p.split()], U))
    return np.concatenate(out)


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in order."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            yield _long(texts[i])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) + 1 <= CHUNK + 1:
            size += len(texts[j]) + 1
            j += 1
        hashes, starts = _hash(b" ".join(texts[i:j]) + b" ")
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        cuts = np.searchsorted(starts, ends)
        a = 0
        for b in cuts.tolist():
            yield hashes[a:b]
            a = b
        i = j


def windows(words: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``n`` words: a polynomial, mixed."""
    if len(words) < n:
        return words[:0]
    if n <= 8:
        out = words[: len(words) - n + 1]
        for j in range(1, n):
            out = out * U(factor) + words[j : len(words) - n + 1 + j]
        return mix(out)
    out = np.zeros(len(words) - n + 1, U)
    # By doubling: runs of 1, 2, 4, ... words, joined for the bits of n.
    run, size, done, power = words, 1, 0, factor
    while True:
        if n & size:
            out = out * U(power) + run[done : done + len(out)]
            done += size
        if done == n:
            return mix(out)
        run = mix(run[:-size] * U(power) + run[size:])
        size *= 2
        power = power * power % (1 << 64) | 1
