"""Hashed words and byte n-grams of many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes of text hashed at once

# lower-cases A-Z, keeps a-z and every byte above ASCII, and turns the rest to spaces
LETTERS = np.full(256, 32, np.uint8)
LETTERS[128:] = np.arange(128, 256)
LETTERS[97:123] = LETTERS[65:91] = np.arange(97, 123)
# keeps every byte but white space, lower-cases A-Z
NOT_SPACE = np.arange(256, dtype=np.uint8)
NOT_SPACE[65:91] += 32
NOT_SPACE[[9, 10, 11, 12, 13]] = 32

MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x100000001B3  # odd, so that it has an inverse modulo 2^64
UNBASE = pow(BASE, -1, 1 << 64)


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about SLICE bytes (a longer text is a run of its own), with their first index."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > SLICE:
            yield at, texts[at:i]
            at, total = i, 0
        total += len(t)
    yield at, texts[at:]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[bytes], table: np.ndarray = LETTERS, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every word in order; a hash depends on the word's bytes alone.  Then, for each length in
    prefixes, the same of the first bytes of longer words (other hashes than those of words)."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = table[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = raw != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    # sums of byte * BASE^position, wrapping; a word's sum is divided by BASE^start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(raw)), dtype=np.uint64)])
    back = _powers(UNBASE, len(raw) + 1)[start]
    owner = np.searchsorted(np.cumsum(sizes), start, side="right")
    owners, values = [owner], [(sums[end] - sums[start]) * back]
    for n in prefixes:
        longer = end - start > n
        owners.append(owner[longer])
        values.append((sums[start[longer] + n] - sums[start[longer]]) * back[longer] ^ np.uint64(n * 0x2545F4914F6CDD1D % (1 << 64)))
    value = np.concatenate(values)
    value ^= value >> np.uint64(29)
    value *= MIX
    value ^= value >> np.uint64(32)
    return np.concatenate(owners), value


def trigrams(text: bytes, bits: int) -> np.ndarray:
    """Buckets of the byte trigrams of the text's letters, with a space at both ends."""
    b = LETTERS[np.frombuffer(b" " + text + b" ", np.uint8)].astype(np.uint32)
    keep = (b != 32) | np.concatenate([[True], b[:-1] != 32])  # runs of spaces become one
    b = b[keep]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - bits)).astype(np.int64)
