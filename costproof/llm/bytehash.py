"""Word and shingle hashes of many texts at once, as numpy operations over their UTF-8 bytes.

A word is read eight bytes at a time, each step a bijection of the state, so words of up to eight bytes and one length never
share a hash; words of more than ``CHAINED`` bytes are hashed by blake2b. There is no Python step per word but for those.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK, CHAINED = 1 << 20, 24
#: Words of at most so many bytes share a hash only with words of another length.
EXACT = 8
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, a different one for each seed."""
    x = x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on; ``data`` ends in eight bytes of padding."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)


def chunk(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next ``left`` bytes at places, eight at most, as numbers."""
    return np.ascontiguousarray(view[at]).view(np.uint64).ravel() & _MASKS[np.minimum(left, 8)]


def same(view: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes at two places are equal, for many pairs of places."""
    out, open_, k = np.ones(len(at), bool), np.arange(len(at)), 0
    while len(open_):
        equal = chunk(view, at[open_] + k, length[open_] - k) == chunk(other, other_at[open_] + k, length[open_] - k)
        out[open_[~equal]] = False
        k += 8
        open_ = open_[equal]
        open_ = open_[length[open_] > k]
    return out


def runs(texts: list[bytes], between: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes that ``between`` does not mark: (hashes, starts, ends, first run of each text and, last, their number, bytes).

    Starts and ends are places in the last array, which holds all texts with a blank behind each, and padding.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    joined = b" ".join(texts) + b" " if texts else b""
    buffer = np.frombuffer(joined + bytes(8), np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    space = between[buffer[: len(joined)]]
    before = np.concatenate(([True], space[:-1])) if len(space) else space
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(~before & space)
    return hashed(buffer, starts, ends), starts, ends, np.concatenate(([0], np.searchsorted(starts, np.cumsum(lengths)))), buffer


def hashed(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of many stretches of a padded buffer."""
    view, length = windows(buffer), ends - starts
    hashes = mix(length.astype(np.uint64), 5)
    open_, k = np.arange(len(starts)), 0
    while len(open_):
        hashes[open_] = mix(hashes[open_] ^ chunk(view, starts[open_] + k, length[open_] - k), k)
        k += 8
        open_ = open_[length[open_] > k] if k < CHAINED else open_[:0]
    for i in np.flatnonzero(length > CHAINED).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(buffer[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, first word of each text and, last, the number of words)."""
    found = runs(texts, _SPACE, lower)
    return found[0], found[3]


def between_blanks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``runs`` between blanks alone: other white space belongs to them."""
    return runs(texts, _BLANK)


def shingles(texts: list[bytes], k: int = 5, lower: bool = True) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence as one."""
    hashes, first = words(texts, lower)
    factor = np.uint64(0xC6A4A7935BD1E995)
    rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for i in range(k):
        rolled = rolled * factor + hashes[i : len(hashes) - k + 1 + i]
    rolled = mix(rolled, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = 0
            for h in hashes[a:b].tolist():
                short = (short * int(factor) + h) & _MASK
            out.append(mix(np.array([short], np.uint64), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches(texts: list[bytes], limit: int = 4 * BLOCK):
    """Ranges of texts of at most ``limit`` bytes together, or one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
