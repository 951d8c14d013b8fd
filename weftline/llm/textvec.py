"""Words of many texts at once, as 64-bit hashes, with numpy only.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 are the words
`[^\\x20\\x09-\\x0D]+` of the text. A word's hash is the sum of its mixed blocks of eight bytes, each
keyed by its place, mixed with the length: not linear in the bytes, so no pattern of letters makes
words collide. A second, independent hash of each word comes from other keys. Texts are cut into
chunks of fixed size, so the memory beyond one hash and one position a word doesn't grow with a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C13
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers of a seed."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)) + np.uint64(seed * 0x2545F4914F6CDD1D & _M))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Low bytes of a block that belong to a word of which so many bytes are left.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Keys of the two hashes: of a block's place, of the length.
_SEEDS = stream(4, 1).reshape(2, 2)


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one a word
    starts: np.ndarray  # byte position of each word
    lengths: np.ndarray  # bytes of each word
    offsets: np.ndarray  # words before each text; one more than there are texts
    others: np.ndarray | None = None  # a second hash of each word, if wanted

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each word."""
    begins, ends = [], []
    open_ = False  # the last byte seen belongs to a word
    for at in range(0, len(data), CHUNK):
        solid = ~SPACE[data[at : at + CHUNK]]
        n = len(solid)
        first = np.zeros(n + 1, bool)  # of a text
        first[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n, "right")] - at] = True
        before = np.concatenate([[open_], solid[:-1]])
        begins.append(np.flatnonzero(solid & (~before | first[:-1])) + at)
        ends.append(np.flatnonzero(before & (~solid | first[:-1])) + at)
        open_ = bool(solid[-1])
    if open_:
        ends.append(np.array([len(data)]))
    starts = np.concatenate(begins).astype(np.int64) if begins else np.zeros(0, np.int64)
    return starts, (np.concatenate(ends).astype(np.int64) if ends else starts) - starts


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, two: bool = False) -> Words:
    """Words of the texts data[offsets[i]:offsets[i+1]]; with lower, A-Z hash as a-z; with two, others has a second hash."""
    starts, lengths = _places(data, offsets)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = _LOWER[data] if lower else data
    eight = np.ndarray(len(data) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from each position on
    seeds = _SEEDS[: 2 if two else 1]
    raw = [np.empty(len(starts), np.uint64) for _ in seeds]
    for lo in range(0, len(starts), CHUNK):
        cut = slice(lo, lo + CHUNK)
        block = eight[starts[cut]] & _KEEP[np.minimum(lengths[cut], 8)]
        for out, (place, _) in zip(raw, seeds, strict=True):
            out[cut] = mix(block ^ mix(np.array([place]))[0])
    long = np.flatnonzero(lengths > 8)
    ends = np.cumsum((lengths[long] - 1) // 8)  # blocks after the first, of all long words up to each
    for lo in range(0, int(ends[-1]) if len(long) else 0, CHUNK):
        flat = np.arange(lo, min(lo + CHUNK, int(ends[-1])))
        which = np.searchsorted(ends, flat, "right")
        word = long[which]
        k = flat - ends[which] + (lengths[word] - 1) // 8 + 1
        block = eight[starts[word] + 8 * k] & _KEEP[np.minimum(lengths[word] - 8 * k, 8)]
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        for out, (place, _) in zip(raw, seeds, strict=True):
            out[word[begin]] += np.add.reduceat(mix(block ^ mix(place + k.astype(np.uint64) * np.uint64(_BASE))), begin)
    done = [mix(out ^ mix(lengths.astype(np.uint64) + size)) for out, (_, size) in zip(raw, seeds, strict=True)]
    return Words(done[0], starts, lengths, np.searchsorted(starts, offsets).astype(np.int64), done[1] if two else None)


_FACTORS = [np.uint64(int(x) | 1) for x in stream(8, 2)]


def windows(w: Words, size: int = 3, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words, and the index of the first word of each."""
    h = w.hashes if hashes is None else hashes
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    text = w.text_of
    at = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
    out = mix(h[at] * _FACTORS[0])
    for k in range(1, size):
        out = mix(out + h[at + k] * _FACTORS[k])
    return out, at


def shingles(w: Words, size: int = 3, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of `size` words, repeats included, and offsets by text; one for a text of fewer words."""
    h = w.hashes if hashes is None else hashes
    n = w.counts
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    out = np.empty(offsets[-1], np.uint64)
    out[np.repeat(n >= size, count)] = windows(w, size, h)[0]
    for i in np.flatnonzero((n > 0) & (n < size)):
        one = np.array([n[i]], np.uint64)
        for k in range(n[i]):
            one = mix(one + h[w.offsets[i] + k] * _FACTORS[k])
        out[offsets[i]] = one[0]
    return out, offsets


def sums(flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the sum of flags[byte] (a table of 256 small numbers)."""
    n = len(offsets) - 1
    out = np.zeros(n, np.int64)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = np.add.reduceat(flags[data], offsets[some], dtype=np.int64)
    return out
