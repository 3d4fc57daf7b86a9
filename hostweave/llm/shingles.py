"""Hashes of words and of word shingles, for whole batches of texts at once.

A word's hash is a polynomial of its bytes modulo 2**64 taken from a running sum
over the batch, then mixed with the word's length; a shingle's hash combines the
hashes of its words. Equal words always have equal hashes. Two different shingles
of a pair of documents collide with a probability of about 2**-64 for each
comparison, and results are exact up to that.
"""

import functools

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TILE = 1 << 20  # bytes hashed at once; longer texts are cut between words

#: The white space of ASCII, and that plus ASCII punctuation, as word separators.
SPACE = bytes([9, 10, 11, 12, 13, 32])
SPACE_AND_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


@functools.cache
def _letters() -> np.ndarray:
    """A random value for each byte, the same for A-Z and a-z."""
    values = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
    values[65:91] = values[97:123]
    return values


@functools.cache
def _separators(separators: bytes) -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[list(separators)] = True
    return found


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(n, _TILE + 1), base, dtype=_U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _tile(texts: list[bytes], apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = apart[data]
    edge = np.diff(np.concatenate([[True], gap]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _POWERS.upto(len(data))
    running = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_letters()[data] * up, out=running[1:])
    hashes = (running[ends] - running[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(_U) * _U(0x632BE59BD9B4E019))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, first))
    return hashes, counts


def _cut(text: bytes, separators: bytes) -> list[bytes]:
    """A long text in tiles that end between words."""
    parts, at, table = [], 0, _separators(separators)
    view = np.frombuffer(text, dtype=np.uint8)
    while len(text) - at > _TILE:
        gaps = np.flatnonzero(table[view[at:at + _TILE]])
        if len(gaps):
            end = at + int(gaps[-1]) + 1
        else:  # one very long word
            later = np.flatnonzero(table[view[at + _TILE:]])
            end = at + _TILE + int(later[0]) + 1 if len(later) else len(text)
        parts.append(text[at:end])
        at = end
    return [*parts, text[at:]]


def word_hashes(texts: list[bytes], separators: bytes = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z as a-z, and the number in each text."""
    apart = _separators(separators)
    if all(len(t) <= _TILE for t in texts):
        return _tile(texts, apart)
    hashes, counts = [], []
    for t in texts:
        got = [_tile([p], apart)[0] for p in _cut(t, separators)]
        hashes += got
        counts.append(sum(map(len, got)))
    return np.concatenate(hashes), np.array(counts, dtype=np.int64)


def shingle_hashes(
    words: np.ndarray, counts: np.ndarray, k: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words of each text, in order, and their numbers.

    A text of fewer words has its whole sequence as its only shingle, one
    without words has none.
    """
    numbers = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    if not len(words):
        return words, numbers
    first = np.cumsum(counts) - counts
    padded = np.concatenate([words, np.zeros(k, dtype=_U)])
    values = words.copy()
    for j in range(1, k):
        values = values * _U(_BASE) + padded[j:len(words) + j]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = _U(counts[i : i + 1].sum())
        value = np.full(1, own, dtype=_U)
        for w in words[first[i]:first[i] + counts[i]]:
            value = value * _U(_INVERSE) + w
        values[first[i]] = value[0]
    inside = np.arange(len(words)) - np.repeat(first, counts)
    return mix(values[inside < np.repeat(numbers, counts)]), numbers


def shingle_sets(
    texts: list[bytes], separators: bytes = SPACE, k: int = 5
) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, numbers = shingle_hashes(*word_hashes(texts, separators), k)
    out, at = [], 0
    for n in numbers.tolist():
        own = np.sort(hashes[at:at + n])
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if n > 1 else own)
        at += n
    return out
