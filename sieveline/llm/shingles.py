"""Byte-level words, shingles and hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

P1, P2, P3, P4, P5 = (  # fixed values: the primes of XXH64
    np.uint64(n)
    for n in (
        11400714785074694791, 14029467366897019727, 1609587929392839161,
        9650029242287828579, 2870177450012600261,
    )
)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer shingles are hashed one by one; the vectorised code would be run for a few of them only.
_LONG = 512


def batches(texts: Iterable[str | None], size: int = 2_000_000) -> Iterator[list[bytes]]:
    """UTF-8 texts in lists of about ``size`` bytes; null counts as empty."""
    held: list[bytes] = []
    n = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Words:
    """Words of a list of texts, each followed by one space in ``data``.

    ``starts`` and ``ends`` are the words' places in ``data``, ``counts`` the words of each text.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        solid = ~_SPACE[raw]
        before = np.concatenate([[False], solid[:-1]])
        keep = solid | before
        self.raw_starts = np.flatnonzero(solid & ~before)
        data = raw[keep]
        if lower:
            data = _LOWER[data]
        solid = solid[keep]
        data[~solid] = 0x20
        self.data = data
        self.ends = np.flatnonzero(~solid)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        # Texts are told apart by their places in the unchanged bytes.
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.counts = np.diff(np.searchsorted(self.raw_starts, bounds), prepend=0)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, count per text); a text with fewer words is one shingle, without words none."""
        each = np.where(self.counts >= width, self.counts - width + 1, np.minimum(self.counts, 1))
        first = np.cumsum(self.counts) - self.counts
        at = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
        last = np.minimum(at + width, np.repeat(first + self.counts, each)) - 1
        return self.starts[at], self.ends[last], each


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotate(acc + lane * P2, 31) * P1


def _equal_length(data: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """XXH64 of ``size`` bytes at each place."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    seed64, used = np.uint64(seed), 0
    if size >= 32:
        with np.errstate(over="ignore"):
            accs = [np.full(len(at), s, np.uint64) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
        while size - used >= 32:
            accs = [_round(acc, wide[at + (used + 8 * n)]) for n, acc in enumerate(accs)]
            used += 32
        h = _rotate(accs[0], 1) + _rotate(accs[1], 7) + _rotate(accs[2], 12) + _rotate(accs[3], 18)
        for acc in accs:
            h = (h ^ _round(np.zeros_like(acc), acc)) * P1 + P4
    else:
        with np.errstate(over="ignore"):
            h = np.full(len(at), seed64 + P5, np.uint64)
    h = h + np.uint64(size)
    while size - used >= 8:
        h = _rotate(h ^ _round(np.uint64(0), wide[at + used]), 27) * P1 + P4
        used += 8
    if size - used >= 4:
        four = wide[at + used] & np.uint64(0xFFFFFFFF)
        h = _rotate(h ^ (four * P1), 23) * P2 + P3
        used += 4
    while used < size:
        h = _rotate(h ^ (data[at + used].astype(np.uint64) * P5), 11) * P1
        used += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range. Ranges are grouped by length, so each group is straight-line code."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), 1 << 17):
        part = slice(low, low + (1 << 17))
        own = sizes[part]
        order = np.argsort(np.minimum(own, _LONG).astype(np.uint16), kind="stable")
        ranked = own[order]
        cuts = np.flatnonzero(np.diff(ranked, prepend=-1))
        found = np.empty(len(own), np.uint64)
        at = starts[part][order]
        for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True):
            size = int(ranked[a])
            if size < _LONG:
                found[a:b] = _equal_length(data, at[a:b], size, seed)
            else:
                found[a:b] = [
                    xxhash.xxh64_intdigest(data[p : p + n].tobytes(), seed)
                    for p, n in zip(at[a:b], ranked[a:b], strict=True)
                ]
        spread = np.empty(len(own), np.uint64)
        spread[order] = found
        out[part] = spread
    return out
