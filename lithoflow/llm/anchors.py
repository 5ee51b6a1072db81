"""Content-defined anchors: every window of a text is dealt to one k-gram in it, the same one wherever the window occurs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes of a window (a repeated string), unless another length is given.
WINDOW = 400
#: Bytes that are hashed at a time; longer texts go part by part.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def anchor_size(window: int) -> int:
    """Bytes of an anchor: about a third of the window, so that chance repeats are few and anchors not too many."""
    return max(1, window * 8 // 25)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n powers of the base and of its inverse modulo 2**64, and a random number for each byte."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
    return up, down, np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def kgram_hashes(data: np.ndarray, k: int, longest: int) -> np.ndarray:
    """A mixed polynomial hash of each k bytes of at most `longest`."""
    up, down, of_byte = _powers(longest + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(of_byte[data] * up[: len(data)], dtype=np.uint64)))
        x = (total[k:] - total[:-k]) * down[: len(data) - k + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The place of the leftmost minimum of each w consecutive values, by minima of blocks from either side."""
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.concatenate((x, np.full(pad, 2**64 - 1, np.uint64))).reshape(-1, w)
    at = np.arange(full.size)
    # from each block's begin a value below all before it is the new leftmost least; from its end one that is not above all after it
    new = np.ones(full.shape, bool)
    before = np.minimum.accumulate(full, axis=1)
    np.less(full[:, 1:], before[:, :-1], out=new[:, 1:])
    place_before = np.maximum.accumulate(np.where(new.ravel(), at, 0))
    after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1]
    np.less_equal(full[:, :-1], after[:, 1:], out=new[:, :-1])
    new[:, -1] = True
    place_after = np.minimum.accumulate(np.where(new.ravel(), at, full.size)[::-1])[::-1]
    return np.where(after.ravel()[:n] <= before.ravel()[w - 1 : w - 1 + n], place_after[:n], place_before[w - 1 : w - 1 + n])


def anchors(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor: the windows of which it is the leftmost least k-gram."""
    found: list[tuple] = []
    k, n = anchor_size(window), len(data) - window + 1
    for at in range(0, max(0, n), PART):
        part = np.frombuffer(data, np.uint8, min(PART + window - 1, len(data) - at), at)
        x = kgram_hashes(part, k, PART + window - 1)
        place = window_minima(x, window - k + 1)
        cut = np.nonzero(np.concatenate(([True], place[1:] != place[:-1])))[0]
        found.append((x[place[cut]], place[cut] + at, cut + at, np.append(cut[1:], len(place)) - 1 + at))
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))
