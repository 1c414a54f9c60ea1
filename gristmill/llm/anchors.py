"""Content-defined anchors: every window of ``length`` bytes has one, and equal windows have it at the same place.

A window's anchor is its leftmost ``grain``-byte gram of least hash. Windows next to each other mostly share
theirs, so the windows of a text fall into runs, one run an anchor; a run's bytes are its segment.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
BUFFER = 1 << 19
PLACE_BITS = 23  # of the smallest keys that hold a place in a buffer


@lru_cache(maxsize=2)
def _tables(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    letter = rng.integers(1, 1 << 63, 256, np.int64).astype(U) | U(1)
    base = int(rng.integers(1 << 40, 1 << 62)) | 1
    up, inverse = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
    up[0] = inverse[0] = 1
    return letter, np.multiply.accumulate(up), np.multiply.accumulate(inverse)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima within blocks of w from both sides."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs(data: bytes, ends: np.ndarray, length: int, grain: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, first and last window start, anchor, the hashes of its gram and of its segment.

    ends: where each text ends in ``data``. Texts longer than a buffer are cut into overlapping parts by ``pieces``.
    """
    b = np.frombuffer(data, np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none, none, none.astype(U), none.astype(U)
    size = 1 << max(20, (len(b) + 1).bit_length())
    letter, up, inverse = _tables(size)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(letter[b] * up[: len(b)], out=sums[1:])
    grams = mix((sums[grain:] - sums[:-grain]) * inverse[: len(b) - grain + 1])
    place = U((1 << PLACE_BITS) - 1)
    keys = (grams & ~place) | np.arange(len(grams), dtype=U)
    anchor = (_sliding_min(keys, length - grain + 1) & place).astype(np.int64)
    # Windows that reach into the next text are none.
    open_ = np.zeros(len(b) + 1, np.int8)
    starts = np.r_[0, ends[:-1]]
    lasts = ends - length
    has = lasts >= starts
    np.add.at(open_, starts[has], 1)
    np.add.at(open_, lasts[has] + 1, -1)
    windows = np.flatnonzero(np.cumsum(open_[: len(anchor)], dtype=np.int8))
    if not len(windows):
        return none, none, none, none, none.astype(U), none.astype(U)
    at = anchor[windows]
    begins = np.zeros(len(b) + 1, bool)
    begins[starts[has]] = True
    new = np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1) | begins[windows[1:]]]
    first = windows[new]
    last = windows[np.r_[np.flatnonzero(new)[1:] - 1, len(windows) - 1]]
    at = at[new]
    segment = mix((sums[last + length] - sums[first]) * inverse[first] + mix((at - first).astype(U) * U(0x1F123BB5) + (last - first).astype(U)))
    return np.searchsorted(ends, first, side="right"), first, last, at, grams[at], segment


def pieces(texts: list[bytes], length: int):
    """Texts in buffers: (data, ends, which text each part is of, where the part begins in it).

    A text longer than a buffer is cut into parts that overlap by ``length - 1`` bytes, so no window is lost.
    """
    parts, size = [], 0
    for k, text in enumerate(texts):
        for i in range(0, max(1, len(text) - length + 1), BUFFER) if len(text) > BUFFER else (0,):
            part = text[i : i + BUFFER + length - 1] if len(text) > BUFFER else text
            if len(part) < length:
                continue
            if parts and size + len(part) > BUFFER:
                yield _laid(parts)
                parts, size = [], 0
            parts.append((k, i, part))
            size += len(part)
    if parts:
        yield _laid(parts)


def _laid(parts):
    return b"".join(p for _, _, p in parts), np.cumsum([len(p) for _, _, p in parts]), np.array([k for k, _, _ in parts]), np.array([i for _, i, _ in parts])
