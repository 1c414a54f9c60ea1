"""Arrays of fixed size that every task adds to: packed slices, combined in streams, and a Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

SLICE = 1 << 16
BLOOM_BITS = 25
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def packed(x: np.ndarray, size: int = SLICE) -> list[tuple[int, bytes]]:
    """The slices of an array that are not all zero, each packed."""
    pack = zstandard.ZstdCompressor(level=1)
    parts = ((k, x[i : i + size]) for k, i in enumerate(range(0, len(x), size)))
    return [(k, pack.compress(p.tobytes())) for k, p in parts if p.any()]


def accumulated(parts: DataFrame, length: int, dtype, combine, size: int = SLICE) -> np.ndarray:
    """Combine packed slices (slice int, data binary) of all tasks into one array of fixed ``length``."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for pdf in batches:
            for k, data in zip(pdf["slice"], pdf["data"]):
                x = np.frombuffer(unpack.decompress(data), dtype)
                held[k] = combine(held[k], x) if k in held else x
        pack = zstandard.ZstdCompressor(level=1)
        yield pd.DataFrame({"slice": list(held), "data": [pack.compress(x.tobytes()) for x in held.values()]})

    slices = -(-length // size)
    out = np.zeros(length, dtype)
    unpack = zstandard.ZstdDecompressor()
    # Tasks take several parts each: there is little work in one.
    for r in parts.repartition(min(slices, 64), "slice").coalesce(16).mapInPandas(add, "slice int, data binary").collect():  # at most ``slices`` rows of fixed size
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(unpack.decompress(bytes(r["data"])), dtype)
    return out


def bloom_places(x: np.ndarray) -> np.ndarray:
    h = mix(x.astype(np.int64).view(U) + U(5))
    return np.stack([(mix(h + U(j)) >> U(64 - BLOOM_BITS)).astype(np.int64) for j in range(4)])


def bloom(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size over a column of longs, repeated ones too: it may let others through, and misses none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
        for pdf in batches:
            at = bloom_places(np.unique(pdf.iloc[:, 0].to_numpy())).ravel()
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pd.DataFrame(packed(bits), columns=["slice", "data"])

    parts = keys.mapInPandas(run, "slice int, data binary")
    return accumulated(parts, (1 << BLOOM_BITS) // 8, np.uint8, np.bitwise_or)


def may_hold(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = bloom_places(x)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
