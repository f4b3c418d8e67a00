"""Content-defined chunks: cut points chosen from all candidate positions of a text at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_U = np.uint64
#: Fixed value: the seed of the gear table, which a splitmix64 sequence fills.
GEAR_SEED = 0x123456789ABCDEF0


def gear_table() -> np.ndarray:
    state = _U(GEAR_SEED) + np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)
    z = (state ^ (state >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


GEAR = gear_table()


@dataclass(frozen=True)
class ChunkSizes:
    """Least, average and greatest size; the masks are two bits stricter below the average and looser above."""

    least: int = 4096
    average: int = 32768
    most: int = 262144

    def masks(self) -> tuple[int, int]:
        bits = max(1, (self.average - 1).bit_length())
        return tuple((1 << min(63, max(1, bits + k))) - 1 for k in (2, -2))


def fingerprints(data: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the rolling gear hash at each byte: they depend on the last `bits` bytes only."""
    out, g = np.zeros(len(data), _U), GEAR[data]
    for k in range(min(bits, len(data))):
        out[k:] += g[: len(data) - k] << _U(k)
    return out


def cut_points(data: bytes, sizes: ChunkSizes) -> list[int]:
    """Ends of the chunks of data."""
    strict, loose = sizes.masks()
    n, start, out = len(data), 0, []
    bits = strict.bit_length()
    raw = np.frombuffer(data, np.uint8)
    if sizes.least >= bits:
        fp = fingerprints(raw, bits)
        hard, soft = np.flatnonzero((fp & _U(strict)) == 0), np.flatnonzero((fp & _U(loose)) == 0)
        while n - start > sizes.least:
            end = min(n, start + sizes.most)
            middle = min(end, start + sizes.average)
            cut = end
            for places, low, high in ((hard, start + sizes.least, middle), (soft, middle, end)):
                at = np.searchsorted(places, low)
                if at < len(places) and places[at] < high:
                    cut = int(places[at]) + 1
                    break
            out.append(cut)
            start = cut
    else:
        while n - start > sizes.least:
            fp, cut = 0, min(n, start + sizes.most)
            for i in range(start, cut):
                fp = (fp << 1) + int(GEAR[raw[i]]) & (1 << 64) - 1
                if i - start >= sizes.least and fp & (strict if i - start < sizes.average else loose) == 0:
                    cut = i + 1
                    break
            out.append(cut)
            start = cut
    return out + [n] * (start < n)


def chunk_ends(data: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ends(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else cut_points(bytes(x), sizes))

    return ends(data)


def incompressible(data: bytes) -> bool:
    """Whether a sample of 1024 bytes looks random: over 200 distinct values, or at least 192 spread evenly."""
    if len(data) < 1024:
        return False
    counts = np.bincount(np.frombuffer(data, np.uint8)[: len(data) // 1024 * 1024 : len(data) // 1024][:1024], minlength=256)
    kinds = int((counts > 0).sum())
    return kinds > 200 or (kinds >= 192 and int(((counts - 4) ** 2).sum()) <= 2048)


@F.pandas_udf(T.BooleanType())
def is_incompressible(batch: pd.Series) -> pd.Series:
    return batch.map(lambda x: None if x is None else incompressible(bytes(x)))
