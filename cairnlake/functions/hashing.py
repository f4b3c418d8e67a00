"""Digests that Spark has no expression for, as Arrow functions over batches of bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the public algorithms.
FNV64_OFFSET, FNV64_PRIME = 0xCBF29CE484222325, 0x100000001B3
FNV128_OFFSET, FNV128_LOW_PRIME = 0x6C62272E07BB014262B821756295C58D, 0x13B
CRC32C_POLYNOMIAL = 0x82F63B78
#: Fixed value: bytes of the pieces of a long value.
CRC32C_PIECE = 256


def _columns(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray):
    """The order of values by length, and for each byte position the bytes of those that are long enough; a value begins at
    its `first` place of `flat`."""
    order = np.argsort(-sizes, kind="stable")
    first = first[order]
    live = np.searchsorted(-sizes[order], -np.arange(sizes.max() if len(sizes) else 0), side="left")
    return order, (flat[first[:n] + i] for i, n in enumerate(live))


def _flat(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all values, and where each begins and how long it is."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(values) + b"\0", np.uint8), np.cumsum(sizes) - sizes, sizes


def fnv1a_64_of(values: list[bytes]) -> np.ndarray:
    order, columns = _columns(*_flat(values))
    h = np.full(len(values), FNV64_OFFSET, np.uint64)
    for byte in columns:
        h[: len(byte)] = (h[: len(byte)] ^ byte) * np.uint64(FNV64_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def _crc32c_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


CRC32C_TABLE = _crc32c_table()


def _linear(images: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The sum of the images of the bits of h, for a map that is linear over bits."""
    out = np.zeros_like(h)
    for bit in range(32):
        out ^= images[bit] * (h >> np.uint32(bit) & np.uint32(1))
    return out


def _crc32c_shifts() -> list[np.ndarray]:
    """For each k the images of the 32 bits of a register that 2**k pieces of zeros follow."""
    h = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(CRC32C_PIECE):
        h = CRC32C_TABLE[h & 0xFF] ^ (h >> np.uint32(8))
    out = [h]
    while len(out) < 40:
        out.append(_linear(out[-1], out[-1]))
    return out


CRC32C_SHIFTS = _crc32c_shifts()


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """Long values are cut from their end into pieces of one length, all pieces run at once, and their registers are added in
    pairs, the left one followed by as many zeros as the right one has bytes."""
    flat, first, sizes = _flat(values)
    pieces = np.maximum(1, -(-sizes // CRC32C_PIECE))
    at = np.cumsum(pieces) - pieces
    starts = np.repeat(first + sizes, pieces) - (np.repeat(at + pieces, pieces) - np.arange(pieces.sum())) * CRC32C_PIECE
    lengths = np.full(len(starts), CRC32C_PIECE)
    starts[at], lengths[at] = first, sizes - (pieces - 1) * CRC32C_PIECE
    order, columns = _columns(flat, starts, lengths)
    begun = np.zeros(len(starts), np.uint32)
    begun[at] = 0xFFFFFFFF
    h = begun[order]
    for byte in columns:
        h[: len(byte)] = CRC32C_TABLE[(h[: len(byte)] ^ byte) & 0xFF] ^ (h[: len(byte)] >> np.uint32(8))
    parts = np.empty_like(h)
    parts[order] = h
    out, levels = parts[at], np.ceil(np.log2(pieces)).astype(np.int64)
    for level in np.unique(levels[levels > 0]):
        some = np.flatnonzero(levels == level)
        back = np.arange(-(1 << level), 0) + pieces[some, None]  # registers of zero in front change nothing
        whole = np.where(back >= 0, parts[at[some, None] + np.maximum(back, 0)], np.uint32(0))
        for k in range(level):
            whole = _linear(CRC32C_SHIFTS[k], whole[:, ::2]) ^ whole[:, 1::2]
        out[some] = whole[:, 0]
    return out ^ np.uint32(0xFFFFFFFF)


def fnv1a_128_lowprime_of(value: bytes) -> bytes:
    """FNV-1a over 128 bits whose multiplier lacks the prime's high term; low word first. Not the standard digest."""
    h, mask = FNV128_OFFSET, (1 << 128) - 1
    for b in value:
        h = (h ^ b) * FNV128_LOW_PRIME & mask
    return h.to_bytes(16, "little")


def digest(algo: str, value: bytes) -> bytes:
    """The 16 bytes that name a chunk, by the algorithm of the catalog's configuration."""
    if algo == "sha256":
        return hashlib.sha256(value).digest()[:16]
    if algo == "blake2b_128":
        return hashlib.blake2b(value, digest_size=16).digest()
    if algo == "fnv1a_128_lowprime":
        return fnv1a_128_lowprime_of(value)
    raise ValueError(f"unknown digest {algo}")


def _present(batch: pd.Series, f) -> pd.Series:
    out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
    some = batch.notna()
    if some.any():
        out[some] = list(f([bytes(x) for x in batch[some]]))
    return out


@F.pandas_udf(T.StringType())
def fnv1a_64(batch: pd.Series) -> pd.Series:
    """16 hexadecimal digits."""
    return _present(batch, lambda v: (f"{int(x):016x}" for x in fnv1a_64_of(v)))


@F.pandas_udf(T.BinaryType())
def fnv1a_128_lowprime(batch: pd.Series) -> pd.Series:
    return _present(batch, lambda v: map(fnv1a_128_lowprime_of, v))


@F.pandas_udf(T.BinaryType())
def blake2b_128(batch: pd.Series) -> pd.Series:
    return _present(batch, lambda v: (hashlib.blake2b(x, digest_size=16).digest() for x in v))


@F.pandas_udf(T.LongType())
def crc32c(batch: pd.Series) -> pd.Series:
    return _present(batch, lambda v: (int(x) for x in crc32c_of(v)))
