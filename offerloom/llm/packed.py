"""Whole numbers in few bytes, and keys dealt out to ranges."""

from __future__ import annotations

import numpy as np
import zstandard

LOW = 40  # bits of a key beside its range


def pack(values: np.ndarray, width: int) -> bytes:
    """Whole numbers as bytes of equal weight side by side, compressed."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes (unsigned, 64 bits)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def ranged(code: np.ndarray, ranges: int) -> np.ndarray:
    """Keys of hashes: the range (its share of the high bits) above LOW low bits."""
    place = (code >> np.uint64(LOW)) * np.uint64(ranges) >> np.uint64(64 - LOW)
    return ((place << np.uint64(LOW)) | (code & np.uint64((1 << LOW) - 1))).astype(np.int64)


def low_bits(keys: np.ndarray) -> bytes:
    """Rising keys of one range, packed as differences."""
    return pack(np.diff(keys & ((1 << LOW) - 1), prepend=0), 5)


def low_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, 5))
