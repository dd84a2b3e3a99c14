"""Partitioned Elias-Fano blobs of non-decreasing 64-bit sequences, in NumPy.

A chunk is stored less its first value: the low bits of each number at fixed width, the high bits in
unary. Blob: u64 first, u32 count, u8 low width, then the low bits, then the high bits.
"""

from __future__ import annotations

import struct

import numpy as np

CHUNK = 3087
_HEAD, _SIZE = "<QIB", 13


def encode(values: np.ndarray) -> bytes:
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return struct.pack(_HEAD, 0, 0, 0)
    if (v[1:] < v[:-1]).any():
        raise ValueError("the sequence decreases")
    rel = v - v[0]
    top = int(rel[-1])
    width = max(0, (max(top + 1, n) // n).bit_length() - 1)
    low = (rel[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    high = (rel >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1, np.uint8)
    bits[high] = 1
    return struct.pack(_HEAD, int(v[0]), n, width) + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes()


def decode(blob: bytes) -> np.ndarray:
    first, n, width = struct.unpack_from(_HEAD, blob)
    if not n:
        return np.zeros(0, np.uint64)
    at = _SIZE + (n * width + 7) // 8
    low = np.unpackbits(np.frombuffer(blob, np.uint8, at - _SIZE, _SIZE), bitorder="little", count=n * width).reshape(n, width)
    low = (low.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if width else np.zeros(n, np.uint64)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), bitorder="little"))[:n] - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(width)) + low + np.uint64(first)
