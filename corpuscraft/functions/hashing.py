"""Feature hashing: Murmur3 (32 bits, x86) of a text's UTF-8, and a sign from a second hash."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import col

#: The seed that feature hashing uses where none is given.
SEED = 123456789
_C1, _C2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * _C1, 15) * _C2


def murmur3_of(texts: pa.Array, seed: int = SEED) -> np.ndarray:
    """The hashes of texts (null as the empty text), as signed 32-bit numbers; all of them a block of four bytes at a time."""
    raw = texts.fill_null("").cast(pa.large_binary())
    begins = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    length = np.diff(begins)
    h = np.full(len(length), seed & 0xFFFFFFFF, np.uint32)
    order = np.argsort(-(length // 4), kind="stable")  # the longest first, so that those with a block left lead
    blocks = (length // 4)[order]
    ordered = np.sort(length // 4)
    words = np.ndarray((len(data) - 3,), "<u4", data.tobytes(), strides=(1,))
    for t in range(int(blocks[0]) if len(blocks) else 0):
        some = order[: len(ordered) - int(np.searchsorted(ordered, t, "right"))]
        h[some] = _rotated(h[some] ^ _mixed(words[begins[some] + 4 * t]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    rest = length % 4
    tail = words[begins[:-1] + length - rest] & ((np.uint64(1) << (8 * rest).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    h ^= np.where(rest > 0, _mixed(tail), np.uint32(0))
    h ^= length.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h.view(np.int32)


def reversed_of(texts: pa.Array) -> np.ndarray:
    """A hash of texts read backwards, h = 32 h + unit for each UTF-16 unit, in 32 bits: only the first seven of a text are left in it."""
    out = np.zeros(len(texts), np.uint32)
    heads = pc.utf8_slice_codeunits(texts.fill_null(""), 0, 7)
    units = pa.array([x.encode("utf-16-le", "surrogatepass")[:14] for x in heads.to_pylist()], pa.binary())
    begins = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
    data = np.frombuffer((units.buffers()[2] or b""), "<u2").astype(np.uint32)
    first, size = begins[:-1] // 2, np.diff(begins) // 2
    for i in range(7):
        some = np.flatnonzero(size > i)
        out[some] += data[first[some] + i] << np.uint32(5 * i)
    return out.view(np.int32)


def murmur3(text: Column | str, seed: int = SEED) -> Column:
    @F.arrow_udf("int")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(murmur3_of(texts, seed))

    return hashed(col(text))


def hash_feature(feature: Column | str, mod: int, seed: int = SEED) -> Column:
    """(index, sign) of a feature: its hash modulo ``mod``, and -1 where the hash of its reverse is negative, else 1."""

    @F.arrow_udf("struct<index: int, sign: int>")
    def hashed(texts: pa.Array) -> pa.Array:
        index = murmur3_of(texts, seed).astype(np.int64) % mod
        return pa.StructArray.from_arrays([pa.array(index.astype(np.int32)), pa.array(np.where(reversed_of(texts) < 0, -1, 1).astype(np.int32))], ["index", "sign"])

    return hashed(col(feature))
