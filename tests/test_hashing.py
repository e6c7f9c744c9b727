"""Murmur3 and signed feature hashing against published values and plain loops."""

import random

import pyarrow as pa

from corpuscraft.functions.hashing import hash_feature, murmur3, murmur3_of, reversed_of


def plain(data: bytes, seed: int) -> int:
    mask, h = 0xFFFFFFFF, seed
    mixed = lambda k: (((k * 0xCC9E2D51 & mask) << 15 | (k * 0xCC9E2D51 & mask) >> 17) & mask) * 0x1B873593 & mask
    for i in range(0, len(data) - 3, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    tail = data[len(data) // 4 * 4 :]
    h ^= mixed(int.from_bytes(tail, "little")) if tail else 0
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h


def test_published_values():
    # fixed values: texts, seeds and their hashes
    known = [("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("aaaa", 0x9747B28C, 0x5A97808A), ("abc", 0, 0xB3DD93FA), ("The quick brown fox jumps over the lazy dog", 0x9747B28C, 0x2FA826CD)]
    for text, seed, want in known:
        assert int(murmur3_of(pa.array([text]), seed)[0]) & 0xFFFFFFFF == want == plain(text.encode(), seed)


def test_hashes_against_plain_loops():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdé日𝄞 _", k=rng.randrange(40))) for _ in range(500)]
    got = murmur3_of(pa.array(texts)[3:], 7)
    assert [int(x) & 0xFFFFFFFF for x in got] == [plain(t.encode(), 7) for t in texts[3:]]

    def backwards(text):
        units, h = text.encode("utf-16-le"), 0
        for i in range(len(units) - 2, -1, -2):
            h = 32 * h + int.from_bytes(units[i : i + 2], "little") & 0xFFFFFFFF
        return h

    assert [int(x) & 0xFFFFFFFF for x in reversed_of(pa.array(texts))] == [backwards(t) for t in texts]


def test_columns(spark):
    rows = [("word(p)_dog",), ("",), (None,), ("été",)]
    df = spark.createDataFrame(rows, "f string").select("f", murmur3("f", 0).alias("h"), hash_feature("f", 1000).alias("x"))
    for r in df.collect():
        assert r.h & 0xFFFFFFFF == plain((r.f or "").encode(), 0) and 0 <= r.x["index"] < 1000 and r.x.sign in (-1, 1)
