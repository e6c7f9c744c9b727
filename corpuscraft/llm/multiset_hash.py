"""Document fingerprints: a homomorphic multiset hash.

A paragraph (a line of the text that is not empty) has a wide vector: ``DENSE`` lanes of 64 bits drawn from
its SHAKE-128 hash, and ``SKETCH`` lanes of 32 bits in which each of its word triples counts +1 or
-1 in a lane. A document's fingerprint is the sum of its paragraphs' vectors, modulo 2**64 and 2**32. The order
of paragraphs doesn't matter, and one is put in or taken out by adding or subtracting its vector.
The dense lanes tell multisets apart; the sketch lanes tell how much two of them share, since the sketch of a
difference is the difference of the sketches and its squared length estimates that of the counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, parallelism

DENSE, SKETCH = 16, 128
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class Fingerprint:
    """The summed vector of a multiset of paragraphs."""

    def __init__(self, dense: np.ndarray, sketch: np.ndarray):
        self.dense, self.sketch = dense, sketch

    @classmethod
    def of(cls, text: str | None) -> Fingerprint:
        paragraphs = [p for p in (text or "").encode().split(b"\n") if p]
        words: list[bytes] = []
        sizes = []
        for p in paragraphs:
            own = p.split()
            sizes.append(len(own))
            words += own
        drawn = b"".join([hashlib.shake_128(p).digest(8 * DENSE) for p in paragraphs])
        dense = np.frombuffer(drawn, "<u8").reshape(-1, DENSE).sum(axis=0, dtype=np.uint64)
        h = np.fromiter(map(crc32, words), np.uint64, len(words)) * _A
        size = np.array(sizes, np.int64)
        paragraph = np.repeat(np.arange(len(size)), size)
        # a triple begins at every word with two more in its paragraph; a shorter paragraph is one piece
        place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        triple = place + 2 < size[paragraph] if len(size) else np.zeros(0, bool)
        short = (place == 0) & (size[paragraph] < 3) if len(size) else triple
        second, third = np.append(h[1:], [0] * min(1, len(h))).astype(np.uint64), np.append(h[2:], [0] * min(2, len(h))).astype(np.uint64)
        second = np.where(triple | (size[paragraph] > 1), second, 0) if len(size) else second
        keys = (h ^ (second * _B << np.uint64(1)) ^ np.where(triple, third * _C << np.uint64(2), np.uint64(0)))[triple | short]
        keys = (keys ^ keys >> np.uint64(33)) * _C
        keys = (keys ^ keys >> np.uint64(29)) * _B
        keys ^= keys >> np.uint64(32)
        lane, sign = (keys % np.uint64(SKETCH)).astype(np.int64), np.where(keys & np.uint64(1 << 40), 1, -1)
        sketch = np.bincount(lane, sign, SKETCH).astype(np.int64).astype(np.uint32)
        return cls(dense, sketch)

    def add(self, other: Fingerprint) -> Fingerprint:
        """With the other's paragraphs put in."""
        return Fingerprint(self.dense + other.dense, self.sketch + other.sketch)

    def remove(self, other: Fingerprint) -> Fingerprint:
        """With the other's paragraphs taken out."""
        return Fingerprint(self.dense - other.dense, self.sketch - other.sketch)

    def likeness(self, other: Fingerprint) -> float:
        """The estimated share of word triples that both have, 0 to 1; 1 if the fingerprints are equal."""
        if (self.dense == other.dense).all() and (self.sketch == other.sketch).all():
            return 1.0
        mine, theirs, apart = (np.square(x.view(np.int32).astype(np.float64)).sum() for x in (self.sketch, other.sketch, self.sketch - other.sketch))
        return float(min(1.0, max(0.0, 1 - apart / (mine + theirs)))) if mine + theirs else 0.0

    def text(self) -> str:
        return base64.b64encode(self.dense.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw, "<u8", DENSE).copy(), np.frombuffer(raw, "<u4", SKETCH, 8 * DENSE).copy())


def edited(text: str, following: str) -> str:
    """The text whose last half (rounded down) gives way to the beginning of the following one, as long if there is as much."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how like they and the next document's are.

    docs: doc_id (long), text; other columns are ignored. A null text counts as empty; an empty text has the
    fingerprint of no paragraph. Next is the document that follows by doc_id, the first after the last; a
    null doc_id comes first, and rows that repeat a doc_id follow each other by a hash of their text. A single row is its own
    next. No rows give no rows.

    The rows are dealt once, by ranges of (doc_id, text hash) of about equal bytes, a partition each. A range begins at a row
    of a sample (which sets bounds only), and the rows that equal its begin go to the range before as well, so every task
    finds the document after its last. What reaches the driver is bounded whatever the rows: about PER_RANGE sampled places
    for each of at most RANGES ranges, of which the bounds are kept and sent to the tasks. Beyond RANGES times RANGE bytes the
    ranges grow; tasks stream them.
    """
    spark = docs.sparkSession
    place = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("place", place)
    cuts = _bounds(rows, parallelism(spark))
    if not cuts:
        return spark.createDataFrame([], SHAPE)
    # a row of bounds, in two levels, so that a row's range is found among few
    bounds = spark.createDataFrame([([cuts[i : i + LEVEL] for i in range(0, len(cuts), LEVEL)],)], "cuts array<array<struct<id: bigint, hash: bigint>>>")
    upto = lambda cs, of: F.size(F.filter(cs, lambda c: of(c) <= F.col("place")))
    dealt = rows.crossJoin(F.broadcast(bounds)).withColumn("high", upto("cuts", lambda c: c[0]) - 1)
    dealt = dealt.withColumn("range", F.col("high") * LEVEL + upto(F.get("cuts", F.col("high")), lambda c: c) - 1)
    begins = F.get(F.get("cuts", F.col("high")), F.pmod(F.col("range"), F.lit(LEVEL))) == F.col("place")
    before = F.pmod(F.col("range") - 1, F.lit(len(cuts)))
    copies = F.array_compact(F.array(F.struct("range", F.lit(False).alias("ahead")), F.when(begins, F.struct(before.alias("range"), F.lit(True).alias("ahead")))))
    sent = dealt.select("doc_id", "text", "place", F.explode(copies).alias("x")).select("doc_id", "text", "place", "x.range", "x.ahead")
    ordered = sent.repartitionById(len(cuts), F.col("range")).sortWithinPartitions("range", "ahead", F.asc_nulls_first("doc_id"), "place", "text").select("doc_id", "text", "range", "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, doc_id, text, fingerprint
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            found = []
            for k, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id")), batch.column("text")):
                if last is None and ahead:
                    continue
                text = text.as_py()
                own = Fingerprint.of(text)
                if last and last[0] == k:
                    changed = edited(last[2], text)
                    other = Fingerprint.of(changed)
                    found.append((last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), last[3].text(), other.text(), last[3].likeness(other), last[3].likeness(own)))
                last = None if ahead else (k, doc_id, text, own)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names)

    return batched(ordered).mapInArrow(run, SHAPE)


SHAPE = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bounds of the lower level of each of the upper, bytes of text that a range has about, and the most ranges.
LEVEL, RANGE, RANGES = 128, 64 << 20, 50_000
#: Rows that the bounds are taken from at least, and for each range.
SAMPLE, PER_RANGE = 20_000, 20


def _bounds(rows: DataFrame, least: int) -> list[tuple[int, int]]:
    """The least place, and places that cut the rows into ``least`` ranges or more, of at most RANGE bytes about up to RANGES of them."""
    size = F.octet_length("text").cast("long")
    first, n, total = rows.agg(F.min("place"), F.count("*"), F.sum(size)).first()
    if not n:
        return []
    ranges = max(least, min(RANGES, -(-total // RANGE)))
    wanted = max(SAMPLE, PER_RANGE * ranges)
    # by the hash of the text, which is there anyway
    sample = rows.where(F.pmod(F.xxhash64("place"), F.lit(n)) < wanted) if n > 2 * wanted else rows
    places = sample.groupBy("place").agg(F.sum(size).alias("size")).select("place.id", "place.hash", "size").toArrow()  # rows that repeat are one
    ids, hashes, sizes = (places.column(c).to_numpy() for c in ("id", "hash", "size"))
    order = np.lexsort((hashes, ids))
    weighed = list(zip(zip(ids[order].tolist(), hashes[order].tolist()), sizes[order].tolist()))
    out, run, share = [tuple(first)], 0, int(sizes.sum()) / ranges
    for at, s in weighed:
        if run >= share and at > out[-1]:
            out.append(at)
            run = 0
        run += s + share / len(weighed)
    return out
