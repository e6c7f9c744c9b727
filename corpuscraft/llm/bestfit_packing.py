"""Best-fit packing: bounded-space online best-fit of documents into token sequences.

Every task streams its documents once. It tokenizes each, cuts what is longer than a sequence and
puts the pieces into at most ``open_bins`` open bins. The open bins lie in a bitset keyed by their
free space, so the best fit is the lowest set bit at or above a piece's length; if no bin fits and
all are open, the fullest closes. A second round over the pieces of the bins that a task had to
leave badly filled joins what the tasks left over. No key takes part, so no hot source or long
document can pile up in one task; a task holds its open bins and one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batched
from .wordbpe import coder, default_vocabulary

#: Rows a batch that a task returns.
BATCH = 4096
#: Pieces that a task of the second round packs. Each part leaves one sequence badly filled at most.
PART = 8192


class BestFit:
    """A fixed number of open bins in a bitset keyed by free space; the fullest closes first."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit, self.bits, self.n_open, self.n_bins = capacity, open_bins, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin that gets a piece of this length (1 to the capacity), and the piece's offset there."""
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
            self.n_open -= 1
        else:
            found, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            self.by_free[left].append(found)
            self.bits |= 1 << left
            self.n_open += 1
        return found, self.capacity - free


def _sequence(task: int, number: int, shift: int) -> int:
    return (task << 40 | number) << 1 | shift


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0, open_bins: int = 4096, spare: float = 0.01, with_ids: bool = False) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` tokens.

    docs: doc_id (of any simple type), text; other columns are ignored. A null text counts as empty, and an empty one is
    the end id alone. A null doc_id is packed like any other; repeated rows are packed as often as they
    occur. No rows give no rows. Only documents longer than a sequence are cut, into pieces of
    exactly the capacity and a last one that may be shorter.

    spare: the share of a sequence that may stay free before the second round takes it up again.
    Returns a row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with
    ``with_ids`` the piece's ids (little-endian unsigned 32-bit).
    """
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids
    least = capacity - int(capacity * spare)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode, tail = coder(vocabulary).encode_all, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            found, ends = encode(batch.column("text"))
            for doc_id, begin, end in zip(batch.column("doc_id").to_pylist(), [0, *ends.tolist()], ends.tolist()):
                ids = found[begin:end].tobytes() + tail
                for piece in range(-(-len(ids) // (4 * capacity))):
                    part = ids[piece * capacity * 4 : (piece + 1) * capacity * 4]
                    yield doc_id, piece, piece * capacity, len(part) // 4, crc32(part), part

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids

    def batches_of(found: Iterator[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        types = [id_type, pa.int32(), *[pa.int64()] * 5, pa.binary()]
        kept: list[tuple] = []
        for row in found:
            kept.append(row[: len(names)])
            if len(kept) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names)
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), types)], names)

    def typed(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
        """The type of doc_id, and all batches; null for none."""
        head = next(batches, None)
        return (pa.null(), iter(())) if head is None else (head.schema.field("doc_id").type, chain([head], batches))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, batches = typed(batches)
        task, bins = TaskContext.get().partitionId(), BestFit(capacity, open_bins)

        def placed() -> Iterator[tuple]:
            for doc_id, piece, start, length, crc, part in rows(batches):
                number, offset = bins.place(length)
                yield doc_id, piece, start, length, crc, _sequence(task, number, 0), offset, part

        yield from batches_of(placed(), id_type)

    scratch = Scratch(spark, "packing")
    packed = scratch.write(batched(docs.select("doc_id", "text")).mapInArrow(first, shape))
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < least)
    loose = packed.join(filled.select("sequence_id"), "sequence_id", "left_semi")
    parts = max(1, loose.count() // PART)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, batches = typed(batches)
        task, bins = TaskContext.get().partitionId(), BestFit(capacity, open_bins)

        def placed() -> Iterator[tuple]:
            for batch in batches:
                for row in zip(*(batch.column(n).to_pylist() for n in names)):
                    number, offset = bins.place(row[3])
                    yield *row[:5], _sequence(task, number, 1), offset, *row[7:]

        yield from batches_of(placed(), id_type)

    # longest first, which is the order in which best-fit leaves least; the hash spreads ties over the parts
    again = loose.select(names).withColumn("part", F.pmod(F.xxhash64("ids_crc32", "sequence_id", "offset"), F.lit(parts))).repartition(parts, "part").sortWithinPartitions(F.desc("length"), "sequence_id", "offset").select(names).mapInArrow(second, shape)
    return packed.join(filled.select("sequence_id"), "sequence_id", "left_anti").select(names).unionByName(again)

