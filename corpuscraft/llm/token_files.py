"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets, memory-mapped.

A folder of token files holds, for each shard, ``NAME.ids`` (the ids of its documents one after
another, as unsigned 16-bit integers where the vocabulary allows it, else 32-bit), ``NAME.offsets``
(unsigned 64-bit: where each document begins, and the shard's end, counted from the shard's own
begin), ``NAME.docs`` (the documents' ids, signed 64-bit, the least one standing for null), and
``index.json``: the width of an id, and each shard's number, name and base, which is the prefix sum of the shards' sizes.
A name tells the attempt of the task that wrote it, so a task that runs again overwrites nothing; the index
names the attempts that count. All are little-endian. Shards ascend by doc_id, so base + offset is a place in the whole corpus.

The number of shards follows the bytes of text. A writer streams its three files and a reader looks at ranges of them, so
neither holds more than one document's ids or a block of offsets.
"""

from __future__ import annotations

import json
import mmap
import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, parallelism
from .wordbpe import coder, default_vocabulary

NULL_ID = -(2**63)
#: Documents of a block that is read, ids that are looked at together, and bytes of text that a shard has about.
BATCH, PIECE, SHARD = 8192, 1 << 20, 512 << 20


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Numbers:
    """A file of numbers of one kind, of which ranges are looked at: mapped where it lies in a mounted folder, else read by offset."""

    def __init__(self, files: fs.FileSystem, path: str, kind: str):
        self.kind = np.dtype(kind)
        if isinstance(files, fs.LocalFileSystem):
            self.size = os.path.getsize(path)
            if self.size:
                with open(path, "rb") as f:
                    self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            self.file = files.open_input_file(path)
            self.size = self.file.size()

    def __len__(self) -> int:
        return self.size // self.kind.itemsize

    def range(self, first: int, last: int) -> np.ndarray:
        """The numbers from first up to last."""
        width = self.kind.itemsize
        if last <= first:
            return np.empty(0, self.kind)
        if hasattr(self, "map"):
            return np.frombuffer(self.map, self.kind, last - first, first * width)
        return np.frombuffer(self.file.read_at((last - first) * width, first * width), self.kind)


def checksums(ids: Numbers, bounds: list[int]) -> list[int]:
    """The crc32 of the ids, as little-endian unsigned 32-bit, between each two bounds, at most PIECE ids at a time."""
    out, begin, block = [], 0, np.empty(0, "<u4")
    for a, b in zip(bounds[:-1], bounds[1:]):
        crc = 0
        while a < b:
            if not begin <= a < begin + len(block):
                begin, block = a, ids.range(a, min(a + PIECE, bounds[-1])).astype("<u4")
            stop = min(b, begin + len(block))
            crc = crc32(block[a - begin : stop - begin], crc)
            a = stop
        out.append(crc)
    return out


def write_token_files(docs: DataFrame, root: str, vocabulary: str | None = None, end_id: int = 1, shards: int | None = None) -> None:
    """Writes the token files of docs (doc_id long, text) to ``root``, a new folder that all executors see.

    Ids are those of the tokenizers library without special tokens, then ``end_id``. A null text counts as
    empty and gets the end id alone. Documents ascend by doc_id, null first; repeated ids lie side
    by side, ordered by a hash of their texts. No rows give files without ids. ``shards``: by default one for SHARD bytes of
    text, and at least as many as the session shuffles by. A row a shard reaches the driver. A very long text is encoded in its
    task; its ids are read again in pieces.
    """
    vocabulary = vocabulary or default_vocabulary()
    shards = shards or max(parallelism(docs.sparkSession), -(-(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SHARD))
    files, base = _open(root)
    files.create_dir(base, recursive=True)
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 2**16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        task = TaskContext.get()
        k = task.partitionId()
        name = f"{k:06d}-{task.taskAttemptId()}"
        own = f"{base}/{name}"
        encode, at = coder(vocabulary).encode_all, 0
        with files.open_output_stream(f"{own}.ids") as ids, files.open_output_stream(f"{own}.offsets") as offsets, files.open_output_stream(f"{own}.docs") as names:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                names.write(np.array([NULL_ID if i is None else i for i in batch.column("doc_id").to_pylist()], "<i8").tobytes())
                found, ends = encode(batch.column("text"))
                ids.write(np.insert(found.astype(f"<u{width}"), ends, end_id).tobytes())
                offsets.write((at + ends + np.arange(1, 1 + len(ends))).astype("<u8").tobytes())
                at += len(found) + len(ends)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([k], pa.int32()), "name": [name], "n_ids": pa.array([at], pa.int64())})

    rows = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    written = batched(rows.select("doc_id", "text")).mapInArrow(write, "shard int, name string, n_ids long").collect()  # a row a shard
    bases, total = [], 0
    for k, name, n in sorted(map(tuple, written)):
        bases.append([k, name, total])
        total += n
    with files.open_output_stream(f"{base}/index.json") as out:
        out.write(json.dumps({"width": width, "bases": bases, "n_ids": total}).encode())


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """A row a document of the token files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit)."""
    files, base = _open(root)
    with files.open_input_stream(f"{base}/index.json") as f:
        index = json.loads(f.read())
    width = index["width"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                offsets, docs, ids = (Numbers(files, f"{base}/{name}.{part}", kind) for part, kind in (("offsets", "<u8"), ("docs", "<i8"), ("ids", f"<u{width}")))
                for i in range(0, len(docs), BATCH):
                    own = docs.range(i, min(i + BATCH, len(docs)))
                    at = offsets.range(i, i + len(own) + 1).astype(np.int64)
                    crc = checksums(ids, at.tolist())
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, mask=own == NULL_ID), "start": pa.array(at[:-1] + first), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    bases = spark.createDataFrame([tuple(b) for b in index["bases"]], "shard int, name string, base long")
    return bases.repartition(max(1, len(index["bases"])), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
