"""SentencePiece encoding and decoding by the model's own method.

A model of the BPE kind merges pieces by rank, which is no sum that a max-plus scan could maximize, so it is encoded by the
library's merges. No merge joins two characters that no piece has side by side (a word's end and the next word begin among
them), so texts of over ``chunk`` characters are cut there and their chunks are encoded by themselves, spread over tasks.
A model of another kind takes the scan of ``piece_codec``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import piece_codec
from .common import batched
from .piece_codec import MARK, default_model

_MERGERS: dict[str, Merger] = {}


def _read(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def is_bpe(path: str) -> bool:
    return _read(path).trainer_spec.model_type == 2


class Merger:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.lib = SentencePieceProcessor(model_file=path)
        model = _read(path)
        if model.normalizer_spec.remove_extra_whitespaces or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("models that change the text aren't supported")
        model.normalizer_spec.add_dummy_prefix = False
        #: Encodes what follows a cut: nothing is put before it.
        self.inner = SentencePieceProcessor(model_proto=model.SerializeToString())
        self.own = piece_codec.PieceCodec(path)

    def encode(self, text: str, first: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return np.array((self.lib if first else self.inner).encode(text), "<u4").tobytes()

    def decode(self, ids: bytes, first: bool = True) -> str:
        return self.own.decode(ids) if first else b"".join([self.own.table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")

    def cuts(self, text: str, chunk: int) -> Iterator[str]:
        """Stretches of at least ``chunk`` characters (but the last), each up to the next place that no merge crosses."""
        near, begin, n = self.own.neighbours, 0, len(text)
        while begin < n:
            end = min(begin + chunk, n)
            while end < n and text[end - 1 : end + 1].replace(" ", MARK) in near:
                end += 1
            yield text[begin:end]
            begin = end


def merger(path: str) -> Merger:
    """One merger a worker process and model."""
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            total ^= row
        vector >>= 1
    return total


def _bit_shifts() -> list[list[int]]:
    """What 2**k zero bits after a checksum make of it, as columns over GF(2)."""
    one = [0xEDB88320, *(1 << i for i in range(31))]
    out = [one]
    for _ in range(60):
        out.append([_times(out[-1], x) for x in out[-1]])
    return out


_SHIFTS = _bit_shifts()


def joined_crc32(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings in a row, from those of each and the second's size."""
    bits, k = 8 * size, 0
    while bits:
        if bits & 1:
            first = _times(_SHIFTS[k], first)
        bits >>= 1
        k += 1
    return first ^ second


def _by_chunks(docs: DataFrame, model: str, chunk: int, work: Callable[[pa.RecordBatch], pa.RecordBatch], shape: str) -> DataFrame:
    """What ``work`` makes of batches of doc_id, row, k, chunk: the chunks of the texts that are longer than one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    long = docs.select("doc_id", "text").where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = merger(model).cuts
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                for k, part in enumerate(cuts(text.as_py(), chunk)):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), batch.column("row").slice(i, 1), pa.array([k], pa.int64()), pa.array([part])], ["doc_id", "row", "k", "chunk"])

    parts = batched(long).mapInArrow(split, f"doc_id {kind}, row long, k long, chunk string").repartition("row", "k")
    return parts.mapInArrow(lambda batches: map(work, batches), f"doc_id {kind}, row long, k long, {shape}")


def _whole(docs: DataFrame, chunk: int, work: Callable[[pa.RecordBatch], pa.RecordBatch], shape: str) -> DataFrame:
    short = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= chunk)
    return batched(short).mapInArrow(lambda batches: map(work, batches), shape)


def encode_documents(docs: DataFrame, model: str | None = None, chunk: int = 32768) -> DataFrame:
    """Encodes every whole text: doc_id, text, ids (binary: little-endian unsigned 32-bit), as the library does.

    docs: doc_id, text; other columns are ignored. Null and empty texts have no ids (the text returns as it was).
    Repeated rows each return; no rows give no rows. Texts longer than ``chunk`` characters are cut as said above;
    only a stretch without such a place stays in one task.
    """
    model = model or default_model()
    if not is_bpe(model):
        return piece_codec.encode_documents(docs, model, chunk)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, text string, ids binary"

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = merger(model).encode
        ids = [encode(t.as_py() or "") for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["doc_id", "text", "ids"])

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = merger(model).encode
        ids = [encode(c.as_py(), k.as_py() == 0) for k, c in zip(batch.column("k"), batch.column("chunk"))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], ["doc_id", "row", "k", "chunk", "ids"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"doc_id": pdf["doc_id"][:1], "text": ["".join(pdf.chunk)], "ids": [b"".join(pdf.ids)]})

    parts = _by_chunks(docs, model, chunk, part, "chunk string, ids binary")
    return _whole(docs, chunk, whole, shape).unionByName(parts.groupBy("row").applyInPandas(join, shape))


def codec_digest(docs: DataFrame, model: str | None = None, chunk: int = 32768) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_ids, ids_crc32, and whether decoding gives the text back.

    A chunk of a long text leaves its task as a count, a checksum and a truth, which are joined to those of the text.
    A text that holds the word-begin mark itself comes back with a space in its place, as in the library.
    """
    model = model or default_model()
    if not is_bpe(model):
        return piece_codec.codec_digest(docs, model, chunk)
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "n_ids long, ids_crc32 long, round_trip boolean"
    names = ["n_ids", "ids_crc32", "round_trip"]

    def digests(texts: list[str], firsts: list[bool]) -> list[pa.Array]:
        own = merger(model)
        ids = [own.encode(t, f) for t, f in zip(texts, firsts)]
        same = [own.decode(i, f) == t for i, t, f in zip(ids, texts, firsts)]
        return [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(crc32, ids), pa.int64()), pa.array(same, pa.bool_())]

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *digests(texts, [True] * len(texts))], ["doc_id", *names])

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = digests(batch.column("chunk").to_pylist(), [k == 0 for k in batch.column("k").to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *found], ["doc_id", "row", "k", *names])

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for row in parts:
            crc = 0
            for p in sorted(row, key=lambda p: p["k"]):
                crc = joined_crc32(crc, p["ids_crc32"], 4 * p["n_ids"])
            out.append(crc)
        return pd.Series(out, dtype="int64")

    parts = _by_chunks(docs, model, chunk, part, last).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("k", "n_ids", "ids_crc32")).alias("ps"), F.sum("n_ids").alias("n_ids"), F.every("round_trip").alias("round_trip"))
    long = parts.select("doc_id", "n_ids", joined("ps").alias("ids_crc32"), "round_trip")
    return _whole(docs, chunk, whole, f"doc_id {kind}, {last}").unionByName(long)
