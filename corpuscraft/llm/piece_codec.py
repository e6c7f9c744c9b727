"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces and scores of a SentencePiece model are read as a lattice: the encoding of a text is the sequence of pieces
with the highest summed score (the first found of equal ones), and characters without a piece fall back to byte pieces. Texts of at
most ``chunk`` characters are encoded in one go. Longer ones are split, in any place, into chunks:

1. The state at a boundary is by how many characters the piece across it reaches into the next chunk. Each chunk
   yields its transfer matrix: the best score for each pair of states at its begin and end.
2. Max-plus products of matrices are associative, so runs of ``RUN`` chunks are multiplied in parallel, a
   document's runs are scanned, and each run hands its states down to its chunks.
3. Each chunk, its two states now known, is traced back by itself.

No piece holds a word-begin mark behind another character, so words don't share pieces and every distinct word
of a task is encoded once.

A model of the BPE kind has merge ranks as scores; this encoding maximizes their sum as for a unigram model, which
isn't what merging gives. Decoding is the same for both kinds.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MARK = "▁"
#: Words that a worker remembers; further ones are encoded anew. The ids don't depend on it.
REMEMBERED = 300_000
#: Chunks whose matrices are multiplied in one go.
RUN = 64

_CODECS: dict[str, PieceCodec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        kinds = range(m.get_piece_size())
        self.bytes = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        self.table: list[bytes] = []
        for i in kinds:
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.table.append(b"")
            else:
                self.pieces[piece] = (i, m.get_score(i))
                self.table.append(piece.replace(MARK, " ").encode())
        self.unknown = m.unk_id()
        self.least = min(s for _, s in self.pieces.values()) - 10
        self.reach = max(map(len, self.pieces))
        #: Two characters that no piece has side by side part a word in two.
        self.neighbours = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces across words aren't supported")
        # a line feed that is in no piece parts words as well
        alone = "" if any("\n" in p for p in self.pieces) else "\n"
        self.cut = re.compile(f"{alone}|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def _forward(self, text: str, stop: int, start: dict[int, float]) -> tuple[list[float], list[int]]:
        """Best scores and earliest begins of the last piece at each place of text; pieces begin before ``stop``."""
        pieces, prefixes, n, reach = self.pieces, self.prefixes, len(text), self.reach
        never = float("-inf")
        best, begin = [never] * (n + 1), [-1] * (n + 1)
        for at, score in start.items():
            best[at] = score
        for i in range(min(stop, n)):
            here = best[i]
            if here == never:
                continue
            single = False
            for j in range(i + 1, (i + reach if i + reach < n else n) + 1):
                part = text[i:j]
                if part not in prefixes:
                    break
                found = pieces.get(part)
                if found:
                    if j == i + 1:
                        single = True
                    if here + found[1] > best[j]:
                        best[j], begin[j] = here + found[1], i
            if not single and here + self.least > best[i + 1]:
                best[i + 1], begin[i + 1] = here + self.least, i
        return best, begin

    def _ids(self, text: str, begin: list[int], end: int, start: int) -> bytes:
        out: list[int] = []
        while end > start:
            piece = text[begin[end] : end]
            found = self.pieces.get(piece)
            if found:
                out.append(found[0])
            else:
                out += [self.bytes.get(b, self.unknown) for b in reversed(piece.encode())]
            end = begin[end]
        return array("I", out[::-1]).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a stretch that no piece leaves."""
        found = self.known.get(word)
        if found is None:
            near = self.neighbours
            cuts = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in near), len(word)]
            if len(cuts) > 2:
                found = b"".join([self.word(word[a:b]) for a, b in zip(cuts, cuts[1:])])
            else:
                _, begin = self._forward(word, len(word), {0: 0.0})
                found = self._ids(word, begin, len(word), 0)
            if len(self.known) < REMEMBERED:
                self.known[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join([self.word(w) for w in self.cut.findall(self.normal(text))])

    def decode(self, ids: bytes) -> str:
        table = self.table
        raw = b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode(errors="replace").removeprefix(" ")

    def _spans(self, chunk: str, ahead: str) -> list[tuple[int, int]]:
        """The words of a chunk and what follows it; the first may have begun before it."""
        return [m.span() for m in self.cut.finditer(chunk + ahead)]

    def transfer(self, chunk: str, ahead: str, whole: bool = False) -> np.ndarray:
        """The matrix of a chunk: best score from entering at offset i to leaving at offset j behind its end.

        All ways go through the same words between the first and the last place that no piece crosses, so their scores
        decide nothing and are left out, unless the ``whole`` score is asked for.
        """
        n, size = len(chunk), self.reach
        out = np.full((size, size), -np.inf)
        text, spans = chunk + ahead, self._spans(chunk, ahead)
        inner = [a for a, _ in spans if 0 < a <= n]  # places that no piece crosses
        if not inner:
            for i in range(min(size, n + 1)):
                best, _ = self._forward(text, n, {i: 0.0})
                for j in range(min(size, len(text) - n + 1)):
                    out[i, j] = best[n + j]
            return out
        first, last = inner[0], inner[-1]
        middle = sum(self._forward(text[a:b], b - a, {0: 0.0})[0][-1] for a, b in spans if a >= first and b <= last) if whole else 0.0
        tail, _ = self._forward(text[last:], n - last, {0: 0.0})
        for i in range(min(size, first + 1)):
            head, _ = self._forward(text[i:first], first - i, {0: 0.0})
            for j in range(min(size, len(text) - n + 1)):
                out[i, j] = head[first - i] + middle + tail[n - last + j]
        return out

    def trace(self, chunk: str, ahead: str, enter: int, leave: int) -> bytes:
        """The ids of a chunk between two states: pieces that begin in it."""
        n, text = len(chunk), chunk + ahead
        if enter >= n:
            return b""
        spans = [(max(a, enter), b) for a, b in self._spans(chunk, ahead) if b > enter and a < n]
        out = []
        for a, b in spans:
            if b <= n and a > enter:
                out.append(self.word(text[a:b]))
            else:
                end = min(b, n + leave)
                own = text[a:end]
                _, begin = self._forward(own, max(0, n - a), {0: 0.0})
                out.append(self._ids(own, begin, len(own), 0))
        return b"".join(out)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The best states at all boundaries of consecutive matrices, from ``enter`` to ``leave``."""
    ahead = [np.where(np.arange(len(matrices[0])) == enter, 0.0, -np.inf)]
    for m in matrices[:-1]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    out = [leave]
    for v, m in zip(reversed(ahead), reversed(matrices)):
        out.append(int((v + m[:, out[-1]]).argmax()))
    return out[::-1]


def codec(path: str) -> PieceCodec:
    """One codec a worker process and model."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str | None = None, chunk: int = 32768) -> DataFrame:
    """Encodes every whole text: doc_id, text, ids (binary: little-endian unsigned 32-bit).

    docs: doc_id, text; other columns are ignored. Null and empty texts have no ids (the text returns as it was).
    Repeated rows each return; no rows give no rows. Texts longer than ``chunk`` characters take the
    parallel scan, so a task works on chunks, whatever the length of a text; matrices of a document take
    2 KB a chunk.
    """
    model = model or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded(docs, model, chunk, lambda batch: batch, f"doc_id {kind}, text string, ids binary")


def _encoded(docs: DataFrame, model: str, chunk: int, finish: Callable[[pa.RecordBatch], pa.RecordBatch], shape: str) -> DataFrame:
    """What ``finish`` makes of batches of doc_id, text and ids."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(model).encode
        for batch in batches:
            ids = [encode(t.as_py() or "") for t in batch.column("text")]
            yield finish(pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                normal = own.normal(text.as_py())
                for k, at in enumerate(range(0, len(normal), chunk)):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "k": pa.array([k], pa.int64()), "chunk": pa.array([normal[at : at + chunk]]), "ahead": pa.array([normal[at + chunk : at + chunk + own.reach - 1]])})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            found = [own.transfer(c, a).tobytes() for c, a in zip(batch.column("chunk").to_pylist(), batch.column("ahead").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(found, pa.binary())], ["row", "k", "matrix"])

    def square(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw).reshape(round((len(raw) / 8) ** 0.5), -1)

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        total = square(pdf.matrix.iat[0])
        for raw in pdf.matrix[1:]:
            total = product(total, square(raw))
        return pd.DataFrame({"row": pdf["row"][:1], "run": pdf["run"][:1], "matrix": [total.tobytes()]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("run")
        found = states([square(m) for m in pdf.matrix], 0, 0)
        return pd.DataFrame({"row": pdf["row"], "run": pdf["run"], "first": found[:-1], "last": found[1:]})

    def hand_down(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("k")
        found = states([square(m) for m in left.matrix], int(right["first"].iat[0]), int(right["last"].iat[0]))
        return pd.DataFrame({"row": left["row"], "k": left["k"], "enter": found[:-1], "leave": found[1:]})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            found = [own.trace(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ahead", "enter", "leave")))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(found, pa.binary())], ["row", "k", "ids"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"][:1], "ids": [b"".join(pdf.sort_values("k").ids)]})

    short = rows.where(~long).mapInArrow(whole, shape)
    scratch = Scratch(spark, "pieces")
    giants = scratch.write(rows.where(long).withColumn("row", F.monotonically_increasing_id()))
    chunks = scratch.write(giants.select("row", "text").mapInArrow(split, "row long, k long, chunk string, ahead string"))
    by_chunk = scratch.write(chunks.mapInArrow(matrices, "row long, k long, matrix binary").withColumn("run", F.floor(F.col("k") / RUN)))
    runs = by_chunk.groupBy("row", "run").applyInPandas(multiply, "row long, run long, matrix binary")
    ends = runs.groupBy("row").applyInPandas(scan, "row long, run long, first int, last int")
    known = by_chunk.groupBy("row", "run").cogroup(ends.groupBy("row", "run")).applyInPandas(hand_down, "row long, k long, enter int, leave int")
    traced = chunks.join(known, ["row", "k"]).mapInArrow(trace, "row long, k long, ids binary")
    whole_ids = traced.groupBy("row").applyInPandas(join, "row long, ids binary")
    finished = giants.join(whole_ids, "row").select("doc_id", "text", "ids").mapInArrow(lambda batches: map(finish, batches), shape)
    return short.unionByName(finished)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of encode_documents with ``decoded``: the text that the ids stand for (of none: empty)."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(model).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([decode(i.as_py()) for i in batch.column("ids")], pa.string())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", StringType()))


def codec_digest(docs: DataFrame, model: str | None = None, chunk: int = 32768) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_ids, ids_crc32, and whether decoding gives the text back.

    A text that holds the word-begin mark itself comes back with a space in its place, as in the library.
    """
    model = model or default_model()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode, ids = codec(model).decode, batch.column("ids").to_pylist()
        same = [decode(i) == (t.as_py() or "") for i, t in zip(ids, batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(map(crc32, ids), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return _encoded(docs, model, chunk, digest, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean")
