"""SimHash near-dedup: segment-popcount embedding, grid range-join, exact check.

A document's fingerprint is the bitwise majority of the hashes of its three-word shingles. Equal
fingerprints are one class. Of two classes that differ in at most ``distance`` (3) bits, one half differs in at most
one bit, so of that half one quarter is equal and the other within one bit. Each other quarter is mapped to the
bit counts of its 2-bit segments, a point of an 8-dimensional grid; the Manhattan distance of two points is a lower
bound of the bits in which the quarters differ, so in that quarter the points are equal or neighbours. Every class
goes, under each equal quarter, to its own cell and, as a neighbour, to the cells one step down in one segment; pairs meet
where one of the two is at home, and their bits are compared. A pair of random fingerprints meets with a chance of about 3e-7.

A cell with many classes (a large group of near copies) is split into blocks by a hash, and pairs of
blocks are compared apart from each other, so no task holds a whole cell; each pair of blocks returns
a spanning forest of its links, not the links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batched, components

#: Classes of a cell that are compared at once. Larger cells are split.
BLOCK = 1024
#: Cells of at most so many rows are joined row by row.
SMALL = 24
#: Fingerprints of a block that are compared with those of the other at once.
STRIP = 128
#: Bytes of a text whose shingles are hashed at once.
SLICE = 1 << 20
WHITE = re.compile(rb"[ \t-\r]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about SLICE bytes, cut where there is white space."""
    at = 0
    while at < len(data):
        cut = WHITE.search(data, at + SLICE)
        stop = cut.start() if cut else len(data)
        yield data[at:stop]
        at = stop


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text; no words: 0. Counts of bits are added up piece by piece, so memory grows with the text's bytes alone."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode()):
        parts = held + piece.lower().split()  # of bytes: A-Z and ASCII white space only
        new = len(parts) - words + 1
        held = parts[max(0, new) :]
        if new > 0:
            ones += _ones(parts, words, new, seed)
            n += new
    if not n:
        if not held:
            return 0
        ones, n = _ones(held, len(held), 1, seed), 1
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _ones(parts: list[bytes], words: int, n: int, seed: int) -> np.ndarray:
    """Of n shingles, how many hashes have each bit set."""
    whole = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts, stops)], "<u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, the fingerprint (bit pattern as a long) of every whole text, and text_hash, which tells rows of one doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

    return batched(docs.select("doc_id", "text", text_hash())).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


def _segment_counts(quarter: Column) -> Column:
    """The bit counts of the eight 2-bit segments, two bits each: the point, as one number."""
    low = quarter.bitwiseAND(F.lit(0x5555))
    high = F.shiftrightunsigned(quarter, 1).bitwiseAND(F.lit(0x5555))
    return low + high  # no carry leaves a segment: counts are 0 to 2


def _cells(classes: DataFrame) -> DataFrame:
    """(fp, cell, home): for each quarter, taken as equal, the cell of its half's other quarter, and those one step down in one segment."""
    quarter = [F.shiftrightunsigned(F.col("fp"), 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    keys = F.array(*(F.struct((quarter[q] * (1 << 16) + (q << 32)).alias("base"), _segment_counts(quarter[q ^ 1]).alias("point")) for q in range(4)))
    halves = classes.select("fp", F.explode(keys).alias("x")).select("fp", "x.base", "x.point")
    steps = F.array_compact(F.array(*(F.when(F.col("point").bitwiseAND(F.lit(3 << 2 * s)) > 0, F.col("point") - F.lit(1 << 2 * s)) for s in range(8))))
    cells = F.concat(F.array(F.struct(F.col("point").alias("cell"), F.lit(True).alias("home"))), F.transform(steps, lambda x: F.struct(x.alias("cell"), F.lit(False).alias("home"))))
    return halves.select("fp", "base", F.explode(cells).alias("x")).select("fp", (F.col("base") + F.col("x.cell")).alias("cell"), "x.home")


def _forest(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between fingerprints a and b: each linked one with the least of its component here."""
    both, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b, root = where[: len(a)], where[len(a) :], np.arange(len(both))
    for begin in range(0, len(a), STRIP):
        near = np.bitwise_count(a[begin : begin + STRIP, None] ^ b[None, :]) <= distance
        i, j = np.nonzero(near)
        i, j = root[at_a[begin + i]], root[at_b[j]]
        while len(apart := np.nonzero(i != j)[0]):
            i, j = i[apart], j[apart]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root != (up := root[root])).any():
                root = up
            i, j = root[i], root[j]
    moved = root != np.arange(len(both))
    return both[moved], both[root[moved]]


def fingerprint_links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` as those within ``distance`` bits do; ``distance`` is 3 at most."""
    if distance > 3:
        raise ValueError("two halves of two quarters cover up to 3 bits")
    cells = _cells(classes)
    size = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).where("n > 1 and n_home > 0")
    # Spark takes a table that grew in a generator for as small as it was before, hence the hints: none of these may be broadcast
    met = cells.hint("merge").join(size, "cell")
    few, many = met.where(F.col("n") <= SMALL), met.where(F.col("n") > SMALL)

    left = few.where("home").select("cell", F.col("fp").alias("a"))
    right = few.select("cell", F.col("fp").alias("b"), "home")
    links = left.hint("merge").join(right, "cell").where("(a < b or not home) and a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")

    split = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp", "cell"), F.col("blocks")).cast("int"))
    pairs = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "fp", "home", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, home, first = pdf.fp.to_numpy().view(np.uint64), pdf.home.to_numpy(), (pdf.own == pdf.p).to_numpy()
        if pdf.p.iat[0] == pdf.q.iat[0]:
            todo = [(fp[home], fp)]
        else:  # two away from home need not meet
            todo = [(fp[first & home], fp[~first]), (fp[first & ~home], fp[~first & home])]
        found = [_forest(a, b, distance) for a, b in todo if len(a) and len(b)] or [(np.empty(0, np.uint64),) * 2]
        return pd.DataFrame({"a": np.concatenate([f[0] for f in found]).view(np.int64), "b": np.concatenate([f[1] for f in found]).view(np.int64)})

    return links.unionByName(pairs.groupBy("cell", "p", "q").applyInPandas(block, "a long, b long"))


def simhash_dedup(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """Groups of near copies: a row a document with doc_id, fingerprint, component_id, kept and text_hash.

    docs: doc_id, text; other columns are ignored. Null and empty texts and texts without a
    word have fingerprint zero and link like any other; fewer words than a shingle are one shingle. The
    component_id is the smallest doc_id reachable by links of at most ``distance`` differing bits, a null
    doc_id being larger than any (component_id is null only if all of a group are); kept marks the
    documents that bear it. Repeated rows each return; rows of one doc_id with different texts are decided apart, by text_hash. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs, words))
    rows = marked.count()
    classes = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), rows)
    joined = components(docs.sparkSession, fingerprint_links(classes.select("fp"), distance), Scratch(docs.sparkSession, "simhash-links"))
    roots = classes.join(joined, classes.fp == joined.id, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = scratch.write(roots.join(named, "root").select("fp", "component_id"), rows)
    return marked.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, distance: int = 3, words: int = 3) -> DataFrame:
    """The documents, with their own columns, less those with a near copy of a smaller doc_id in their group. Rows of a null doc_id stay."""
    gone = simhash_dedup(docs, distance, words).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    own = docs.select(F.struct(*docs.columns).alias("row"))
    same = (F.col("row.doc_id") == F.col("_id")) & (F.xxhash64("row.text") == F.col("_hash"))
    return own.join(gone, same, "left_anti").select("row.*")
