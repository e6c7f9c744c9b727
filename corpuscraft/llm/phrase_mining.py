"""Phrase collocation mining by prefix-free parsing.

1. Every text is parsed into chunks. Where the hash of a window of ``overlap`` words is divisible by ``period`` a chunk begins,
   and the one before ends with that window, so neighbours overlap by it. Where a chunk begins depends on its
   content alone: copies of a text, a passage or a line give the same chunks, wherever they stand.
2. The distinct chunks, each with its frequency in the parse, are the dictionary.
3. Phrases are counted inside the distinct chunks only, weighted by the frequency. A phrase belongs to the chunk in which it
   begins before the closing overlap, which holds all of it, so what lies in an overlap counts once.
4. Lengths go up by one. A phrase can be frequent only if what is left without its last and without its first word is, so
   each level passes a filter of the hashes of the frequent phrases before to the next: a bitmap of fixed size, which may
   let a rare phrase pass (its count then drops it) but never stops a frequent one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batched

#: Bits of the filter of frequent phrases: 8 MB, however many there are.
FILTER_BITS = 1 << 26
#: Bits of a row in which the filter reaches the driver.
FILTER_BLOCK = 1 << 16
#: Bytes of chunks that are counted at once.
COUNTED = 16 << 20
#: Words after which a chunk ends without a window that says so.
LONGEST = 512
#: A-Z in lower case; line ends and punctuation that part pieces as line feeds, a tab as a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))
_MIX, _MIX2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


@dataclass
class Words:
    """The words of some normalized texts, which lie behind one another with line feeds between."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: Number of line feeds before each word: words of one piece have the same.
    piece: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Words:
        raw = np.frombuffer(data, np.uint8)
        breaks = raw == 10
        inside = np.concatenate([[False], (raw != 32) & ~breaks, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        return cls(raw, starts, ends, np.searchsorted(np.flatnonzero(breaks), starts))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's length and first eight bytes, which places chunks and nothing else."""
        eight = np.ndarray((len(self.data),), "<u8", np.append(self.data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
        length = self.ends - self.starts
        kept = np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(length, 8))).astype(np.uint64)
        return ((eight[self.starts] & kept) + length.astype(np.uint64)) * _MIX2

    def strings(self) -> pa.BinaryArray:
        inside = (self.data != 32) & (self.data != 10)
        offsets = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[inside].tobytes())])


def normalized(text: bytes) -> bytes:
    return text.translate(_TABLE)


def chunk_begins(words: Words, overlap: int, period: int) -> np.ndarray:
    """The words with which the chunks of a single text begin, the first included."""
    n = len(words.starts)
    h = words.hashes()
    places = max(0, n - overlap + 1)
    window = np.zeros(places, np.uint64)
    for i in range(overlap):
        window = (window ^ h[i : i + places]) * _MIX
        window ^= window >> np.uint64(29)
    window = (window * _MIX2) >> np.uint64(33)
    begins = np.flatnonzero(window % np.uint64(period) == 0)
    begins = np.unique(np.concatenate([[0], begins[begins > 0]])) if n else begins
    gaps = np.diff(np.append(begins, n))
    if len(gaps) and gaps.max() > LONGEST:  # counted from the begin, so copies are cut alike
        begins = np.concatenate([np.arange(b, b + g, LONGEST) for b, g in zip(begins.tolist(), gaps.tolist())])
    return begins


def chunks(text: bytes, overlap: int = 2, period: int = 32) -> list[tuple[bytes, int]]:
    """The chunks of a whole text, and of each how many of its words don't belong to the overlap that closes it."""
    data = normalized(text)
    words = Words.of(data)
    n = len(words.starts)
    if not n:
        return []
    begins = chunk_begins(words, overlap, period)
    own = np.diff(np.append(begins, n))
    last = np.minimum(begins + own + overlap - 1, n - 1)
    return [(data[a:b], k) for a, b, k in zip(words.starts[begins].tolist(), words.ends[last].tolist(), own.tolist())]


def dictionary(docs: DataFrame, overlap: int, period: int) -> DataFrame:
    """(lang, chunk, own, n): the distinct chunks of all texts, how many words belong to each, and its frequency in the parse."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, bytes, int]] = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                found.update([(lang, chunk, own) for chunk, own in chunks(text.as_py(), overlap, period)])
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array([k[2] for k in keys], pa.int32()), pa.array(found.values(), pa.int64())], ["lang", "chunk", "own", "n"])

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    parsed = batched(rows).mapInArrow(parse, "lang string, chunk binary, own int, n long")
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n"))


def _places(lang: str, hashes: list[np.ndarray]) -> np.ndarray:
    """Where the filter keeps the phrases whose words have these hashes, the first words' in the first array."""
    place = np.full(len(hashes[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for h in hashes:
        place = (place ^ h) * _MIX
        place ^= place >> np.uint64(29)
    return place & np.uint64(FILTER_BITS - 1)


def _word_hashes(words: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """A hash of each word by its number, and the words as numbers."""
    coded = words.dictionary_encode()
    return np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in coded.dictionary), np.uint64, len(coded.dictionary)), coded


def frequent_filter(frequent: DataFrame, size: int) -> np.ndarray:
    """The bitmap of the phrases of ``size`` words in frequent (lang, phrase), as bytes. What reaches the driver is FILTER_BITS at most."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                phrases = batch.column("phrase").filter(pa.array(langs == lang))
                hashes, coded = _word_hashes(pc.list_flatten(pc.split_pattern(phrases, " ")))
                h = hashes[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_places(lang, list(h.T))).astype(np.int64))], ["place"])

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), batch.column("places")):
                row = np.zeros(FILTER_BLOCK, np.uint8)
                row[own.values.to_numpy(zero_copy_only=False)] = 1
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bits": pa.array([np.packbits(row, bitorder="little").tobytes()], pa.binary())})

    found = batched(frequent.select("lang", "phrase")).mapInArrow(places, "place long").distinct()
    rows = found.groupBy(F.floor(F.col("place") / FILTER_BLOCK).alias("block")).agg(F.collect_list((F.col("place") % FILTER_BLOCK).cast("int")).alias("places"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows.mapInArrow(bits, "block long, bits binary").toLocalIterator():
        out[row.block * FILTER_BLOCK // 8 : (row.block + 1) * FILTER_BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def _counted(lang: str, chunks: pa.BinaryArray, own: np.ndarray, n: np.ndarray, size: int, passing: np.ndarray | None) -> tuple[pa.Array, np.ndarray, int]:
    """The phrases of ``size`` words that begin in the own words of some chunks, the sums of their frequencies, and that of all own words."""
    lengths = pc.binary_length(chunks).to_numpy(zero_copy_only=False)
    words = Words.of(pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), b"\n")[0].as_buffer().to_pybytes())
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    first = np.searchsorted(words.starts, begins)
    chunk = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words.starts))))
    is_own = np.arange(len(chunk)) - first[chunk] < own[chunk]
    weight = n[chunk]
    total = int(weight[is_own].sum())
    strings = words.strings()
    if size == 1:
        coded = strings.dictionary_encode()
        ids, at = coded.indices.to_numpy(zero_copy_only=False), np.flatnonzero(is_own)
    else:
        hashes, coded = _word_hashes(strings)
        ids = coded.indices.to_numpy(zero_copy_only=False)
        h = hashes[ids]
        part = len(h) - size + 2  # places of the shorter phrases
        if part < 2:
            return pa.array([], pa.binary()), np.empty(0, np.int64), total
        place = _places(lang, [h[i : i + part] for i in range(size - 1)])
        likely = (passing[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
        whole = words.piece[size - 1 :] == words.piece[: part - 1]
        at = np.flatnonzero(is_own[: part - 1] & whole & (likely[:-1] & likely[1:]).astype(bool))
    if not len(at):
        return pa.array([], pa.binary()), np.empty(0, np.int64), total
    key, known = ids[at].astype(np.int64), len(coded.dictionary)
    for i in range(1, size):
        if known * len(coded.dictionary) >= 2**62:
            key, distinct = pd.factorize(key)
            known = len(distinct)
        key = key * len(coded.dictionary) + ids[at + i]
        known *= len(coded.dictionary)
    group, distinct = pd.factorize(key)
    sums, example = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    np.add.at(sums, group, weight[at])
    example[group] = np.arange(len(group))
    columns = [coded.dictionary.take(pa.array(ids[at[example] + i])) for i in range(size)]
    return pc.binary_join_element_wise(*columns, b" ") if size > 1 else columns[0], sums, total


def phrase_counts(chunks: DataFrame, size: int, passing: np.ndarray | None) -> DataFrame:
    """(lang, phrase, f): how often each phrase of ``size`` words occurs; of longer ones than a word, those whose parts pass. For words, a null phrase has the sum of all."""
    sent = chunks.sparkSession.sparkContext.broadcast(passing) if passing is not None else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.RecordBatch]] = {}
        bytes_held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, batches in held.items():
                rows = pa.Table.from_batches(batches).combine_chunks()
                chunks, own, n = (rows.column(c).chunk(0) for c in ("chunk", "own", "n"))
                phrases, sums, total = _counted(lang, chunks, own.to_numpy(), n.to_numpy(), size, None if sent is None else sent.value)
                if size == 1:
                    phrases, sums = pa.concat_arrays([phrases, pa.array([None], pa.binary())]), np.append(sums, total)
                for i in range(0, len(sums), 100_000):
                    some = phrases[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(some)), some.cast(pa.string()), pa.array(sums[i : i + 100_000])], ["lang", "phrase", "f"])

        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                some = batch.filter(pc.equal(batch.column("lang"), lang))
                held.setdefault(lang, []).append(some.select(["chunk", "own", "n"]))
            bytes_held += pc.sum(pc.binary_length(batch.column("chunk"))).as_py() or 0
            if bytes_held >= COUNTED:
                yield from out()
                held, bytes_held = {}, 0
        yield from out()

    # a task has added up what it could: rows go to their phrase's task as they are, COUNTED bytes of chunks a row at most for each phrase
    found = batched(chunks).mapInArrow(count, "lang string, phrase string, f long")
    return found.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _score(a: Column, parts: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly: counts up to 10^15."""
    whole, l, r = (c.cast("decimal(15,0)") for c in (a, parts["l"], parts["r"]))
    return F.call_function("div", whole * whole * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def phrase_collocations(docs: DataFrame, max_words: int = 3, least: int = 10, ranks: int = 2000, share: int = 50, period: int = 32) -> DataFrame:
    """Each language's best phrases: (lang, rank, phrase, a, l, r, n, score).

    docs: lang, text; other columns are ignored. A null text is empty, a null lang is ``und``. Texts, A-Z in lower case, are
    split at ``. , ; : ! ?`` and line ends into pieces, and those at spaces and tabs into words. n counts all words of a
    language. Candidates are phrases of 2 to ``max_words`` words in one piece that occur a >= ``least`` times, overlaps
    included. The cut after k words with the lowest score floor(1e6 a^2 / (l r)) counts, of equals the smallest k; l and r are how often
    its two parts occur. Candidates inside a longer candidate with at least ``share`` percent of their
    count are dropped. Ranks begin with 1: by score, then a, from the highest, then by the phrase in the order of UTF-8 bytes. A
    language without a candidate has no row; no rows give no rows. Repeated rows count as often as they stand there. ``period`` sets how long chunks
    are, not what is found. A task holds a batch of texts, one text at least, or COUNTED bytes of chunks.
    """
    if max_words < 2:
        raise ValueError("a phrase has two words at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    parsed = scratch.write(dictionary(docs, max_words - 1, period))
    levels: list[DataFrame] = []
    for size in range(1, max_words + 1):
        passing = frequent_filter(levels[-1].where("phrase is not null"), size - 1) if levels else None
        counted = phrase_counts(parsed, size, passing)
        levels.append(scratch.write(counted.where((F.col("f") >= least) | F.col("phrase").isNull())))
    scratch.drop(1)
    totals = levels[0].where("phrase is null").select("lang", F.col("f").alias("n"))
    known = levels[0].where("phrase is not null")
    for level in levels[1:-1]:
        known = known.unionByName(level)
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)

    words = F.split("phrase", " ")
    piece = lambda begin, length: F.array_join(F.slice("words", begin, length), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("first"), piece(k + 1, F.size("words") - k).alias("rest")))
    cut = found.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).select("lang", "phrase", "a", F.explode(cuts).alias("x")).select("lang", "phrase", "a", "x.*")
    both = cut.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = both.withColumn("score", _score(F.col("a"), {"l": F.col("l"), "r": F.col("r")}))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.score", "x.l", "x.r", "x.a")

    if max_words > 2:
        longer = levels[2]
        for level in levels[3:]:
            longer = longer.unionByName(level)
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda b: piece(b, k))))
        inside = longer.select("lang", "f", words.alias("words")).select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        best = best.join(inside, ["lang", "phrase"], "left").where(F.expr(f"most is null or cast(100 as decimal(3,0)) * cast(most as decimal(19,0)) < cast({share} as decimal(3,0)) * cast(a as decimal(19,0))"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = best.withColumn("rank", rank).where(F.col("rank") <= ranks)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
