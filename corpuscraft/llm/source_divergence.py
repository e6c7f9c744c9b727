"""Source divergence audit over run-length columns.

Each language keeps the terms that enough of its documents have; each of its sources is a column of counts over them.

1. Tasks count terms for each (language, source) in a bounded table of their own; sums meet by shuffle.
2. The vocabulary is reordered: terms with equal counts in every source become one profile with a multiplicity, and
   profiles are sorted by their counts, so equal counts of a source lie side by side.
3. The sorted profiles are cut into blocks; in each, every source's column is run-length encoded. Absent sources are
   one run of zero.
4. For each pair of sources of a block the boundaries of their runs are intersected, and the divergence f
   of an intersected run is multiplied by its length. A block gives one sum a pair.

All arithmetic is on integers; where a product may pass 64 bits it is done in Python's integers or Spark's decimals.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, batched

#: Probabilities are counted in units of one over this.
UNIT = 1_000_000_000
#: Entries of a task's own table of counts; a full one is sent on.
ENTRIES = 400_000
#: Profiles, and counts over zero, of a block.
BLOCK, BLOCK_COUNTS = 65_536, 1_000_000
#: Counts up to which UNIT times them fits 64 bits.
SAFE = 9_000_000_000
#: Parts into which a language's blocks are dealt when they meet the table of its sources.
PARTS = 32
#: Terms are what is left when these bytes count as white space, and A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
#: A document in a sum of occurrences and documents.
_DOC = 1 << 44


def terms(text: bytes) -> list[bytes]:
    """The terms of a text as UTF-8: runs of letters A-Z, lower-cased, and of anything beyond ASCII."""
    return text.translate(_TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term; a row with a null term stands for each (lang, source) itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in held.items():
                words = [None, *own]
                sums = [0, *own.values()]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(words), pa.string()), "source": pa.array([source] * len(words), pa.string()), "term": pa.array(words, pa.binary()).cast(pa.string()),
                    "n": pa.array([s % _DOC for s in sums], pa.int64()), "docs": pa.array([s // _DOC for s in sums], pa.int64()),
                })

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text")):
                own = held.setdefault((lang, source), {})
                before, get = len(own), own.get
                for word, n in Counter(terms(text.as_py())).items():
                    own[word] = get(word, 0) + n + _DOC
                size += len(own) - before + 1
                if size > ENTRIES:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    filled = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(*filled, F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = batched(rows).mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Audit:
    """The tables of an audit, written once: ``kept`` (lang, term, counts by source, total) and ``groups`` (lang, source, n, n_lang, n_terms)."""

    def __init__(self, docs: DataFrame, least_docs: int = 3):
        spark = docs.sparkSession
        self.scratch = Scratch(spark, "divergence")
        counted = term_counts(docs)
        by_source = F.struct("source", "n")
        gathered = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(by_source)).alias("counts"))
        # the rows of a null term name the sources of a language; they go along
        self.kept = self.scratch.write(gathered.where((F.col("docs") >= least_docs) | F.col("term").isNull()).select("lang", "term", "total", "counts"))
        sums = self.kept.select("lang", F.explode("counts").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("n"))
        langs = self.kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("term").alias("n_terms"))
        self.groups = self.scratch.write(sums.join(langs, "lang").select("lang", "source", "n", "n_lang", "n_terms"))
        self.kept = self.kept.where("term is not null")


def run_length_blocks(kept: DataFrame) -> DataFrame:
    """(lang, block, n_terms, columns): the vocabulary, reordered and cut into blocks; ``columns`` has the runs of each source that is in it.

    A column is (source, ends, counts): run i covers the terms of the block from the end before to ``ends[i]``.
    """
    profiles = kept.groupBy("lang", "counts").agg(F.count("*").alias("n_terms"))
    # ranges are cut by a short key, as what cuts them reaches the driver: profiles that begin alike are dealt by a hash
    ordered = profiles.repartitionByRange("lang", F.slice("counts", 1, 2), F.xxhash64("counts")).sortWithinPartitions("lang", "counts")
    kind = "lang string, block long, n_terms long, columns array<struct<source: string, ends: array<bigint>, counts: array<bigint>>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        lang: str | None = None
        columns: dict[str, tuple[list[int], list[int]]] = {}  # source: ends and counts, the last run open
        at = profiles = entries = 0

        def close() -> pa.RecordBatch:
            rows = []
            for source, (ends, counts) in sorted(columns.items()):
                if ends[-1] < at:  # what follows is zero
                    ends, counts = [*ends, at], [*counts, 0]
                rows.append({"source": source, "ends": ends, "counts": counts})
            struct = pa.struct([("source", pa.string()), ("ends", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
            return pa.RecordBatch.from_pydict({"lang": [lang], "block": pa.array([block], pa.int64()), "n_terms": pa.array([at], pa.int64()), "columns": pa.array([rows], pa.list_(struct))})

        for batch in batches:
            begins, flat = batch.column("counts").offsets.to_pylist(), batch.column("counts").values
            named = flat.field("source").dictionary_encode()
            names, which, values = named.dictionary.to_pylist(), named.indices.to_pylist(), flat.field("n").to_pylist()
            for i, (own, n) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("n_terms").to_pylist())):
                if at and (own != lang or profiles >= BLOCK or entries >= BLOCK_COUNTS):
                    yield close()
                    block += 1
                    columns, at, profiles, entries = {}, 0, 0, 0
                lang = own
                for j in range(begins[i], begins[i + 1]):
                    ends, counts = columns.setdefault(names[which[j]], ([], []))
                    if (ends[-1] if ends else 0) < at:
                        ends.append(at)
                        counts.append(0)
                    if counts and counts[-1] == values[j]:
                        ends[-1] = at + n
                    else:
                        ends.append(at + n)
                        counts.append(values[j])
                entries += begins[i + 1] - begins[i]
                at += n
                profiles += 1
        if at:
            yield close()

    return batched(ordered).mapInArrow(encode, kind)


def _divergence(p: np.ndarray, q: np.ndarray, length: np.ndarray) -> int:
    """The sum of floor((p - q)**2 / q) times length; p and q are at most UNIT + 1."""
    f = (p - q) ** 2 // q
    if int(f.max()) * int(length.sum()) < 2**62:
        return int(f @ length)
    return sum(map(int.__mul__, f.tolist(), length.tolist()))


def intersected(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of two run-length columns (ends, values): the values of both on each intersected run, and its length."""
    ends = np.union1d(one[0], other[0])
    return one[1][np.searchsorted(one[0], ends)], other[1][np.searchsorted(other[0], ends)], np.diff(ends, prepend=0)


def pair_sums(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of each ordered pair of a language's sources over all its kept terms."""
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", (F.col("n") + F.col("n_terms")).alias("size")))).alias("sources"))
    listed = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)).cast("int")).join(listed, ["lang", "part"]).select("lang", "n_terms", "columns", "sources")
    kind = "lang string, source string, item string, value decimal(38,0)"

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(3)), pa.array([Decimal(sums[k]) for k in keys], pa.decimal128(38, 0))], ["lang", "source", "item", "value"])

        for batch in batches:
            for i in range(batch.num_rows):
                lang, n, columns, sources = (batch.column(c)[i].as_py() for c in ("lang", "n_terms", "columns", "sources"))
                own = {x["source"]: x for x in columns}
                runs = {}
                for s in sources:
                    x, size = own.get(s["source"], {"ends": [n], "counts": [0]}), s["size"]
                    runs[s["source"]] = np.array(x["ends"], np.int64), np.array([1 + UNIT * (c + 1) // size for c in x["counts"]], np.int64)
                for a, b in combinations(runs, 2):
                    p, q, length = intersected(runs[a], runs[b])
                    for key, f in (((lang, a, b), _divergence(p, q, length)), ((lang, b, a), _divergence(q, p, length))):
                        sums[key] = sums.get(key, 0) + f
                if len(sums) > ENTRIES:
                    yield out()
                    sums = {}
        if sums:
            yield out()

    return batched(dealt).mapInArrow(pairs, kind).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _shares(rows: DataFrame) -> DataFrame:
    """rows (n, total, n_group, n_lang, n_terms) with p and q, exactly."""
    parts = {"p": ("n", "n_group"), "q": ("total", "n_lang")}
    share = "1 + case when {0} < %d then (%d * ({0} + 1)) div ({1} + n_terms) else cast((cast(%d as decimal(10,0)) * (cast({0} as decimal(20,0)) + 1)) div cast({1} + n_terms as decimal(20,0)) as bigint) end" % (SAFE, UNIT, UNIT)
    return rows.select("*", *(F.expr(share.format(count, size)).alias(c) for c, (count, size) in parts.items()))


def term_rows(audit: Audit, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): of each source the ``ranks`` terms that lie highest over their language's share."""
    rows = audit.kept.select("lang", "term", "total", F.explode("counts").alias("x")).select("lang", "term", "total", "x.source", "x.n")
    sizes = audit.groups.select("lang", "source", F.col("n").alias("n_group"), "n_lang", "n_terms")
    shared = _shares(rows.join(sizes, ["lang", "source"])).where("p > q")
    valued = shared.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    return ranked(valued).where(F.col("rank") <= ranks)


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def source_divergence(docs: DataFrame, least_docs: int = 3, ranks: int = 200) -> DataFrame:
    """How the sources of each language differ in their words: (lang, source, part, item, value, rank).

    docs: lang, source, text; other columns are ignored. Nulls in them count as empty strings. A language keeps the terms that at least
    ``least_docs`` of its documents have (repeated rows are documents of their own). With ``count``
    occurrences of a kept term in a source and N of all V kept terms, p = 1 + floor(1e9 (count + 1) / (N + V)); q is the
    same of the other source (part ``pair``, f = floor((p - q)^2 / q) summed over all kept terms, every other
    source of the language) or of the whole language (part ``term``, single terms with a count and p > q, the first
    ``ranks``). Ranks begin with 1, by value from the highest, then by item in the order of UTF-8 bytes. A language without a kept
    term has pairs of value 0; one of a single source has none. No rows give no rows.
    """
    audit = Audit(docs, least_docs)
    other = audit.groups.select("lang", F.col("source").alias("item"))
    pairs = audit.groups.select("lang", "source").join(other, "lang").where("source <> item")
    sums = pair_sums(run_length_blocks(audit.kept), audit.groups)
    valued = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce(F.col("value"), F.lit(0)).cast("long").alias("value"))
    parts = [(ranked(valued), "pair"), (term_rows(audit, ranks), "term")]
    one, two = (rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for rows, part in parts)
    return one.unionByName(two)
