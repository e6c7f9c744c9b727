"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines of all documents that are equal, or one edit of a word apart (a word replaced, put in or left
out), are near copies. A line goes if an earlier line (by doc_id, then line number) is its near copy.

1. Equal lines meet by a hash of 128 bits; the earliest of each stands for them.
2. Of two lines within one edit, each shares its first or its last words with the other, so only lines
   that share such a half go on. This loses no pair.
3. Each of those emits its deletion variants, hashed: itself and itself without its i-th word, by running
   sums over its words. Two lines differ by a replacement at i if they share the variant without word
   i, and by an insertion if one's variant is the other itself. Of the lines with an equal variant only the earliest is wanted, so
   each key keeps a minimum, summed up before the shuffle: a line template with a million variants
   makes a million rows, not their pairs.
4. The edit distance of each found pair is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def _tidy(line: Column) -> Column:
    """The words of a line with a space between each two. Most lines are that already and are only searched, not parted."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\r\f\x0b":
        odd |= line.contains(c)
    words = F.array_remove(F.split(F.translate(line, "\t\r\f\x0b", "    "), " "), "")
    return F.when(odd, F.array_join(words, " ")).otherwise(line)


def _one_edit(x: Column, y: Column) -> Column:
    """Word arrays x and y are at most one insertion, deletion or replacement apart."""
    shorter, longer = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    equal = F.zip_with(F.slice(x, 1, shorter), F.slice(y, 1, shorter), lambda a, b: a == b)
    first = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)), shorter + 1) - 1
    tail = F.zip_with(F.reverse(F.slice(F.reverse(x), 1, shorter)), F.reverse(F.slice(F.reverse(y), 1, shorter)), lambda a, b: a == b)
    last = F.coalesce(F.nullif(F.array_position(F.reverse(tail), False), F.lit(0)), shorter + 1) - 1
    return (longer - shorter <= 1) & (first + last >= longer - 1)


#: Bytes of candidate lines' places up to which they are sent to all tasks; more are joined by a shuffle.
BROADCAST = 32 << 20
#: The columns that tell lines apart: two hashes of the tidy line whose seeds differ, 128 bits.
KEY = ["h1", "h2"]


def _hash(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("again"), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines that have a word, tidied. That is in the generator, so that it runs once."""
    split = F.transform(F.split("text", "\n"), _tidy)
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(split).alias("line_no", "line")).where("line <> ''")


def removable_lines(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """(doc_id, line_no) of the lines that have an earlier near copy; see line_dedup."""
    scratch = Scratch(docs.sparkSession, "lines")
    line = F.col("line")
    lines = _lines(docs).select("*", *_hash(line))
    place, n = F.struct("doc_id", "line_no"), F.col("n")
    # a column of its own, so that it is counted once a line
    counted = lines.withColumn("n", F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)

    # the first and last m words, for an even m of about half the length; lengths that differ by one agree on one m
    def ends(m: Column) -> Column:
        first, last = (F.call_function("substring_index", line, F.lit(" "), k) for k in (m, -m))
        return F.array(F.xxhash64(F.lit("first"), m, first), F.xxhash64(F.lit("last"), m, last))

    m = F.floor(n / 4).cast("int") * 2
    both = F.when((n % 4 == 0) & (n > least_words), F.concat(ends(m), ends(m - 2))).otherwise(ends(m))
    halves = F.when(n >= least_words, both)

    # 1. equal lines: the earliest, and how many there are
    firsts = counted.select(*KEY, halves.alias("halves"), place.alias("place")).groupBy(*KEY).agg(F.min("place").alias("first"), F.first("halves").alias("halves"), F.count("*").alias("copies"))
    firsts = scratch.write(firsts.select(*KEY, "first.doc_id", "first.line_no", "copies", "halves"))
    rows = firsts.count()

    # 2. of those, the ones that share an end with another
    halved = firsts.select("doc_id", "line_no", F.explode("halves").alias("half"))
    shared = halved.groupBy("half").count().where("count > 1").select("half")
    near = scratch.write(halved.hint("merge").join(shared, "half", "left_semi").select("doc_id", "line_no").distinct(), rows)

    # 3. those lines in order, with a rank that follows it, and the hashes of what is left without each word
    size = near.agg(F.sum(F.octet_length(F.col("doc_id").cast("string")) + 32)).first()[0] or 0
    raw = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    picked = raw.join(F.broadcast(near) if size <= BROADCAST else near, ["doc_id", "line_no"], "left_semi").select("doc_id", "line_no", _tidy(line).alias("line"))
    picked = picked.select("doc_id", "line_no", F.split("line", " ").alias("words"), *_hash(line)).dropDuplicates(KEY).repartitionByRange("doc_id", "line_no").sortWithinPartitions("doc_id", "line_no")
    kept = scratch.write(picked.select(F.monotonically_increasing_id().alias("rank"), *KEY, "words"))
    # a line's hash is the exclusive or of its words' hashes with their places, so those before and behind a word add up
    placed = kept.select("rank", F.posexplode("words").alias("i", "word")).select("rank", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("ahead"))
    whole_line, before, upto = Window.partitionBy("rank"), Window.partitionBy("rank").orderBy("i").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head, tail = F.coalesce(F.bit_xor("here").over(before), F.lit(0)), F.bit_xor("ahead").over(whole_line).bitwiseXOR(F.bit_xor("ahead").over(upto))
    variants = placed.select("rank", "i", head.bitwiseXOR(tail).alias("variant"))
    whole = placed.groupBy("rank").agg(F.bit_xor("here").alias("variant"))

    replaced = variants.groupBy("variant", "i").agg(F.min("rank").alias("other"), F.count("*").alias("n")).where("n > 1").select("variant", "i", "other")
    # Spark takes a table that grew in a generator for as small as it was before: variants may not be broadcast
    by_replacement = variants.hint("merge").join(replaced, ["variant", "i"]).select("rank", "other")
    # the longer line of a pair has the other as a variant; whichever is later goes
    lengths = variants.hint("merge").join(whole.withColumnRenamed("rank", "other"), "variant").select(F.greatest("rank", "other").alias("rank"), F.least("rank", "other").alias("other"))
    lengths = lengths.groupBy("rank").agg(F.min("other").alias("other"))
    found = by_replacement.where("other < rank").unionByName(lengths).distinct()

    # 4. verified on the words
    pairs = found.join(kept, "rank").join(kept.select(F.col("rank").alias("other"), F.col("words").alias("theirs")), "other")
    gone = pairs.where(_one_edit(F.col("words"), F.col("theirs"))).select(*KEY).distinct().withColumn("near", F.lit(True))

    # of equal lines all go but the earliest, and that too if it has an earlier near copy. The verdict is written, so that
    # both sides of the last join are dealt out by it and Spark can split a line with many copies
    verdict = scratch.write(firsts.join(gone, KEY, "left").where("copies > 1 or near").select(*KEY, F.col("doc_id").alias("first_doc"), F.col("line_no").alias("first_line"), "near"))
    return lines.select(*KEY, "doc_id", "line_no").hint("merge").join(verdict, KEY).where("near or doc_id <> first_doc or line_no <> first_line").select("doc_id", "line_no")


def line_dedup(docs: DataFrame, least_words: int = 5) -> DataFrame:
    """The documents with the lines left out that have an earlier near copy, and how many those are.

    docs: doc_id, text and any other columns, which return unchanged; adds n_lines and n_removed, which
    replace columns of these names. Lines end at a line feed. Words are separated by ASCII
    white space; a line without a word never goes. Lines are equal if their words are; shorter ones than
    ``least_words`` go only if equal, as one word of fewer than five is too large a part. Documents are never
    dropped: one whose lines all go keeps an empty text. A null text stays null, with no lines; lines of a
    null doc_id are neither removed nor compared. Rows that repeat a doc_id are one document: they lose
    a line number together. No rows give no rows. A document's text and lines lie in one row, which a task holds.
    """
    gone = removable_lines(docs, least_words).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line_no").alias("_gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the columns go into one, so that none of them can clash with those put beside them
    kept = docs.select(F.struct(*docs.columns).alias("row")).join(gone, F.col("row.doc_id") == F.col("_id"), "left")
    lines = F.split("row.text", "\n")
    # the numbers that stay by hash, so that a document of many lines takes time in proportion
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "_gone")
    left = F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(stay(x), lambda i: F.get(x, i)), "\n")), F.lit(0))
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(left)
    columns = [text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own]
    counts = [F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))]
    return kept.select(*columns, *(c.cast("long").alias(n) for c, n in zip(counts, ("n_lines", "n_removed"))))
