"""Corpus statistics, vocabularies and inventories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tree_index
from .tables import KEYS

#: Vocabulary ids that no word has.
RESERVED = ("<UNK>", "<START>", "<END>", "<WALL>")


def corpus_summary(lengths: DataFrame) -> DataFrame:
    """Sentences, tokens, longest and mean length of (keys, n)."""
    return lengths.agg(F.count("*").alias("n_sents"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_tokens"), F.max("n").cast("long").alias("max_len"), F.avg("n").alias("avg_len"))


def word_counts(toks: DataFrame, word: str = "word") -> DataFrame:
    return toks.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("cnt"))


def known_words(counts: DataFrame, cutoff: int = 3) -> DataFrame:
    """Words seen more than ``cutoff`` times."""
    return counts.where(F.col("cnt") > cutoff)


def topn_words(counts: DataFrame, n: int, cutoff: int = 0) -> DataFrame:
    """The n commonest words above the cutoff; of equally common ones the last in order."""
    return known_words(counts, cutoff).orderBy(F.desc("cnt"), F.desc("word")).limit(n)


def label_set(df: DataFrame, layer: str, always: tuple[str, ...] = ()) -> DataFrame:
    """The distinct labels of a layer, with those that always count."""
    found = df.select(F.col(layer).alias("label")).where("label is not null")
    if always:
        found = found.unionByName(df.sparkSession.createDataFrame([(x,) for x in always], "label string"))
    return found.distinct()


def known_roles(arc: DataFrame) -> DataFrame:
    return label_set(arc.where("p >= 0"), "label", ("argUNK", "_"))


def known_links() -> tuple[str, str]:
    """The states of an arc, which every corpus has."""
    return ("False", "True")


def pred_senses(arc: DataFrame, toks: DataFrame) -> DataFrame:
    """Each lemma's sorted senses; lemma ``_`` where tokens have none."""
    lemma = F.coalesce("lemma", F.lit("_")) if "lemma" in toks.columns else F.lit("_")
    at = toks.select(*KEYS, F.col("tok").alias("c"), lemma.alias("lemma"))
    return arc.where("p = -1").join(at, [*KEYS, "c"]).groupBy("lemma").agg(F.array_sort(F.collect_set("label")).alias("senses"))


def label_inventory(pairs: DataFrame, is_nil: Column) -> DataFrame:
    """Each label's count, and whether it is a relation."""
    return pairs.groupBy("label").agg(F.count("*").alias("cnt"), F.bool_and(~is_nil).alias("positive"))


def build_vocab(counts: DataFrame, max_idx: int) -> DataFrame:
    """(word, cnt, id): the words above the least cutoff with which they and the reserved ids fit into ``max_idx`` ids.

    Reserved ids come first; dropped words count as unknown. Only the histogram of counts is summed in
    one place; it has as many rows as there are different counts.
    """
    steps = counts.groupBy("cnt").agg(F.count("*").alias("n"))
    total = steps.withColumn("kept", F.sum("n").over(Window.orderBy(F.desc("cnt"))))
    cutoff = total.where(F.col("kept") + len(RESERVED) <= max_idx).agg(F.coalesce(F.min("cnt"), F.lit(2**62)).alias("k"))
    marked = counts.crossJoin(F.broadcast(cutoff))  # one row
    kept = marked.where("cnt >= k").select("word", "cnt")
    unknown = marked.agg(F.coalesce(F.sum(F.when(F.col("cnt") < F.col("k"), F.col("cnt"))), F.lit(0)).cast("long").alias("cnt"))
    ids = kept.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("cnt"), "word")) + len(RESERVED) - 1).cast("long"))  # at most max_idx rows
    spark = counts.sparkSession
    fixed = spark.createDataFrame([(w, 0, i) for i, w in enumerate(RESERVED[1:], 1)], "word string, cnt long, id long")
    return unknown.select(F.lit(RESERVED[0]).alias("word"), "cnt", F.lit(0).cast("long").alias("id")).unionByName(fixed).unionByName(ids)


def topn_cutoff(counts: DataFrame, n: int = 800) -> DataFrame:
    """How often the n-th commonest word occurs (the rarest, if there are fewer); zero counts don't matter."""
    return counts.where("cnt > 0").orderBy(F.desc("cnt")).limit(n).agg(F.min("cnt").alias("cutoff"))


def known_word_union(*corpora: DataFrame) -> DataFrame:
    out = corpora[0].select("word")
    for c in corpora[1:]:
        out = out.unionByName(c.select("word"))
    return out.distinct()


def prop_annotated(df: DataFrame, layers: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("layer"), F.avg(F.col(c).isNotNull().cast("double")).alias("prop")) for c in layers]
    return df.agg(F.array(*pairs).alias("x")).select(F.inline("x"))


def self_loop_rate(arc: DataFrame) -> DataFrame:
    """The share of arcs from a token to itself among all arcs, those of predicates (p = -1) included."""
    return arc.agg((F.count_if(F.col("p") == F.col("c")) / F.count("*")).alias("self_loop_rate"))


def tree_stats(toks: DataFrame) -> DataFrame:
    """Sentences by the number of edges to the wall, and how many lack an edge: (n_roots, n_sents, n_missing).

    One root is a singly rooted tree. Others count as multi-rooted, those without a root too, which have a row of their own.
    """
    per = toks.groupBy(*KEYS).agg(F.count_if(F.col("parent") == -1).alias("n_roots"), F.bool_or(F.col("parent").isNull() | (F.col("parent") < -1)).alias("missing"))
    return per.groupBy("n_roots").agg(F.count("*").alias("n_sents"), F.count_if("missing").alias("n_missing"))


def tag_types(toks: DataFrame, tag: str = "pos") -> DataFrame:
    return toks.groupBy(tag).agg(F.count("*").alias("cnt"))


def gold_paths(features: DataFrame) -> DataFrame:
    """The distinct dependency paths of gold arcs (column path)."""
    return features.where("path is not null").select("path").distinct()


def feature_counts(features: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return features.groupBy("template").agg(count("feature").alias("n_features"))


def collision_rates(features: DataFrame, bucket: Column) -> DataFrame:
    """The share of feature types, and of their occurrences, in buckets that more than one type falls in."""
    types = features.groupBy("feature").agg(F.count("*").alias("cnt")).withColumn("bucket", bucket)
    per = types.groupBy("bucket").agg(F.count("*").alias("types"), F.sum("cnt").alias("toks"))
    hit = F.col("types") > 1
    return per.agg((F.sum(F.when(hit, F.col("types")).otherwise(0)) / F.sum("types")).alias("type_rate"), (F.sum(F.when(hit, F.col("toks")).otherwise(0)) / F.sum("toks")).alias("token_rate"))


def information_gain(features: DataFrame, values: DataFrame | None = None, keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Mutual information (bits) of each template's features with a value: (template, ig).

    features: keys, template, feature; values: keys, value, or None if features have a column value. All templates go through one grouping; with ``buckets``
    features are hashed first. Counts are summed before each shuffle, and as the sum parts into one of joint counts and one of each margin, they aren't joined again.
    """
    f = features.withColumn("feature", F.pmod(F.xxhash64("feature"), F.lit(buckets)).cast("string")) if buckets else features
    valued = f.join(values.select(*keys, "value"), keys) if values is not None else f
    joint = valued.where("template is not null and feature is not null and value is not null").groupBy("template", "feature", "value").agg(F.count("*").alias("n"))
    own = joint.groupBy("template", "feature").agg(F.sum("n").alias("nf"), F.sum(F.col("n") * F.log2("n")).alias("a"))
    by_f = own.groupBy("template").agg(F.sum("a").alias("a"), F.sum(F.col("nf") * F.log2("nf")).alias("b"), F.sum("nf").alias("nt"))
    by_v = valued.where("template is not null and feature is not null and value is not null").groupBy("template", "value").agg(F.count("*").alias("nv")).groupBy("template").agg(F.sum(F.col("nv") * F.log2("nv")).alias("c"))
    return by_f.join(by_v, "template").select("template", ((F.col("a") - F.col("b") - F.col("c")) / F.col("nt") + F.log2("nt")).alias("ig"))


#: Examples whose joint features a task counts before it sends the counts on.
COUNTED = 100_000


def joint_counts(examples: DataFrame, names: list[str], buckets: int, order: int = 2) -> DataFrame:
    """(template, feature, value, n): how often the joint features of every ``order`` templates meet each value.

    examples: value, and fs, an array with the feature of each template of ``names`` as a number from 0 (null: none). A joint feature is a bucket: a *
    1000003 + b, modulo ``buckets``. Tasks build the tables of all combinations for many examples at once, so a row is a cell of a
    table, never a joint feature of an example.
    """
    from itertools import combinations

    chosen = list(combinations(range(len(names)), order))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            values = rows.column("value").chunk(0).dictionary_encode()
            known, kind = values.dictionary, values.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            fs = rows.column("fs").chunk(0).flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(names))
            for combination in chosen:
                some = (kind >= 0) & (fs[:, combination] >= 0).all(axis=1)
                bucket = fs[some, combination[0]] % buckets
                for k in combination[1:]:
                    bucket = (bucket * 1_000_003 + fs[some, k]) % buckets
                cells, n = np.unique(bucket * len(known) + kind[some], return_counts=True)
                name = "+".join(names[k] for k in combination)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name), len(cells)), pa.array(cells // max(1, len(known))), known.take(pa.array(cells % max(1, len(known)))), pa.array(n.astype(np.int64))], ["template", "feature", "value", "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= COUNTED:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    found = tree_index.batched(examples.select("value", F.col("fs").cast("array<bigint>").alias("fs"))).mapInArrow(count, "template string, feature long, value string, n long")
    return found.groupBy("template", "feature", "value").agg(F.sum("n").alias("n"))


def gains(counts: DataFrame) -> DataFrame:
    """(template, ig): the mutual information, in bits, of features and values, from counts (template, feature, value, n)."""
    total = lambda *by: F.sum("n").over(Window.partitionBy("template", *by))
    x = counts.select("template", "n", total("feature").alias("nf"), total("value").alias("nv"), total().alias("nt"))
    return x.groupBy("template").agg(F.sum(F.col("n") / F.col("nt") * F.log2(F.col("n") * F.col("nt") / (F.col("nf") * F.col("nv")))).alias("ig"))


def select_bigrams(examples: DataFrame, names: list[str], n: int, first: int = 45, buckets: int = 1 << 16) -> DataFrame:
    """(template, ig, rank, selected): the pairs of the ``first`` most informative templates by their gain; the n best are selected. See joint_counts."""
    ranked = select_templates(gains(joint_counts(examples, names, buckets, 1)), first)
    best = {r.template for r in ranked.where("selected = 'Y'").collect()}  # names of templates
    kept = [i for i, name in enumerate(names) if name in best]
    fs = F.array(*(F.get("fs", F.lit(i)) for i in kept))
    return select_templates(gains(joint_counts(examples.select("value", fs.alias("fs")), [names[i] for i in kept], buckets)), n)


def select_templates(ig: DataFrame, n: int) -> DataFrame:
    """Templates with rank (1 the most informative) and selected Y or N."""
    ranked = ig.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ig"), "template")))  # a row a template
    return ranked.withColumn("selected", F.when(F.col("rank") <= n, "Y").otherwise("N"))


def select_unigram_bigram(unigrams: DataFrame, gain, n: int, first: int = 45):
    """Two stages: the ``first`` best unigram templates, all pairs of them but those with path grams, and the n best of all those.

    unigrams: features rows keyed by ex (ex, template, feature); gain(features) -> (template, ig). Returns (report, selected templates), which holds all unigrams.
    """
    best = select_templates(gain(unigrams), first).where("selected = 'Y'").select("template")
    own = unigrams.join(best, "template", "left_semi").where(~F.col("template").contains("PATHGRAM"))
    # the pairs of an example are made in its row
    row = own.groupBy("ex").agg(F.array_sort(F.collect_list(F.struct("template", "feature"))).alias("fs"))
    first = row.select("ex", "fs", F.explode("fs").alias("a"))
    rest = first.select("ex", "a", F.explode(F.filter("fs", lambda b: b["template"] > F.col("a.template"))).alias("b"))
    bigrams = rest.select("ex", F.concat_ws("+", "a.template", "b.template").alias("template"), F.concat_ws("_", "a.feature", "b.feature").alias("feature"))
    report = select_templates(gain(bigrams), n)
    chosen = report.where("selected = 'Y'").select("template").unionByName(unigrams.select("template").distinct())
    return report, chosen
