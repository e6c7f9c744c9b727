"""Joins between tokens, lexicons, mentions, relations and arcs.

Lexicons (clusters, tag maps, vocabularies, embeddings) are joined without a hint: Spark broadcasts them below its
size threshold and shuffles them beyond it. Joins within a sentence are on the sentence's key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import build_label, hash_signs, is_asymmetric, ptb45_to_17
from . import masks
from .tables import KEYS, by_sentence, settled


def align(gold: DataFrame, pred: DataFrame, layers: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each gold row with the prediction for it: ``gold_x`` and ``pred_x`` of each layer x, null where it is missing."""
    keys = keys or [*KEYS, "tok"]
    rest = [c for c in gold.columns if c not in keys and c not in layers]
    mine = gold.select(*keys, *rest, *(F.col(c).alias(f"gold_{c}") for c in layers))
    return mine.join(pred.select(*keys, *(F.col(c).alias(f"pred_{c}") for c in layers)), keys, "left")


def embed_lookup(toks: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Adds embed_id: of the word itself, else with digits as number signs, lower-cased, upper-cased; -1 if none is known. vocab: word, id."""
    w = F.col(word)
    words = toks.select(w.alias("_w")).distinct()  # one lookup a type
    tries = words.select("_w", F.posexplode(F.array(F.col("_w"), hash_signs("_w"), F.lower("_w"), F.upper("_w"))).alias("_k", "_try"))
    known = vocab.select(F.col("word").alias("_try"), "id")
    found = tries.join(known, "_try").groupBy("_w").agg(F.min_by("id", "_k").alias("_id"))
    return toks.join(found, w == F.col("_w"), "left").withColumn("embed_id", F.coalesce("_id", F.lit(-1))).drop("_w", "_id")


def hit_rate(df: DataFrame, hit: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(hit.cast("double")).alias("hit_rate"))


def entity_words(toks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Adds entity_word: the word, with ``-ne`` behind it if it heads a mention of a sentence with at most two mentions."""
    few = mentions.groupBy(*KEYS).agg(F.count("*").alias("n"), F.collect_set("head").alias("_heads")).where("n <= 2").drop("n")
    return toks.join(few, KEYS, "left").withColumn("entity_word", F.when(F.array_contains("_heads", F.col("tok")), F.concat("word", F.lit("-ne"))).otherwise(F.col("word"))).drop("_heads")


def cluster_lookup(toks: DataFrame, clusters: DataFrame, lang: str = "en") -> DataFrame:
    """Adds cluster: of the word; for es and ca else of its first known part between underscores, for zh of its first known character, behind SW; else UNK."""
    words = toks.select(F.col("word").alias("_w")).distinct()
    parts = F.split("_w", "_") if lang in ("es", "ca") else F.split("_w", "") if lang == "zh" else F.array().cast("array<string>")
    tries = words.select("_w", F.posexplode(F.concat(F.array(F.col("_w")), F.filter(parts, lambda p: p != ""))).alias("_k", "_try"))
    found = tries.join(clusters.select(F.col("word").alias("_try"), "cluster"), "_try").groupBy("_w").agg(F.min_by(F.concat(F.when(F.col("_k") > 0, "SW").otherwise(""), "cluster"), "_k").alias("_c"))
    return toks.drop("cluster").join(found, F.col("word") == F.col("_w"), "left").withColumn("cluster", F.coalesce("_c", F.lit("UNK"))).drop("_w", "_c")


def reduce_tags(toks: DataFrame, tag_map: DataFrame, tag: str = "pos") -> DataFrame:
    """Adds reduced: the mapped tag, null for tags that the map lacks."""
    return toks.join(tag_map.select(F.col("tag").alias(tag), "reduced"), tag, "left")


def unknown_tags(toks: DataFrame, tag_map: DataFrame, tag: str = "pos") -> DataFrame:
    return toks.select(tag).distinct().join(tag_map.select(F.col("tag").alias(tag)), tag, "left_anti")


def reduce_ptb(toks: DataFrame, tag: str = "pos") -> DataFrame:
    return toks.withColumn("reduced", ptb45_to_17(tag))


def replace_oov(df: DataFrame, column: str, vocab: DataFrame, unk: str = "UNK") -> DataFrame:
    """Values that the vocabulary (its first column) lacks become ``unk``."""
    known = vocab.select(F.col(vocab.columns[0]).alias(column)).distinct().withColumn("_known", F.lit(True))
    return df.join(known, column, "left").withColumn(column, F.when(F.col("_known"), F.col(column)).otherwise(F.lit(unk))).drop("_known")


def known_only(df: DataFrame, vocab: DataFrame, column: str = "word") -> DataFrame:
    return df.join(vocab.select(F.col(vocab.columns[0]).alias(column)), column, "left_semi")


# arcs


def all_arcs(lengths: DataFrame) -> DataFrame:
    """(p, c) for every p from the wall and c of each sentence (keys, n), self-loops left out. Made row by row, without a join."""
    grown = lengths.select(*KEYS, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c"))
    return grown.select(*KEYS, F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("p"), "c").where("p <> c")


def verbal_preds(arc: DataFrame, toks: DataFrame) -> DataFrame:
    """Arcs of those predicates whose tag begins with V."""
    pred = F.when(F.col("p") == -1, F.col("c")).otherwise(F.col("p"))
    verbs = toks.where(F.col("pos").startswith("V")).select(*KEYS, F.col("tok").alias("_pred"))
    return arc.withColumn("_pred", pred).join(verbs, [*KEYS, "_pred"], "left_semi").drop("_pred")


def role_pairs(toks: DataFrame, structure: str, preds: DataFrame | None = None, pairs: DataFrame | None = None, self_loops: bool = True, skip: DataFrame | None = None) -> DataFrame:
    """Candidate (p, c) pairs: PAIRS_GIVEN, PREDS_GIVEN, ALL_PAIRS or NO_ROLES, less those to skip."""
    if structure == "PAIRS_GIVEN":
        out = pairs.select(*KEYS, "p", "c").distinct()
    elif structure == "NO_ROLES":
        out = toks.select(*KEYS, F.col("tok").alias("p"), F.col("tok").alias("c")).where("false")
    elif structure in ("PREDS_GIVEN", "ALL_PAIRS"):
        first = toks.select(*KEYS, F.col("tok").alias("p"))
        if structure == "PREDS_GIVEN":
            first = first.join(preds.select(*KEYS, F.col("pred").alias("p")), [*KEYS, "p"], "left_semi")
        out = first.join(toks.select(*KEYS, F.col("tok").alias("c")), KEYS)
    else:
        raise ValueError(f"no structure {structure}")
    out = out if self_loops else out.where("p <> c")
    return out.join(skip.select(*KEYS, "p", "c"), [*KEYS, "p", "c"], "left_anti") if skip is not None else out


def arc_label(pairs: DataFrame, arc: DataFrame, nil: str = "_") -> DataFrame:
    """Pairs with the label of their arc, ``nil`` if there is none."""
    return pairs.join(arc.select(*KEYS, "p", "c", "label"), [*KEYS, "p", "c"], "left").withColumn("label", F.coalesce("label", F.lit(nil)))


def labelled_pairs(sents: DataFrame, structure: str, self_loops: bool = True, skip: str | None = None, nil: str = "_") -> DataFrame:
    """role_pairs with arc_label, of sentences with n and their arcs in the row: predicates and pairs are those that the arcs have. skip: an array of (p, c).

    What grows with the square of a sentence is made row by row, one predicate at a time, and neither joined nor shuffled.
    """
    none = F.array().cast("array<struct<p: int, c: int>>")
    x = sents.select(*KEYS, "n", "arcs", (F.col(skip) if skip else none).alias("_skip"))
    if structure == "PAIRS_GIVEN":
        out = x.select(*KEYS, "_skip", F.inline(F.filter("arcs", lambda a: a["p"] >= 0))).select(*KEYS, "p", "c", "label", F.filter("_skip", lambda s: (s["p"] == F.col("p")) & (s["c"] == F.col("c"))).alias("_skip")).where(F.size("_skip") == 0).drop("_skip")
    elif structure in ("PREDS_GIVEN", "ALL_PAIRS"):
        preds = F.transform(F.filter("arcs", lambda a: a["p"] == -1), lambda a: a["c"]) if structure == "PREDS_GIVEN" else F.sequence(F.lit(0), F.col("n") - 1)
        each = x.select(*KEYS, "n", "arcs", "_skip", F.explode(preds).alias("p"))
        own = lambda of: F.filter(of, lambda a: a["p"] == F.col("p"))
        labels = F.map_from_entries(F.transform(own("arcs"), lambda a: F.struct(a["c"], a["label"])))
        each = settled(each.select(*KEYS, "n", "p", labels.alias("_labels"), F.transform(own("_skip"), lambda s: s["c"]).alias("_skip")))
        out = each.select(*KEYS, "p", "_labels", "_skip", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("c")).where(~F.array_contains("_skip", F.col("c")))
        out = out.select(*KEYS, "p", "c", F.coalesce(F.try_element_at("_labels", "c"), F.lit(nil)).alias("label"))
    elif structure == "NO_ROLES":
        out = x.select(*KEYS, F.lit(0).alias("p"), F.lit(0).alias("c"), F.lit(nil).alias("label")).where("false")
    else:
        raise ValueError(f"no structure {structure}")
    return out if self_loops else out.where("p <> c")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEYS, "p", "c", F.col("kept").alias("_a")).join(b.select(*KEYS, "p", "c", F.col("kept").alias("_b")), [*KEYS, "p", "c"], "full")


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """The arcs that both masks keep; masks of rows (p, c, kept), or both of bitmaps (see masks)."""
    if masks.is_packed(a):
        return masks.combined(a, b, "and")
    return _both(a, b).select(*KEYS, "p", "c", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False)).alias("kept"))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """The arcs that either mask keeps."""
    if masks.is_packed(a):
        return masks.combined(a, b, "or")
    no = F.lit(False)
    return _both(a, b).select(*KEYS, "p", "c", (F.coalesce("_a", no) | F.coalesce("_b", no)).alias("kept"))


def keep_gold(mask: DataFrame, toks: DataFrame) -> DataFrame:
    """The mask with every gold arc kept."""
    if masks.is_packed(mask):
        return masks.with_heads(mask, toks)
    gold = toks.where("parent >= -1").select(*KEYS, F.col("parent").alias("p"), F.col("tok").alias("c"), F.lit(True).alias("_gold"))
    return mask.join(gold, [*KEYS, "p", "c"], "left").withColumn("kept", F.col("kept") | F.coalesce("_gold", F.lit(False))).drop("_gold")


def reachable(mask: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per sentence (keys, n), whether the kept arcs allow a tree with several roots, and one with a single root; a search over bitmaps."""
    return masks.reachable(mask if masks.is_packed(mask) else masks.packed(mask, lengths), lengths)


def arc_triples(arc: DataFrame, kind: str, projective_only: bool = False) -> DataFrame:
    """Triples of candidate arcs: ``grandparent`` (g, p, c), ``sibling`` (p, c, s), or ``bigram`` (p, c, q: the head of the token before c)."""
    a = arc.select(*KEYS, "p", "c")
    if kind == "grandparent":
        up = arc.select(*KEYS, F.col("p").alias("g"), F.col("c").alias("p"))
        out = up.join(a, [*KEYS, "p"]).where("g <> c").select(*KEYS, "g", "p", "c")
        crossing = (F.col("g") >= 0) & (((F.least("p", "c") < F.col("g")) & (F.col("g") < F.greatest("p", "c"))))
        return out.where(~crossing) if projective_only else out
    if kind == "sibling":
        return a.join(arc.select(*KEYS, "p", F.col("c").alias("s")), [*KEYS, "p"]).where("c < s").select(*KEYS, "p", "c", "s")
    if kind == "bigram":
        before = arc.select(*KEYS, F.col("p").alias("q"), (F.col("c") + 1).alias("c"))
        return a.join(before, [*KEYS, "c"]).select(*KEYS, "p", "c", "q")
    raise ValueError(f"no kind {kind}")


# mentions and relations


def together(*parts: DataFrame) -> DataFrame:
    """The rows of all parts, dealt out by sentence. Parts that are dealt out already may have been cut into different partitions at run time, which a union of them doesn't mend."""
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).repartition(*KEYS)


MENTION_ORDER = ("head", "start", "end", "type", "subtype", "phrase_type", "m_id")


def order_mentions(mentions: DataFrame) -> DataFrame:
    """Adds rank: a mention's place in its sentence, from 0."""
    have = [F.col(c) for c in MENTION_ORDER if c in mentions.columns]
    return mentions.withColumn("rank", F.row_number().over(by_sentence(*have)) - 1)


def n_overlapping(mentions: DataFrame) -> DataFrame:
    """Per sentence, how many mentions overlap a later one."""
    m = order_mentions(mentions)
    later = m.select(*KEYS, F.col("rank").alias("r2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    first = m.join(later, KEYS).where("rank < r2 and start < e2 and s2 < end").select(*KEYS, "rank").distinct()
    return m.select(*KEYS).distinct().join(first.groupBy(*KEYS).agg(F.count("*").alias("n")), KEYS, "left").select(*KEYS, F.coalesce("n", F.lit(0)).cast("long").alias("n_overlapping"))


def ordered_args(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(rel_id, k, role, m_id, type, subtype): a relation's arguments in the order of their mentions, those of one mention in their own order."""
    args = relations.select(*KEYS, "rel_id", "type", "subtype", F.posexplode("args").alias("_i", "a")).select(*KEYS, "rel_id", "type", "subtype", "_i", "a.role", "a.m_id")
    placed = args.join(order_mentions(mentions).select(*KEYS, "m_id", "rank"), [*KEYS, "m_id"])
    return placed.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS, "rel_id").orderBy("rank", "_i")) - 1).drop("_i")


def ne_pairs(mentions: DataFrame, relations: DataFrame | None = None, max_between: int | None = None, positives: bool = True, negatives: bool = True) -> DataFrame:
    """Pairs (k, m1, m2) of mentions of a sentence, k in the order in which they come here.

    positives: the first two arguments of each relation, by rel_id; a relation that repeats or whose arguments are one mention counts like any other.
    negatives: the pairs of two mentions in order with at most ``max_between`` mentions between (see
    n_mentions_between; None: with any number), but with positives only those that no relation joins.
    The pairs of a sentence are made in its row, so no join grows them.
    """
    m = order_mentions(mentions)
    parts = []
    positives = positives and relations is not None
    if positives:
        two = ordered_args(relations, mentions).where("k < 2").groupBy(*KEYS, "rel_id").agg(F.max(F.when(F.col("k") == 0, F.col("m_id"))).alias("m1"), F.max(F.when(F.col("k") == 1, F.col("m_id"))).alias("m2"), F.max("k").alias("_n")).where("_n = 1")
        parts.append(two.select(*KEYS, "m1", "m2", F.lit(0).alias("_part"), F.col("rel_id").cast("long").alias("_x"), F.lit(0).alias("_y")))
    if negatives:
        row = m.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "m_id"))), lambda x: x["m_id"]).alias("_m"))
        first = row.where(F.size("_m") > 1).select(*KEYS, "_m", F.posexplode(F.slice("_m", 1, F.size("_m") - 1)).alias("_x", "m1"))
        second = first.select(*KEYS, "m1", "_x", F.posexplode(F.slice("_m", F.col("_x") + 2, F.size("_m"))).alias("_y", "m2"))
        rest = second.select(*KEYS, "m1", "m2", F.lit(1).alias("_part"), F.col("_x").cast("long").alias("_x"), "_y")
        if positives:
            joined = parts[0].select(*KEYS, F.least("m1", "m2").alias("_low"), F.greatest("m1", "m2").alias("_high")).distinct()
            rest = rest.withColumns({"_low": F.least("m1", "m2"), "_high": F.greatest("m1", "m2")}).join(joined, [*KEYS, "_low", "_high"], "left_anti").drop("_low", "_high")
        if max_between is not None:
            rest = n_mentions_between(rest, mentions).where(F.col("n_between") <= max_between).drop("n_between")
        parts.append(rest)
    out = together(*parts)
    return out.withColumn("k", F.row_number().over(by_sentence("_part", "_x", "_y")) - 1).select(*KEYS, "k", "m1", "m2")


def n_mentions_between(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs with n_between: other mentions that start from the earlier head up to the later.

    Each mention knows how many of its sentence start before its head; a pair takes the difference, less its own two.
    """
    m = mentions.select(*KEYS, "m_id", "head", "start")
    starts = m.select(*KEYS, F.col("start").alias("at"), F.lit(None).cast("string").alias("m_id"), "start")
    events = together(starts, m.withColumnRenamed("head", "at"))
    before = F.count_if(F.col("m_id").isNull()).over(Window.partitionBy(*KEYS).orderBy("at").rangeBetween(Window.unboundedPreceding, -1))
    below = events.withColumn("n", before).where("m_id is not null")
    side = lambda m: below.select(*KEYS, F.col("m_id").alias(m), F.struct("at", "start", "n").alias(f"_{m}"))
    x = pairs.join(side("m1"), [*KEYS, "m1"]).join(side("m2"), [*KEYS, "m2"])
    low, high = F.least("_m1.at", "_m2.at"), F.greatest("_m1.at", "_m2.at")
    own = lambda m: F.when((F.col(f"{m}.start") >= low) & (F.col(f"{m}.start") < high), 1).otherwise(0)
    n = F.abs(F.col("_m2.n") - F.col("_m1.n")) - own("_m1") - own("_m2")
    return x.select(*pairs.columns, n.cast("int").alias("n_between"))


def pair_relation(pairs: DataFrame, relations: DataFrame, mentions: DataFrame, none: str = "NO_RELATION") -> DataFrame:
    """Pairs with label: of the first relation between the two in either order; ``none`` if there is none.

    Roles are in the order of the mentions; types that aren't asymmetric have Arg-1 twice.
    """
    args = ordered_args(relations, mentions).where("k < 2")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    two = args.groupBy(*KEYS, "rel_id", "type", "subtype").agg(*(at(k, c).alias(f"{c}{k}") for k in (0, 1) for c in ("role", "m_id")), F.max("k").alias("_n")).where("_n = 1")
    role = lambda k: F.when(is_asymmetric("type"), F.col(f"role{k}")).otherwise("Arg-1")
    named = two.select(*KEYS, F.least("m_id0", "m_id1").alias("_low"), F.greatest("m_id0", "m_id1").alias("_high"), "rel_id", build_label("type", "subtype", role(0), role(1)).alias("_label"))
    first = named.groupBy(*KEYS, "_low", "_high").agg(F.min_by("_label", "rel_id").alias("_label"))
    keyed = pairs.withColumn("_low", F.least("m1", "m2")).withColumn("_high", F.greatest("m1", "m2"))
    return keyed.join(first, [*KEYS, "_low", "_high"], "left").withColumn("label", F.coalesce("_label", F.lit(none))).drop("_low", "_high", "_label")


def bilinear_scores(features: DataFrame, params: DataFrame, emb: DataFrame) -> DataFrame:
    """Scores of each label y of an example: sum over its words i of T[y, k, d] f[i, k] e[w_i, d].

    features: ex, embed_id, feature, value; params: label, feature, d, weight; emb: embed_id, vec. Words without an embedding (-1) are left out.
    """
    weights = params.groupBy("label", "feature").agg(F.collect_list(F.struct("d", "weight")).alias("_w"))  # a row a label and feature, not one a dimension
    rows = features.where("embed_id >= 0").join(emb, "embed_id").join(weights, "feature")
    dot = F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + x["weight"] * F.get("vec", x["d"]))
    return rows.groupBy("ex", "label").agg(F.sum(F.col("value") * dot).alias("score"))
