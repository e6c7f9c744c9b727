"""Pair munging, pruning and splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tree_index, trees
from ..functions.lexical import is_norel, is_punct, parse_label
from . import masks
from .joins import all_arcs, keep_gold, mask_and, ne_pairs, pair_relation
from .tables import KEYS, drop_layers, gold_only
from .windows import folds, max_marginal_prune, sample_split, shuffle, topk_heads

ARC = [*KEYS, "p", "c"]
#: Tokens of a sentence whose heads are emitted together.
BLOCK = 64
#: The tag of the wall.
WALL = "<WALL>"


def shorten_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions end at their head."""
    return mentions.withColumn("end", F.col("head") + 1)


def drop_entity_types(mentions: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return mentions.withColumns({c: none for c in ("type", "subtype") if c in mentions.columns})


def add_pairs_and_labels(mentions: DataFrame, relations: DataFrame, max_between: int | None = None, positives: bool = True, negatives: bool = True) -> DataFrame:
    """(k, m1, m2, label) of each sentence's pairs."""
    return pair_relation(ne_pairs(mentions, relations, max_between, positives, negatives), relations, mentions)


def singletons(sents: DataFrame, pairs: DataFrame, seed: int | None = None) -> DataFrame:
    """A sentence row for each of its pairs; with a seed in a fixed random order."""
    out = sents.join(pairs, KEYS)
    return out if seed is None else shuffle(out, seed, *KEYS, "k")


def pairs_to_relations(pairs: DataFrame) -> DataFrame:
    """Labelled pairs back to relations of two arguments; those without a relation are left out."""
    x = pairs.where(~is_norel("label")).withColumn("l", parse_label("label"))
    args = F.array(F.struct(F.col("l.role1").alias("role"), F.col("m1").alias("m_id")), F.struct(F.col("l.role2").alias("role"), F.col("m2").alias("m_id")))
    return x.select(*KEYS, F.col("k").alias("rel_id"), F.col("l.type").alias("type"), F.col("l.subtype").alias("subtype"), args.alias("args"))


# pruning


def fit_distance_pruner(toks: DataFrame, tag: str = "pos") -> DataFrame:
    """(ptag, ctag, dir, max_dist): the longest dependency seen between two tags; to the wall the distance is 1. toks: tokens, or sentences with the layers in their rows, which need no join."""
    if "parents" in toks.columns:
        each = F.transform(F.arrays_zip(F.col(tag).alias("ctag"), F.col("parents").alias("parent")), lambda t, i: F.struct(t["ctag"].alias("ctag"), t["parent"].alias("parent"), i.alias("tok"), F.get(tag, t["parent"]).alias("ptag")))
        return _longest(toks.select(F.inline(each)).where("parent >= -1"))
    head = toks.select(*KEYS, F.col("tok").alias("parent"), F.col(tag).alias("ptag"))
    x = toks.where("parent >= -1").select(*KEYS, "tok", "parent", F.col(tag).alias("ctag")).join(head, [*KEYS, "parent"], "left")
    return _longest(x)


def _longest(x: DataFrame) -> DataFrame:
    wall = F.col("parent") == -1
    x = x.select("ctag", F.when(wall, WALL).otherwise(F.col("ptag")).alias("ptag"), F.when(wall | (F.col("parent") < F.col("tok")), "R").otherwise("L").alias("dir"), F.when(wall, 1).otherwise(F.abs(F.col("tok") - F.col("parent"))).alias("d"))
    return x.groupBy("ptag", "ctag", "dir").agg(F.max("d").alias("max_dist"))


def _limits(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pruner's table by dependent: (ctag, right, left), the longest distances by the head's tag id; and (tag, id) of all its tags, the wall among them."""
    tags = table.select(F.col("ptag").alias("t")).unionByName(table.select(F.col("ctag").alias("t"))).unionByName(table.sparkSession.createDataFrame([(WALL,)], "t string"))
    names = tags.agg(F.array_sort(F.collect_set("t")).alias("_names"))  # one row of tags
    ids = names.select(F.posexplode("_names").alias("id", "tag"))
    side = lambda d: F.map_from_entries(F.collect_list(F.when(F.col("dir") == d, F.struct("ptag", "max_dist"))))
    known = table.groupBy("ctag").agg(side("R").alias("_r"), side("L").alias("_l"))
    rows = names.select("_names", F.explode("_names").alias("ctag")).join(known, "ctag", "left")
    far = lambda m: F.transform("_names", lambda t: F.coalesce(F.element_at(m, t), F.lit(0)))
    return rows.select("ctag", far("_r").alias("right"), far("_l").alias("left")), ids.select("tag", "id")


def candidate_heads(toks: DataFrame, table: DataFrame, tag: str = "pos", keep_right_branching: bool = True, packed: bool = False) -> DataFrame:
    """A row a token c: n, the first token of its block, its parent (null if toks has none), whether it is punctuation (where toks has words), and ``heads``, the tokens (-1: the wall) that distance_prune keeps as its head, or with ``packed`` their ``bits`` (see masks).

    The pruner's table is joined once a token, as arrays by tag id, so deciding an arc is an array access.
    Sentences are dealt out in blocks of tokens before their arcs grow; a token's arcs stay in its row.
    """
    limits, ids = _limits(table)
    parent = F.col("parent") if "parent" in toks.columns else F.lit(None).cast("int")
    punct = F.coalesce(is_punct("word"), F.lit(False)) if "word" in toks.columns else F.lit(False)
    x = toks.select(*KEYS, "tok", F.col(tag).alias("tag"), parent.alias("parent"), punct.alias("punct")).join(ids, "tag", "left")
    row = x.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("tok", "id", "tag", "parent", "punct"))).alias("ts"))
    blocks = row.select(*KEYS, F.transform("ts", lambda t: t["id"]).alias("ids"), F.size("ts").alias("n"), F.explode(F.sequence(F.lit(1), F.size("ts"), F.lit(BLOCK))).alias("_from"), "ts")
    blocks = blocks.select(*KEYS, "ids", "n", (F.col("_from") - 1).alias("block"), F.slice("ts", F.col("_from"), F.lit(BLOCK)).alias("ts")).repartition(*KEYS, "block")
    each = blocks.select(*KEYS, "ids", "n", "block", F.explode("ts").alias("t")).select(*KEYS, "ids", "n", "block", F.col("t.tok").alias("c"), F.col("t.tag").alias("ctag"), F.col("t.parent").alias("parent"), F.col("t.punct").alias("punct"))
    each = each.join(limits, "ctag", "left").crossJoin(F.broadcast(ids.where(F.col("tag") == WALL).select(F.col("id").alias("_wall"))))  # one row
    c = F.col("c")

    def kept(p: Column) -> Column:
        i = F.when(p == -1, F.col("_wall")).otherwise(F.get("ids", p))
        near = F.when(p == -1, F.get("right", i) >= 1).when(p < c, F.get("right", i) >= c - p).otherwise(F.get("left", i) >= p - c)
        # a tag that the table lacks has no id or no limits
        return (p != c) & F.coalesce(near | (p == c - 1) if keep_right_branching else near, F.lit(True))

    found = masks.within_distance(F.col("n"), c, F.col("ids"), F.col("right"), F.col("left"), F.col("_wall"), keep_right_branching).alias("bits") if packed else F.filter(F.sequence(F.lit(-1), F.col("n") - 1), kept).alias("heads")
    return tree_index.batched(each).select(*KEYS, "block", "c", "n", "parent", "punct", found)


def candidate_rows(sents: DataFrame, table: DataFrame, tag: str = "pos", keep_right_branching: bool = True) -> DataFrame:
    """candidate_heads as bitmaps, of sentences with their layers (words, the tags, parents) in the row. The pruner's table is one row beside each sentence, so nothing is shuffled."""
    limits, ids = _limits(table)
    known = ids.agg(F.map_from_entries(F.collect_list(F.struct("tag", "id"))).alias("_ids")).crossJoin(limits.agg(F.map_from_entries(F.collect_list(F.struct("ctag", F.struct("right", "left")))).alias("_far")))  # one row of tags
    x = sents.select(*KEYS, "words", tag, "parents").crossJoin(F.broadcast(known)).withColumn("ids", F.transform(tag, lambda t: F.element_at("_ids", t))).withColumn("n", F.size("words"))
    x = x.select(*KEYS, "ids", "n", F.element_at("_ids", F.lit(WALL)).alias("_wall"), "_far", F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.col(tag).alias("tag"), F.col("parents").alias("parent"))).alias("c", "t"))
    x = x.select(*KEYS, "ids", "n", "_wall", "c", "t.*", F.element_at("_far", F.col("t.tag")).alias("_limits"))
    bits = masks.within_distance(F.col("n"), F.col("c"), F.col("ids"), F.col("_limits.right"), F.col("_limits.left"), F.col("_wall"), keep_right_branching)
    return tree_index.batched(x).select(*KEYS, (F.floor(F.col("c") / BLOCK) * BLOCK).cast("int").alias("block"), "c", "n", "parent", F.coalesce(is_punct("word"), F.lit(False)).alias("punct"), bits.alias("bits"))


def distance_prune(toks: DataFrame, table: DataFrame, tag: str = "pos", keep_right_branching: bool = True) -> DataFrame:
    """All arcs of each sentence with kept: no longer than the table says for their tags, or of tags it doesn't know, or from a token to the next.

    Arcs aren't shuffled after they grow.
    """
    x = candidate_heads(toks, table, tag, keep_right_branching)
    marks = F.transform(F.sequence(F.lit(-1), F.col("n") - 1), lambda p: F.struct(p.alias("p"), F.array_contains("heads", p).alias("kept")))
    return x.select(*KEYS, "c", F.inline(marks)).where("p <> c").select(*ARC, "kept")


def heads_report(heads: DataFrame, skip_punct: bool = False) -> DataFrame:
    """Of candidate_heads, as arrays or as bitmaps: arcs outside the tree that are pruned (n_pruned of n_total), gold arcs that are kept (n_gold_kept of n_gold), and sentences that lose none (n_exact of n_sents). skip_punct: without arcs to punctuation."""
    counts = ~F.col("punct") if skip_punct else F.lit(True)
    tree = counts & F.coalesce(F.col("parent") >= -1, F.lit(False))
    has, size = (masks.has_head("bits", F.col("parent")), masks.n_heads("bits")) if masks.is_packed(heads) else (F.array_contains("heads", F.col("parent")), F.size("heads"))
    ok = F.coalesce(tree & has, F.lit(False))
    number = lambda c: F.when(counts, c).otherwise(0)
    # as many partial sums as blocks, so a long sentence is no long task
    per = heads.select(*KEYS, "block", tree.cast("int").alias("t"), ok.cast("int").alias("k"), number(F.col("n") - size).alias("gone"), number(F.col("n")).alias("all"))
    per = per.groupBy(*KEYS, "block").agg(F.sum("t").alias("t"), F.sum("k").alias("k"), F.sum(F.col("gone") - F.col("t") + F.col("k")).alias("pruned"), F.sum(F.col("all") - F.col("t")).alias("rest"))
    sents = per.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("t", "k", "pruned", "rest")))
    out = sents.agg(F.sum("pruned").alias("n_pruned"), F.sum("rest").alias("n_total"), F.sum("k").alias("n_gold_kept"), F.sum("t").alias("n_gold"), F.count_if(F.col("t") == F.col("k")).alias("n_exact"), F.count("*").alias("n_sents"))
    return out.withColumn("score", F.when(F.col("n_total") == 0, 0.0).otherwise(F.col("n_pruned") / F.col("n_total")))


def mask_totals(mask: DataFrame) -> DataFrame:
    if masks.is_packed(mask):
        return masks.totals(mask)
    return mask.agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_pruned"))


def best_heads(scores: Column | str, k: int, prop: float = 0.0) -> Column:
    """Of the scores of a token's heads -1, 0, ... (null where there is no arc): the k best heads, ties to the smaller, that reach ``prop`` of the best score."""
    x = F.col(scores) if isinstance(scores, str) else scores

    def chosen(ranked: Column) -> Column:
        floor = F.greatest(F.get(ranked, F.greatest(F.size(ranked) - k, F.lit(0))), prop * F.element_at(ranked, -1))
        return trees.let(floor, above)

    def above(floor: Column) -> Column:
        better = F.filter(F.transform(x, lambda s, i: F.when(s > floor, i - 1)), lambda i: i.isNotNull())
        level = F.filter(F.transform(x, lambda s, i: F.when(s == floor, i - 1)), lambda i: i.isNotNull())
        return trees.let(better, lambda b: F.concat(b, F.slice(level, 1, F.greatest(F.lit(k) - F.size(b), F.lit(0)))))

    ranked = F.sort_array(F.array_compact(x))
    return trees.let(ranked, lambda r: F.when(F.size(r) > 0, chosen(r)).otherwise(F.array().cast("array<int>")))


def score_prune(scores: DataFrame, k: int, prop: float, toks: DataFrame | None = None) -> DataFrame:
    """Arcs (p, c, score) with kept: among the k best heads of c and near enough to the best; those of a given tree are kept. One shuffle by token. Of tokens with an array ``scores`` (see masks.top_mask) a mask of bitmaps."""
    if "scores" in scores.columns:
        mask = mask_and(topk_heads(scores, k), max_marginal_prune(scores, prop))
        return keep_gold(mask, toks) if toks is not None else mask
    w = Window.partitionBy(*KEYS, "c")
    order = w.orderBy(F.desc("score"), "p")
    mask = scores.withColumn("kept", (F.row_number().over(order) <= k) & (F.col("score") >= prop * F.first("score").over(order)))
    return keep_gold(mask.select(*ARC, "kept"), toks) if toks is not None else mask.select(*ARC, "kept")


def no_mask(lengths: DataFrame) -> DataFrame:
    return all_arcs(lengths).withColumn("kept", F.lit(True))


# splits


def add_dev(dev: DataFrame | None, train_as_dev: DataFrame) -> DataFrame:
    return train_as_dev if dev is None else dev.unionByName(train_as_dev)


def train_rest(train: DataFrame, sampled: DataFrame) -> DataFrame:
    return train.join(sampled.select(*KEYS), KEYS, "left_anti")


def drop_pairs(pairs: DataFrame, skip: DataFrame) -> DataFrame:
    return pairs.join(skip.select(*ARC), ARC, "left_anti")


def splits(train: DataFrame, dev: DataFrame | None = None, test: DataFrame | None = None, predicted: tuple[str, ...] = (), latent: tuple[str, ...] = (), dev_prop: float = 0.0, seed: int = 0) -> dict[str, dict[str, DataFrame | None]]:
    """train, dev and test, each as gold and as input, which lacks the layers to be predicted. A share of train can become dev."""
    if dev_prop:
        marked = sample_split(train, dev_prop, seed)
        train, extra = marked.where("not sampled").drop("sampled"), marked.where("sampled").drop("sampled")
        dev = add_dev(dev, extra)
    hidden = gold_only(predicted, latent)
    return {name: {"gold": df, "input": drop_layers(df, hidden) if df is not None else None} for name, df in (("train", train), ("dev", dev), ("test", test))}


def jackknife(df: DataFrame, k: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], *order: str) -> DataFrame:
    """Each of k folds annotated by what is fitted on the others."""
    marked = folds(df, k, *order)
    out = None
    for i in range(k):
        part = fit(marked.where(F.col("fold") != i))(marked.where(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def jackknife_majority(toks: DataFrame, k: int, word: str = "word", tag: str = "pos") -> DataFrame:
    """Tokens (with a column fold) with pred: the commonest tag of their word in the other folds, ties to the last tag; null for words of one fold.

    One grouping for all folds: a word's counts in the other folds are those in all less those in its own.
    """
    by_fold = toks.groupBy("fold", word, tag).agg(F.count("*").alias("n"))
    total = by_fold.groupBy(word, tag).agg(F.sum("n").alias("n"))
    own = toks.select("fold", word).distinct()
    rest = own.join(total, word).join(by_fold.withColumnRenamed("n", "mine"), ["fold", word, tag], "left").withColumn("n", F.col("n") - F.coalesce("mine", F.lit(0))).where("n > 0")
    best = rest.groupBy("fold", word).agg(F.max(F.struct("n", tag)).alias("b")).select("fold", word, F.col(f"b.{tag}").alias("pred"))
    return toks.join(best, ["fold", word], "left")


def jackknife_backoff(rows: DataFrame, levels: list[list[str]], label: str, fold: str = "fold", weight: str | None = None) -> DataFrame:
    """rows with pred: the commonest label in the other folds of rows that agree in the first level's columns, or where none do in the next level's, and so on; ties to the last label.

    The annotator is its counts, so leaving a fold out is a subtraction: one pass over the rows and one look-up for each level, however many
    folds there are. A level without columns is all rows. weight: a column with how many equal rows a row stands for. Null if no other fold has a row. rows may not have columns that begin with ``_``.
    """
    out, preds = rows, []
    for i, level in enumerate(levels):
        keys = [F.col(c) for c in level] or [F.lit(0)]
        keyed = rows.select(F.struct(*(k.alias(f"c{j}") for j, k in enumerate(keys))).alias("_key"), F.col(fold).alias("_fold"), F.col(label).alias("_label"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
        by_fold = keyed.groupBy("_key", "_fold", "_label").agg(F.sum("_w").alias("_n"))
        whole = by_fold.groupBy("_key").agg(F.collect_list(F.struct("_fold", "_label", "_n")).alias("_cells"))  # labels times folds a key
        total = lambda cells, f, name: F.aggregate(F.filter(cells, lambda x: (x["_fold"] != f) & (x["_label"] == name)), F.lit(0).cast("long"), lambda a, x: a + x["_n"])
        folds_of = F.array_distinct(F.transform("_cells", lambda x: x["_fold"]))

        def best(f: Column) -> Column:
            names = F.array_distinct(F.transform(F.filter("_cells", lambda x: (x["_fold"] != f) & x["_label"].isNotNull()), lambda x: x["_label"]))
            return F.array_max(F.transform(names, lambda name: F.struct(total(F.col("_cells"), f, name).alias("n"), name.alias("label"))))["label"]

        found = whole.select("_key", F.explode(folds_of).alias("_fold"), "_cells").select("_key", "_fold", best(F.col("_fold")).alias(f"_pred{i}"))
        out = _looked_up(out, found, F.struct(*(k.alias(f"c{j}") for j, k in enumerate(keys))), fold)
        preds.append(f"_pred{i}")
    return out.withColumn("pred", F.coalesce(*preds)).drop(*preds)


def _looked_up(rows: DataFrame, found: DataFrame, key: Column, fold: str) -> DataFrame:
    """rows with the column of found (_key, _fold, value) for their key and fold; null keys meet too."""
    right = found.withColumn("_h", F.xxhash64("_key")).withColumnsRenamed({"_key": "_their", "_fold": "_their_fold"})
    left = rows.withColumn("_key", key).withColumn("_h", F.xxhash64("_key"))
    met = left.alias("l").join(right.alias("r"), (F.col("l._h") == F.col("r._h")) & (F.col(f"l.{fold}") == F.col("r._their_fold")) & F.col("l._key").eqNullSafe(F.col("r._their")), "left")
    return met.select(*(F.col(f"l.{c}") for c in rows.columns), F.col(f"r.{found.columns[-1]}"))
