"""Operators that depend on the order of a sentence's tokens, and on that of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import masks
from .tables import KEYS, by_sentence


def _prefix(tag: Column) -> Column:
    return F.when(tag.rlike("^[BIEOSU](-|$)"), F.substring(tag, 1, 1)).otherwise(F.lit("I"))


def _kind(tag: Column) -> Column:
    return F.when(tag.rlike("^[BIESU]-"), F.substring(tag, 3, 1000)).otherwise("")


def bio03_to_02(toks: DataFrame, tag: str = "ne_tag") -> DataFrame:
    """An I tag begins with B instead if it follows O, another kind, or nothing."""
    t, before = F.col(tag), F.lag(tag).over(by_sentence())
    begins = t.startswith("I-") & (before.isNull() | (before == "O") | (_kind(before) != _kind(t)))
    return toks.withColumn(tag, F.when(begins, F.concat(F.lit("B-"), _kind(t))).otherwise(t))


def chunks(toks: DataFrame, tag: str = "ne_tag") -> DataFrame:
    """(start, end, type) of the chunks of IOB, IOE, BIEOS and U tags by the shared-task rules of begin and end."""
    w = by_sentence()
    t, before = F.coalesce(F.col(tag), F.lit("O")), F.coalesce(F.lag(tag).over(w), F.lit("O"))
    x = toks.select(*KEYS, "tok", _prefix(t).alias("p"), _kind(t).alias("kind"), _prefix(before).alias("bp"), _kind(before).alias("bkind"))
    inside = F.col("p") != "O"
    begins = inside & (F.col("p").isin("B", "S", "U") | F.col("bp").isin("O", "E", "S", "U") | (F.col("kind") != F.col("bkind")))
    marked = x.where(inside).withColumn("chunk", F.sum(F.when(begins, 1).otherwise(0)).over(w))
    return marked.groupBy(*KEYS, "chunk").agg(F.min("tok").alias("start"), (F.max("tok") + 1).alias("end"), F.min_by("kind", "tok").alias("type")).drop("chunk")


def bio_spans(toks: DataFrame, tag: str = "chunk", include_o: bool = False) -> DataFrame:
    """(start, end, label, k) of strict BIO tags; with ``include_o`` every O is a span of its own."""
    w = by_sentence()
    t = F.col(tag)
    begins = t.startswith("B") | (t == "O") | (t.startswith("I") & F.coalesce(F.lag(tag).over(w) == "O", F.lit(True)))
    marked = toks.select(*KEYS, "tok", t.alias("t"), begins.alias("b")).withColumn("g", F.sum(F.col("b").cast("int")).over(w))
    spans = marked.groupBy(*KEYS, "g").agg(F.min("tok").alias("start"), (F.max("tok") + 1).alias("end"), F.min_by("t", "tok").alias("t"))
    spans = spans if include_o else spans.where("t <> 'O'")
    label = F.when(F.col("t") == "O", "O").otherwise(F.regexp_replace("t", "^[BI]-", ""))
    return spans.select(*KEYS, "start", "end", label.alias("label"), (F.row_number().over(by_sentence("start")) - 1).alias("k"))


def shift(toks: DataFrame, prop: str, k: int, name: str) -> DataFrame:
    """Adds the property of the token k places on; BOS or EOS beyond the sentence."""
    w = by_sentence()
    value = F.lead(prop, k, "EOS").over(w) if k > 0 else F.lag(prop, -k, "BOS").over(w)
    return toks.withColumn(name, value)


def siblings(toks: DataFrame) -> DataFrame:
    """Adds lns and rns: the nearest tokens left and right with the same parent, by default -1 and n."""
    w = Window.partitionBy(*KEYS, "parent").orderBy("tok")
    n = F.count("*").over(Window.partitionBy(*KEYS))
    return toks.withColumn("lns", F.coalesce(F.lag("tok").over(w), F.lit(-1))).withColumn("rns", F.coalesce(F.lead("tok").over(w), n.cast("int")))


def child_ends(toks: DataFrame) -> DataFrame:
    """Adds lmc, rmc, lnc and rnc: leftmost, rightmost, and nearest left and right child; -2 if there is none."""
    left, right = F.col("tok") < F.col("parent"), F.col("tok") > F.col("parent")
    kids = toks.where("parent >= 0").groupBy(*KEYS, F.col("parent").alias("_p")).agg(
        F.min(F.when(left, F.col("tok"))).alias("lmc"), F.max(F.when(right, F.col("tok"))).alias("rmc"), F.max(F.when(left, F.col("tok"))).alias("lnc"), F.min(F.when(right, F.col("tok"))).alias("rnc")
    )
    out = toks.join(kids.withColumnRenamed("_p", "tok"), [*KEYS, "tok"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(-2)) for c in ("lmc", "rmc", "lnc", "rnc")})


def num_left(toks: DataFrame, kinds: tuple[str, ...] = ("VERB", "NOUN", "PUNC", "CONJ"), spos: str = "spos") -> DataFrame:
    """Adds left_verb and so on: how many tokens of a strict kind stand strictly left."""
    w = by_sentence().rowsBetween(Window.unboundedPreceding, -1)
    return toks.withColumns({f"left_{k.lower()}": F.coalesce(F.count_if(F.col(spos) == k).over(w), F.lit(0)) for k in kinds})


def num_between(pairs: DataFrame, counted: DataFrame, kind: str) -> DataFrame:
    """Pairs (p, c; p may be the wall) with the count of a kind strictly between; counted comes from num_left. One join, with a row a sentence."""
    at = f"left_{kind.lower()}"
    row = counted.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("tok", F.col(at).alias("l"), (F.col(at) + F.coalesce(F.col("spos") == kind, F.lit(False)).cast("long")).alias("r")))).alias("_a"))
    x = pairs.join(row, KEYS, "left")
    left, upto = (lambda i: F.get("_a", i)["l"]), (lambda i: F.coalesce(F.get("_a", i)["r"], F.lit(0)))
    p, c = F.col("p"), F.col("c")
    return x.withColumn(f"between_{kind.lower()}", F.when(p < c, left(c) - upto(p)).when(p > c, left(p) - upto(c)).otherwise(0)).drop("_a")


def topk_heads(scores: DataFrame, k: int) -> DataFrame:
    """Scored arcs (p, c, score) with kept: among the k best heads of their token, ties to the smaller head. Of tokens with an array ``scores`` a mask of bitmaps."""
    if "scores" in scores.columns:
        return masks.top_mask(scores, k)
    w = Window.partitionBy(*KEYS, "c").orderBy(F.desc("score"), "p")
    return scores.withColumn("kept", F.row_number().over(w) <= k)


def max_marginal_prune(scores: DataFrame, prop: float) -> DataFrame:
    """Scored arcs with kept: at least ``prop`` of their token's best score. Of tokens with an array ``scores`` a mask of bitmaps."""
    if "scores" in scores.columns:
        return masks.marginal_mask(scores, prop)
    return scores.withColumn("kept", F.col("score") >= prop * F.max("score").over(Window.partitionBy(*KEYS, "c")))


def global_rank(df: DataFrame, *order: str) -> DataFrame:
    """Adds rn, the place from 0 in the whole frame, without gathering it: ranges are counted and the counts summed."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "ranked")
    counts = sorted((r["_p"], r["n"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row a partition
    bases, total = [], 0
    for p, n in counts:
        bases.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(bases, "_p int, _base long")
    return placed.join(F.broadcast(offsets), "_p").withColumn("rn", F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")


def folds(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Adds fold: k contiguous parts of equal size, what remains in the last."""
    n = df.count()
    if k < 1 or k > n:
        raise ValueError(f"{n} rows can't have {k} folds")
    ranked = global_rank(df, *(order or KEYS))
    return ranked.withColumn("fold", F.least(F.floor(F.col("rn") / (n // k)), F.lit(k - 1)).cast("int"))


def sample_split(df: DataFrame, prop: float, seed: int = 0, *keys: str, by: Column | None = None) -> DataFrame:
    """Adds sampled: true for exactly ceil(prop N) rows, those of the smallest hash of their key; ``by`` is a hash of one's own."""
    import math

    names = keys or tuple(KEYS)
    n = df.count()
    ranked = global_rank(df.withColumn("_h", by if by is not None else F.xxhash64(F.lit(seed), *names)), "_h", *names)
    return ranked.withColumn("sampled", F.col("rn") < math.ceil(prop * n)).drop("_h", "rn")


def shuffle(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """A fixed random order."""
    return df.orderBy(F.xxhash64(F.lit(seed), *(keys or KEYS)), *(keys or KEYS))
