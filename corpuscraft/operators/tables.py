"""Sentences as long tables, and operations on layers, properties and span labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import NOT_AN_ARG

KEYS = ["corpus", "sent_id"]
#: Layers of a sentence that have a value a token, and their names there.
TOKEN_LAYERS = {"words": "word", "prefixes": "prefix", "lemmas": "lemma", "pos": "pos", "cpos": "cpos", "spos": "spos", "clusters": "cluster", "chunks": "chunk", "ne_tags": "ne_tag", "deprels": "deprel", "parents": "parent", "feats": "morpho", "embed_ids": "embed_id"}


def tokens(sentences: DataFrame) -> DataFrame:
    """A row a token: the keys, tok, and every token layer that the sentences have."""
    have = [c for c in TOKEN_LAYERS if c in sentences.columns]
    # a missing layer counts as an empty one, which the zip fills with nulls
    whole = sentences.withColumns({c: F.coalesce(c, F.array().cast(sentences.schema[c].dataType)) for c in have})
    zipped = whole.select(*KEYS, F.posexplode(F.arrays_zip(*have)).alias("tok", "x"))
    return zipped.select(*KEYS, "tok", *(F.col(f"x.{c}").alias(TOKEN_LAYERS[c]) for c in have))


def sentences(toks: DataFrame) -> DataFrame:
    """The inverse of tokens: a layer that is null for all tokens of a sentence is null."""
    have = {c: t for c, t in TOKEN_LAYERS.items() if t in toks.columns}
    rows = toks.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("tok", *have.values()))).alias("r"))
    layer = lambda t: F.when(F.exists("r", lambda x: x[t].isNotNull()), F.transform("r", lambda x: x[t]))
    return rows.select(*KEYS, *(layer(t).alias(c) for c, t in have.items()))


def settled(df: DataFrame) -> DataFrame:
    """df with its columns computed once a row. Else Spark may put an array's expression into functions that look its items up, and compute the array for each item."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def arcs(sents: DataFrame) -> DataFrame:
    """(p, c, label) rows of the semantic graph; p = -1 holds a predicate's sense."""
    return sents.select(*KEYS, F.explode("arcs").alias("a")).select(*KEYS, "a.p", "a.c", "a.label")


def drop_layers(df: DataFrame, layers: Iterable[str]) -> DataFrame:
    return df.drop(*layers)


def copy_layer(src: DataFrame, dst: DataFrame, layer: str, keys: list[str] | None = None) -> DataFrame:
    """dst with the layer of src; sentences that src lacks get null."""
    keys = keys or KEYS
    return dst.drop(layer).join(src.select(*keys, layer), keys, "left")


def layers(df: DataFrame) -> DataFrame:
    """For each layer, whether some sentences and whether all have it."""
    names = [c for c in df.columns if c not in KEYS]
    pairs = [F.struct(F.lit(c).alias("layer"), F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias("some_have"), F.coalesce(F.bool_and(F.col(c).isNotNull()), F.lit(True)).alias("all_have")) for c in names]
    return df.agg(F.array(*pairs).alias("x")).select(F.inline("x"))


def require_layers(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    """df, or an error that names the layers it hasn't got."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing layers: {', '.join(missing)}")
    return df


def gold_only(predicted: Iterable[str], latent: Iterable[str] = (), configured: Iterable[str] | None = None) -> list[str]:
    """The layers that input must not hold: the configured ones, else those predicted or latent."""
    return sorted(set(configured) if configured is not None else union_layers(predicted, latent))


def union_layers(a: Iterable[str], b: Iterable[str]) -> set[str]:
    return set(a) | set(b)


def neutralise(df: DataFrame, group: str) -> DataFrame:
    """Heads to the wall, relations and lemmas to underscores, or features to empty lists."""
    value = {"parents": lambda _: F.lit(-1), "deprels": lambda _: F.lit("_"), "lemmas": lambda _: F.lit("_"), "feats": lambda _: F.array().cast("array<string>")}[group]
    return df.withColumn(group, F.transform("words", value))


def gold_heads(system: DataFrame, gold: DataFrame) -> DataFrame:
    """The system's sentences with the heads and relations of the gold ones."""
    return system.drop("parents", "deprels").join(gold.select(*KEYS, "parents", "deprels"), KEYS, "left")


def cluster_as_pos(toks: DataFrame, clusters: DataFrame) -> DataFrame:
    """Tokens whose tag is the cluster of the lower-cased word, an underscore if there is none."""
    found = clusters.select(F.col("word").alias("_w"), F.col("cluster").alias("_c"))
    return toks.join(found, F.lower("word") == F.col("_w"), "left").withColumn("pos", F.coalesce("_c", F.lit("_"))).drop("_w", "_c")


def to_lite(sents: DataFrame) -> DataFrame:
    """Words and semantic arcs only, ids counted from 1."""
    return sents.select(*KEYS, F.transform("words", lambda _, i: (i + 1).cast("string")).alias("ids"), "words", "arcs")


def to_lite_v2(sents: DataFrame) -> DataFrame:
    """As to_lite, with the dependency arcs, their labels behind ``dep:`` and those of the semantic ones behind ``srl:``."""
    deps = F.transform("words", lambda _, i: F.struct(F.get("parents", i).alias("p"), i.alias("c"), F.concat(F.lit("dep:"), F.get("deprels", i)).alias("label")))
    sem = F.transform("arcs", lambda a: F.struct(a["p"].alias("p"), a["c"].alias("c"), F.concat(F.lit("srl:"), a["label"]).alias("label")))
    return to_lite(sents.withColumn("arcs", F.concat(F.filter(deps, lambda d: d["p"] > -2), sem)))


def from_lite(sents: DataFrame) -> DataFrame:
    """Lite sentences with empty columns for what the format doesn't hold."""
    none = F.lit(None).cast("array<string>")
    return sents.select(*KEYS, "words", none.alias("lemmas"), none.alias("pos"), F.lit(None).cast("array<array<string>>").alias("feats"), F.lit(None).cast("array<int>").alias("parents"), none.alias("deprels"), "arcs")


def c08_to_c09(sents: DataFrame) -> DataFrame:
    return sents.withColumn("feats", F.lit(None).cast("array<array<string>>"))


def known_preds(a: DataFrame) -> DataFrame:
    return a.where("p = -1").select(*KEYS, F.col("c").alias("pred")).distinct()


def known_pairs(a: DataFrame) -> DataFrame:
    return a.where("p >= 0").select(*KEYS, "p", "c").distinct()


def set_props(props: DataFrame, seq: str, nil: str = NOT_AN_ARG) -> DataFrame:
    """One label a (pred, arg, property): the last by ``seq``. ``overwritten`` counts the labels it replaced; a label on a nil pair is an error."""
    keys = [*KEYS, "pred", "arg"]
    nil_pairs = props.where(F.col("label") == nil).select(*keys).distinct().withColumn("_nil", F.lit(True))
    clash = F.col("_nil") & (F.col("label") != nil)
    checked = props.join(nil_pairs, keys, "left").withColumn("label", F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.lit("a nil pair has a label"))).otherwise(F.col("label")))
    return checked.groupBy(*keys, "property").agg(F.max_by("label", seq).alias("label"), (F.count("*") - 1).alias("overwritten"))


def set_span_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Span labels (start, end, label) with those of ``new`` put in their place; a null label removes."""
    keys = [*KEYS, "start", "end"]
    return labels.join(new.select(*keys), keys, "left_anti").unionByName(new.where("label is not null"))


def first_sentences(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(*KEYS).limit(n)


def by_sentence(*order: str | Column):
    """The window of a sentence's rows in order."""
    return Window.partitionBy(*KEYS).orderBy(*(order or ("tok",)))
