"""Sentences back to corpus formats: a text block a sentence, written by every task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import join_feats, underscore_if_null
from ..functions.trees import let
from ..operators.masks import is_packed
from ..operators.tables import KEYS
from .readers import JSON_LAYERS, READERS


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _cell(df: DataFrame, layer: str, i: Column) -> Column:
    """The i-th value of a layer, an underscore where it or the layer is missing."""
    return underscore_if_null(F.get(F.col(layer), i).cast("string")) if _has(df, layer) else F.lit("_")


def _head(df: DataFrame, i: Column) -> Column:
    head = F.get("parents", i) if _has(df, "parents") else F.lit(None).cast("int")
    return F.when(head.isNull() | (head == -2), "_").otherwise((head + 1).cast("string"))


def _feats(df: DataFrame, i: Column) -> Column:
    return join_feats(F.get("feats", i)) if _has(df, "feats") else F.lit("_")


def _preds() -> Column:
    return F.array_sort(F.transform(F.filter("arcs", lambda a: a["p"] == -1), lambda a: a["c"]))


def _named(arcs: Column, p: Column) -> Column:
    """The label of the arc from p among a token's own, an underscore if there is none."""
    return underscore_if_null(F.get(F.filter(arcs, lambda a: a["p"] == p), F.lit(0))["label"])


def _graph_lines(df: DataFrame, line) -> Column:
    """Lines by line(word, i, predicates, the arcs to i): the predicates are found once a sentence, and a token's arcs once a token."""
    if not _has(df, "arcs"):
        none = F.array().cast("array<struct<p:int,c:int,label:string>>")
        return _lines(lambda w, i: line(w, i, F.array().cast("array<int>"), none))
    of = lambda i: F.filter("arcs", lambda a: a["c"] == i)
    return let(_preds(), lambda preds: _lines(lambda w, i: let(of(i), lambda own: line(w, i, preds, own))))


def _lines(line) -> Column:
    return F.array_join(F.transform("words", line), "\n")


def _text(df: DataFrame, block: Column) -> DataFrame:
    return df.select("corpus", "sent_id", F.concat(block, F.lit("\n")).alias("value"))


def conll02_text(df: DataFrame) -> DataFrame:
    return _text(df, _lines(lambda w, i: F.concat_ws(" ", w, _cell(df, "pos", i), _cell(df, "ne_tags", i))))


def conll03_text(df: DataFrame) -> DataFrame:
    return _text(df, _lines(lambda w, i: F.concat_ws(" ", w, _cell(df, "pos", i), _cell(df, "chunks", i), _cell(df, "ne_tags", i))))


def conllx_text(df: DataFrame) -> DataFrame:
    def line(w: Column, i: Column) -> Column:
        head, rel = _head(df, i), _cell(df, "deprels", i)
        return F.concat_ws("\t", (i + 1).cast("string"), w, _cell(df, "lemmas", i), _cell(df, "cpos", i), _cell(df, "pos", i), _feats(df, i), head, rel, F.lit("_"), F.lit("_"))

    return _text(df, _lines(line))


def conll08_text(df: DataFrame) -> DataFrame:
    """Split columns repeat the unsplit ones."""

    def line(w: Column, i: Column, preds: Column, own: Column) -> Column:
        lemma, pos = _cell(df, "lemmas", i), _cell(df, "pos", i)
        return F.concat_ws("\t", (i + 1).cast("string"), w, lemma, pos, pos, w, lemma, pos, _head(df, i), _cell(df, "deprels", i), _named(own, F.lit(-1)), F.transform(preds, lambda p: _named(own, p)))

    return _text(df, _graph_lines(df, line))


def conll09_text(df: DataFrame) -> DataFrame:
    """Gold and predicted columns both from the one layer."""

    def line(w: Column, i: Column, preds: Column, own: Column) -> Column:
        lemma, pos, feats, head, rel = _cell(df, "lemmas", i), _cell(df, "pos", i), _feats(df, i), _head(df, i), _cell(df, "deprels", i)
        marked = F.when(F.array_contains(preds, i), "Y").otherwise("_")
        return F.concat_ws("\t", (i + 1).cast("string"), w, lemma, lemma, pos, pos, feats, feats, head, head, rel, rel, marked, _named(own, F.lit(-1)), F.transform(preds, lambda p: _named(own, p)))

    return _text(df, _graph_lines(df, line))


def conll_lite_text(df: DataFrame) -> DataFrame:
    def line(w: Column, i: Column, preds: Column, own: Column) -> Column:
        ident = lambda k: F.get("ids", k) if _has(df, "ids") else (k + 1).cast("string")
        return F.concat_ws("\t", ident(i), w, F.transform(own, lambda a: F.concat(F.when(a["p"] < 0, "0").otherwise(ident(a["p"])), F.lit(", "), a["label"])))

    return _text(df, _graph_lines(df, line))


def semeval_text(df: DataFrame, ne_pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """A record for each pair (k, m1, m2, label), the two mentions marked in the sentence."""
    at = lambda side: mentions.select("corpus", "sent_id", F.col("m_id").alias(side), F.struct("start", "end").alias(f"{side}_span"))
    pairs = ne_pairs.join(at("m1"), ["corpus", "sent_id", "m1"]).join(at("m2"), ["corpus", "sent_id", "m2"]).join(df.select("corpus", "sent_id", "words"), ["corpus", "sent_id"])
    opens = lambda s, tag, i: F.when(F.col(s)["start"] == i, tag).otherwise("")
    closes = lambda s, tag, i: F.when(F.col(s)["end"] == i + 1, tag).otherwise("")
    marked = F.transform("words", lambda w, i: F.concat(opens("m1_span", "<e1>", i), opens("m2_span", "<e2>", i), w, closes("m2_span", "</e2>", i), closes("m1_span", "</e1>", i)))
    record = F.concat((F.row_number().over(_by_sentence()) + F.col("sent_id") * 1000).cast("string"), F.lit('\t"'), F.array_join(marked, " "), F.lit('"\n'), F.col("label"), F.lit("\nComment:\n"))
    return pairs.select("corpus", "sent_id", "k", record.alias("value"))


def _by_sentence():
    from pyspark.sql import Window

    return Window.partitionBy("corpus", "sent_id").orderBy("k")


def json_text(df: DataFrame) -> DataFrame:
    """Layers that are null are left out."""
    fields = [F.col(n).alias(k) for k, (n, _) in JSON_LAYERS.items() if n in df.columns]
    return _text(df, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"}))


TEXTS = {"conll02": conll02_text, "conll03": conll03_text, "conllx": conllx_text, "conll08": conll08_text, "conll09": conll09_text, "lite": conll_lite_text, "json": json_text}


def write_blocks(blocks: DataFrame, path: str, in_order: bool = False) -> None:
    """Writes rows of text blocks, ordered by sentence, to a folder of compressed text files. in_order: the rows are in order already, within partitions and between them."""
    rows = blocks if in_order else blocks.repartitionByRange("corpus", "sent_id").sortWithinPartitions("corpus", "sent_id")
    rows.select("value").write.option("compression", "gzip").text(path)


def write_corpus(df: DataFrame, path: str, kind: str, in_order: bool = False) -> None:
    write_blocks(TEXTS[kind](df), path, in_order)


def convert(spark, path: str, source: str, out: str, target: str) -> None:
    """Reads one format and writes another."""
    write_corpus(READERS[source](spark, path), out, target)


def write_edge_mask(mask: DataFrame, path: str, words: DataFrame | None = None) -> None:
    """A mask as Parquet: bitmaps as a row a token, else a row an arc. words (keys, tok, word) put each child's word beside it; a child without one has null. A mask that has a column word keeps it."""
    rows = mask.select(*KEYS, *(("c", "n", "bits") if is_packed(mask) else ("p", "c", "kept")), *(["word"] if words is None and "word" in mask.columns else []))
    if words is not None:
        rows = rows.join(words.select(*KEYS, F.col("tok").alias("c"), "word"), [*KEYS, "c"], "left")
    rows.write.option("compression", "zstd").parquet(path)


def read_edge_mask(spark, path: str) -> DataFrame:
    """A mask that write_edge_mask wrote, of either kind."""
    return spark.read.parquet(path)


def metric_rows(metrics: DataFrame, name: str) -> DataFrame:
    """One row of metrics as (evaluator, key, value) rows."""
    return metrics.unpivot([], metrics.columns, "key", "value").select(F.lit(name).alias("evaluator"), "key", F.col("value").cast("double").alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    """Appends rows as tab-separated text, such as those of gain_report."""
    df.write.csv(path, sep="\t", mode="append")


def gain_report(selected: DataFrame, counts: DataFrame, extractor: str) -> DataFrame:
    """(selected, extractor, template, n_features, ig) of select_templates and feature_counts, the best first."""
    rows = selected.join(counts, "template", "left").orderBy("rank")  # a row a template
    return rows.select("selected", F.lit(extractor).alias("extractor"), "template", F.coalesce("n_features", F.lit(0)).alias("n_features"), "ig")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A column as text, a value a line in order, such as the selected templates or the gold paths."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.text(path)
