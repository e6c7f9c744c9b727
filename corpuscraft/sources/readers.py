"""Corpus formats as DataFrames of sentences: one row a sentence, one array column a layer.

Every reader reads blocks between blank lines with Spark's text source, so a file is split over tasks,
and numbers the sentences by file and place in it. A path may be a folder, with ``recursive`` one of folders. Lines may end in CRLF. Blocks without a token are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import null_if_underscore
from ..operators.tables import settled


def read_blocks(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", recursive: bool = False) -> DataFrame:
    """(file, start, lines): the lines of each block between blank lines, with the place in its file where the part begins that a task reads; blocks are in order within it.

    Blocks are cut at an empty line while reading; blank lines of spaces or with a carriage return are cut after it. Other
    encodings than UTF-8 are read by whole files.
    """
    if encoding.upper().replace("-", "") != "UTF8":
        files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
        raw = files.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), F.decode("content", encoding).alias("value"))
    else:
        text = spark.read.option("lineSep", "\n\n").option("recursiveFileLookup", recursive).text(path)
        raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    parts = raw.select("file", "start", F.explode(F.split("value", r"(?:\r?\n)[ \t]*(?:\r?\n)+|^\s*\n")).alias("block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: F.trim(x) != "")
    return parts.select("file", "start", lines.alias("lines")).where(F.size("lines") > 0)


def number(df: DataFrame, corpus: str) -> DataFrame:
    """Adds corpus and sent_id: consecutive from 0 by file and place. Rows stay where they are read: one pass counts those of each part of a file, the next adds how many stand before. If the parts are dealt out to other tasks in between, that is an error."""
    placed = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = placed.groupBy("file", "start", "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first")).collect()  # a row a part
    bases, total = [], 0
    for r in sorted(parts, key=lambda r: (r["file"], r["start"])):
        bases.append((r["file"], r["start"], r["_p"], total - r["first"]))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(bases, "file string, start long, _p int, _base long")
    base = F.when(F.col("_base").isNull(), F.raise_error(F.lit("the files were dealt out anew while sentences were numbered")).cast("long")).otherwise(F.col("_base"))
    return placed.join(F.broadcast(offsets), ["file", "start", "_p"], "left").select(F.lit(corpus).alias("corpus"), (base + F.col("_i")).alias("sent_id"), *[c for c in df.columns if c not in ("file", "start")])


def _cells(lines: Column, sep: str) -> Column:
    return F.transform(lines, lambda x: F.split(F.trim(x) if sep == r"\s+" else x, sep))


def _layer(i: int) -> Column:
    return F.transform("cells", lambda c: F.get(c, F.lit(i)))


def _nullable(i: int) -> Column:
    return F.transform("cells", lambda c: null_if_underscore(F.get(c, F.lit(i))))


def _heads(i: int) -> Column:
    """1-based heads with 0 for the wall to 0-based with -1; an underscore becomes -2."""
    return F.transform("cells", lambda c: F.coalesce(null_if_underscore(F.get(c, F.lit(i))).cast("int"), F.lit(-1)) - 1)


def _feats(i: int) -> Column:
    return F.transform("cells", lambda c: F.split(null_if_underscore(F.get(c, F.lit(i))), r"\|"))


def _checked(df: DataFrame, least: int) -> DataFrame:
    short = F.exists("cells", lambda c: F.size(c) < least)
    return df.withColumn("cells", F.when(short, F.raise_error(F.concat(F.lit(f"a line has fewer than {least} columns: "), F.array_join(F.flatten("cells"), " ")))).otherwise(F.col("cells")))


def _table(spark: SparkSession, path: str, corpus: str, least: int, layers: dict[str, Column], encoding: str = "UTF-8", sep: str = r"\s+", recursive: bool = False) -> DataFrame:
    cells = _checked(read_blocks(spark, path, encoding, recursive).select("file", "start", _cells(F.col("lines"), sep).alias("cells")), least)
    return number(settled(cells).select("file", "start", *(c.alias(n) for n, c in layers.items())), corpus)


def read_conll02(spark: SparkSession, path: str, corpus: str = "conll02", encoding: str = "UTF-8", recursive: bool = False) -> DataFrame:
    return _table(spark, path, corpus, 3, {"words": _layer(0), "pos": _layer(1), "ne_tags": _layer(2)}, encoding, recursive=recursive)


def read_conll03(spark: SparkSession, path: str, corpus: str = "conll03", encoding: str = "UTF-8", recursive: bool = False) -> DataFrame:
    """The document mark is a sentence of its own."""
    return _table(spark, path, corpus, 4, {"words": _layer(0), "pos": _layer(1), "chunks": _layer(2), "ne_tags": _layer(3)}, encoding, recursive=recursive)


def read_conllx(spark: SparkSession, path: str, corpus: str = "conllx", use_phead: bool = False, recursive: bool = False) -> DataFrame:
    head = 8 if use_phead else 6
    return _table(spark, path, corpus, 8, {"words": _layer(1), "lemmas": _nullable(2), "cpos": _nullable(3), "pos": _nullable(4), "feats": _feats(5), "parents": _heads(head), "deprels": _nullable(head + 1)}, recursive=recursive)


def _arcs(pred_column: int, first: int, marked: Column | None = None) -> Column:
    """Predicates and roles from the columns behind ``first``: the k-th of them belongs to the k-th predicate."""
    is_pred = (lambda c: F.get(c, F.lit(pred_column)) != "_") if marked is None else (lambda c: F.get(c, marked) == "Y")
    preds = F.filter(F.transform("cells", lambda c, i: F.when(is_pred(c), i)), lambda i: i.isNotNull())
    senses = F.transform(preds, lambda i: F.struct(F.lit(-1).alias("p"), i.alias("c"), F.get(F.get("cells", i), F.lit(pred_column)).alias("label")))
    roles = F.flatten(
        F.transform(
            preds,
            lambda p, k: F.filter(
                F.transform("cells", lambda c, i: F.struct(p.alias("p"), i.alias("c"), null_if_underscore(F.get(c, first + k)).alias("label"))),
                lambda a: a["label"].isNotNull(),
            ),
        )
    )
    return F.concat(senses, roles)


def read_conll08(spark: SparkSession, path: str, corpus: str = "conll08", gold: bool = True, split_forms: bool = True, recursive: bool = False) -> DataFrame:
    """Forms, lemmas and tags of the split or unsplit words; heads and relations only with ``gold``."""
    layers = {"words": _layer(5 if split_forms else 1), "lemmas": _nullable(6 if split_forms else 2), "pos": _nullable(3 if gold else 7 if split_forms else 4)}
    none_i, none_s = F.lit(None).cast("array<int>"), F.lit(None).cast("array<string>")
    layers |= {"parents": _heads(8) if gold else none_i, "deprels": _nullable(9) if gold else none_s, "arcs": _arcs(10, 11)}
    return _table(spark, path, corpus, 11, layers, recursive=recursive)


def read_conll09(spark: SparkSession, path: str, corpus: str = "conll09", gold: bool = False, recursive: bool = False) -> DataFrame:
    """With ``gold`` the gold columns, else the predicted ones. Lemmas are not null-mapped."""
    g = 0 if gold else 1
    layers = {"words": _layer(1), "lemmas": _layer(2 + g), "pos": _nullable(4 + g), "feats": _feats(6 + g), "parents": _heads(8 + g), "deprels": _nullable(10 + g), "arcs": _arcs(13, 14, F.lit(12))}
    return _table(spark, path, corpus, 14, layers, recursive=recursive)


def read_conll_lite(spark: SparkSession, path: str, corpus: str = "lite", recursive: bool = False) -> DataFrame:
    """Tab-separated id, form and edges ``head, label``; ids are any strings, quotes beside a tab don't count, comments are lines and last columns from a hash on; an unknown head is an error."""
    blocks = read_blocks(spark, path, recursive=recursive).select("file", "start", F.filter("lines", lambda x: ~F.ltrim(x).startswith("#")).alias("lines")).where(F.size("lines") > 0)
    cells = blocks.select("file", "start", F.transform("lines", lambda x: F.split(x, "\"?\t\"?")).alias("cells"))
    named = cells.withColumn("ids", F.transform("cells", lambda c: F.trim(F.get(c, F.lit(0)))))
    counted = F.forall(F.transform("ids", lambda x, i: x == (i + 1).cast("string")), lambda x: x)  # ids mostly count from 1, so a head's place is its id
    cells = settled(settled(named).withColumn("counted", counted))
    ids = F.col("ids")

    def edge(e: Column, child: Column) -> Column:
        head = F.trim(F.regexp_extract(e, r"^([^,]*),", 1))
        number = F.when(F.col("counted") & head.rlike("^[1-9][0-9]{0,8}$"), head.try_cast("int"))
        place = F.when(F.get(ids, number - 1) == head, number).otherwise(F.array_position(ids, head).cast("int"))
        at = F.when(head.isin("0", "-1"), F.lit(0)).otherwise(place)
        at = F.when((at == 0) & ~head.isin("0", "-1"), F.raise_error(F.concat(F.lit("no token has the id "), head))).otherwise(at)
        return F.struct((at - 1).cast("int").alias("p"), child.alias("c"), F.trim(F.regexp_extract(e, r"^[^,]*,(.*)$", 1)).alias("label"))

    def edges(c: Column) -> Column:
        rest = F.slice(c, 3, F.greatest(F.size(c), F.lit(1)))
        comment = F.array_position(F.transform(rest, lambda e: F.ltrim(e).startswith("#")), True)
        return F.filter(F.slice(rest, 1, F.when(comment > 0, (comment - 1).cast("int")).otherwise(F.size(rest))), lambda e: F.trim(e) != "")

    arcs = F.flatten(F.transform("cells", lambda c, i: F.transform(edges(c), lambda e: edge(e, i))))
    return number(cells.select("file", "start", "ids", F.transform("cells", lambda c: F.trim(F.get(c, F.lit(1)))).alias("words"), arcs.alias("arcs")), corpus)


def read_semeval(spark: SparkSession, path: str, corpus: str = "semeval", recursive: bool = False) -> DataFrame:
    """Records of a marked sentence, a relation and a comment: words, two mentions and the relation label."""
    blocks = read_blocks(spark, path, recursive=recursive).where(F.size("lines") >= 2)
    quoted = F.regexp_extract(F.get("lines", F.lit(0)), r'^\s*(\d+)\s+"?(.*?)"?\s*$', 2)
    marked = F.split(quoted, " +")
    plain = F.transform(marked, lambda w: F.regexp_replace(w, "</?e[12]>", ""))

    def mention(k: int) -> Column:
        start = F.array_position(F.transform(marked, lambda w: w.contains(f"<e{k}>")), F.lit(True))
        end = F.array_position(F.transform(marked, lambda w: w.contains(f"</e{k}>")), F.lit(True))
        return F.struct(F.lit(f"e{k}").alias("m_id"), (start - 1).cast("int").alias("start"), end.cast("int").alias("end"), (end - 1).cast("int").alias("head"))

    return number(
        blocks.select(
            "file", "start", F.regexp_extract(F.get("lines", F.lit(0)), r"^\s*(\d+)", 1).cast("long").alias("record_id"), plain.alias("words"),
            F.array(mention(1), mention(2)).alias("mentions"), F.trim(F.get("lines", F.lit(1))).alias("rel_label"), F.trim(F.regexp_replace(F.get("lines", F.lit(2)), r"^Comment:\s*", "")).alias("comment"),
        ),
        corpus,
    )


#: Keys of a JSON sentence record, and the layer and type of each.
JSON_LAYERS = {
    "words": ("words", "array<string>"), "prefixes": ("prefixes", "array<string>"), "lemmas": ("lemmas", "array<string>"), "posTags": ("pos", "array<string>"),
    "cposTags": ("cpos", "array<string>"), "strictPosTags": ("spos", "array<string>"), "clusters": ("clusters", "array<string>"), "feats": ("feats", "array<array<string>>"),
    "deprels": ("deprels", "array<string>"), "parents": ("parents", "array<int>"), "chunks": ("chunks", "array<string>"), "neTags": ("ne_tags", "array<string>"),
    "naryTree": ("tree", "string"), "namedEntities": ("named_entities", "string"), "nePairs": ("ne_pairs", "string"), "relLabels": ("rel_labels", "array<string>"),
}


def read_json_sents(spark: SparkSession, path: str, corpus: str = "json", recursive: bool = False) -> DataFrame:
    """Records of JSON between blank lines. A key that isn't known is an error."""
    raw = read_blocks(spark, path, recursive=recursive).select("file", "start", F.array_join("lines", "\n").alias("json"))
    unknown = F.array_except(F.json_object_keys("json"), F.array(*map(F.lit, JSON_LAYERS)))
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", ")))).otherwise(F.col("json"))
    schema = ", ".join(f"`{k}` {t}" for k, (_, t) in JSON_LAYERS.items())
    parsed = raw.select("file", "start", F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("x"))
    return number(parsed.select("file", "start", *(F.col(f"x.{k}").alias(n) for k, (n, _) in JSON_LAYERS.items())), corpus)


def read_embeddings(spark: SparkSession, path: str, vocab: DataFrame | None = None) -> DataFrame:
    """(word, vec) of tab-separated lines, restricted to ``vocab`` (word) if given. Lines of unequal length are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("x"))
    rows = lines.select(F.get("x", F.lit(0)).alias("word"), F.transform(F.slice("x", 2, F.size("x")), lambda v: v.cast("double")).alias("vec"))
    sizes = rows.select(F.size("vec").alias("n")).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(r.n for r in sizes)}")
    return rows.join(vocab.select("word").distinct(), "word", "left_semi") if vocab is not None else rows


def read_clusters(spark: SparkSession, path: str, max_len: int | None = None) -> DataFrame:
    """(word, cluster) of tab-separated bit strings and words; the bit strings are cut at ``max_len``."""
    rows = spark.read.csv(path, sep="\t", schema="cluster string, word string, cnt long", quote="")
    return rows.select("word", (F.substring("cluster", 1, max_len) if max_len else F.col("cluster")).alias("cluster"))


def read_tag_map(spark: SparkSession, path: str) -> DataFrame:
    """(tag, reduced); lines without two columns are skipped."""
    return spark.read.csv(path, sep="\t", schema="tag string, reduced string", quote="").where("reduced is not null")


def limit_corpus(df: DataFrame, min_len: int | None = None, max_len: int | None = None, max_sents: int | None = None, pred: Column | None = None) -> DataFrame:
    """Sentences of a length and with a property; then the first ``max_sents`` of those."""
    n = F.size("words")
    for keep in ((n >= min_len) if min_len is not None else None, (n <= max_len) if max_len is not None else None, pred):
        df = df.where(keep) if keep is not None else df
    return df.orderBy("corpus", "sent_id").limit(max_sents) if max_sents is not None else df


READERS = {"conll02": read_conll02, "conll03": read_conll03, "conllx": read_conllx, "conll08": read_conll08, "conll09": read_conll09, "lite": read_conll_lite, "semeval": read_semeval, "json": read_json_sents}
