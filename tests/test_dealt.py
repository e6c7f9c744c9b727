"""What is shuffled and written: queries deal out sentences as text, not their layers, and read files where they lie."""

import glob

import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["conll02", "conll03", "conllx", "json", "lite", "conll08", "conll09"])
def test_formats_write_compressed_text_and_number_without_a_shuffle(spark, kind):
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{kind}-*/*"))
    df = e.queries()[f"{kind}_round_trip"](spark, SF)
    assert "Exchange" not in plan(df).replace("BroadcastExchange", "")
    new = {f for f in glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/{kind}-*/part-*") if f not in before}
    assert new and all(f.endswith(".txt.gz") for f in new)
    assert sorted(r.sent_id for r in df.select("sent_id").collect()) == list(range(df.count()))


@pytest.mark.parametrize("query", ["convert_formats", "lite_v2"])
def test_lite_is_read_where_it_lies(spark, query):
    df = e.queries()[query](spark, SF)
    assert "rangepartitioning" not in plan(df)


#: Queries that make all they need in the sentence's row.
IN_ROW = ["role_pairs", "role_structures", "srl_features", "mask_ops", "topk_heads", "score_prune", "mask_counts", "mask_files", "constituent_path", "learned_tags", "genealogy", "dep_path", "template_sets", "arc_set_features", "distance_prune", "gain_reports"]


@pytest.mark.parametrize("query", IN_ROW)
def test_no_join_or_window_by_sentence(spark, query):
    text = plan(e.queries()[query](spark, SF))
    assert not any(line for line in text.split("\n") if ("Join" in line or "Window" in line) and "sent_id" in line)
    # what is dealt out by sentence is its blocks of heads, or sums
    dealt = [line for line in text.split("\n") if "Exchange hashpartitioning" in line and "tok#" in line]
    assert not dealt


def test_pairs_in_the_row_are_those_of_the_joins(spark):
    from corpuscraft.operators.joins import arc_label, labelled_pairs, role_pairs
    from corpuscraft.operators.tables import arcs, known_pairs, known_preds

    kind = "corpus string, sent_id long, n int, arcs array<struct<p:int,c:int,label:string>>, skip array<struct<p:int,c:int>>"
    s = spark.createDataFrame([("s", 1, 3, [(-1, 1, "eat.01"), (1, 0, "A0"), (1, 1, "A1")], [(1, 0), (1, 2)]), ("s", 2, 2, [], [])], kind)
    toks = s.selectExpr("corpus", "sent_id", "explode(sequence(0, n - 1)) as tok")
    skip = s.selectExpr("corpus", "sent_id", "inline(skip)")
    a = arcs(s)
    for structure, given in (("PREDS_GIVEN", {"preds": known_preds(a)}), ("PAIRS_GIVEN", {"pairs": known_pairs(a)}), ("NO_ROLES", {}), ("ALL_PAIRS", {})):
        for loops in (True, False):
            rows = lambda df: sorted(tuple(r) for r in df.select("sent_id", "p", "c", "label").collect())
            assert rows(labelled_pairs(s, structure, loops, "skip")) == rows(arc_label(role_pairs(toks, structure, self_loops=loops, skip=skip, **given), a))


def test_scored_bits_are_those_of_the_scores(spark):
    from pyspark.sql import functions as F

    from corpuscraft.operators import masks

    score = lambda p, c, s: (p * 31 + c * 17 + s) % 101 / 100.0
    x = spark.range(300).select(F.lit("s").alias("corpus"), F.col("id").alias("sent_id"), (F.col("id") % 90 + 1).cast("int").alias("n"), (F.col("id") % (F.col("id") % 90 + 1)).cast("int").alias("c"))
    values = F.transform(F.sequence(F.lit(-1), F.col("n") - 1), lambda p: F.when(p != F.col("c"), F.pmod(p * 31 + F.col("c") * 17 + F.col("sent_id"), F.lit(101)) / 100.0))
    scored = x.withColumn("scores", values)
    old = {r.sent_id: r.bits for r in masks.combined(masks.top_mask(scored, 3), masks.marginal_mask(scored, 0.9), "and").collect()}
    new = {r.sent_id: r.bits for r in x.withColumn("bits", masks.scored_bits(F.col("n"), F.col("c"), score, [F.col("c"), F.col("sent_id")], 3, 0.9)).collect()}
    assert old == new


def test_parts_that_lie_by_sentence_are_dealt_out_together(spark):
    from pyspark.sql import functions as F

    from corpuscraft.operators.joins import n_mentions_between, ne_pairs

    keys = spark.range(400).select(F.lit("s").alias("corpus"), F.col("id").alias("sent_id"))
    m = keys.repartition("sent_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("start"))
    m = m.select("corpus", "sent_id", F.concat(F.lit("m"), "start").alias("m_id"), "start", (F.col("start") + 1).alias("end"), F.col("start").alias("head"), F.lit("PER").alias("type"), F.lit(None).cast("string").alias("subtype"))
    args = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(i).alias("m_id")) for r, i in (("Arg-1", "m0"), ("Arg-2", "m1"))))
    rels = m.where("start = 0").select("corpus", "sent_id", F.lit(0).alias("rel_id"), F.lit("ART").alias("type"), F.lit(None).cast("string").alias("subtype"), args.alias("args"))
    rows = n_mentions_between(ne_pairs(m, rels), m).collect()
    assert {(r.k, r.m1, r.m2, r.n_between) for r in rows} == {(0, "m0", "m1", 0), (1, "m0", "m2", 1), (2, "m0", "m3", 2), (3, "m1", "m2", 0), (4, "m1", "m3", 1), (5, "m2", "m3", 0)}
    assert len(rows) == 2400


def test_mentions_found_in_the_row(spark):
    from corpuscraft.plans.queries import _mention_rows, _mentions, _toks

    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(_mention_rows(spark, SF)) == rows(_mentions(_toks(spark, SF, names=True)))
