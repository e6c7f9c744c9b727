"""What is written and read again: masks, reports, pipelines of annotators."""

import pytest
from pyspark.sql import functions as F

from corpuscraft.operators import learning as ln
from corpuscraft.operators import masks
from corpuscraft.operators.windows import sample_split
from corpuscraft.sources import writers


def test_edge_masks_of_both_kinds(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, p, c, (p + c) % 2 == 0) for c in range(70) for p in range(-1, 70) if p != c], "corpus string, sent_id long, p int, c int, kept boolean")
    words = spark.createDataFrame([("a", 1, i, f"w{i}") for i in range(69)] + [("b", 1, 0, "other")], "corpus string, sent_id long, tok int, word string")
    writers.write_edge_mask(rows, str(tmp_path / "rows"))
    assert sorted(map(tuple, writers.read_edge_mask(spark, str(tmp_path / "rows")).collect())) == sorted(map(tuple, rows.collect()))
    packed = masks.packed(rows, spark.createDataFrame([("a", 1, 70)], "corpus string, sent_id long, n int"))
    writers.write_edge_mask(packed, str(tmp_path / "bits"), words)
    back = writers.read_edge_mask(spark, str(tmp_path / "bits"))
    assert sorted(map(tuple, masks.unpacked(back).collect())) == sorted(map(tuple, rows.collect()))
    assert {r.c: r.word for r in back.collect()} == {c: f"w{c}" if c < 69 else None for c in range(70)}
    writers.write_edge_mask(packed.limit(0), str(tmp_path / "none"), words)
    assert writers.read_edge_mask(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_trains_on_what_earlier_stages_made(spark):
    tokens = spark.createDataFrame([("a", 1, i, w, t) for i, (w, t) in enumerate([("He", "P"), ("he", "P"), ("ran", "V"), ("HE", "N"), ("ran", "N"), ("ran", "V")])], "corpus string, sent_id long, tok int, word string, pos string")
    lower = ln.Annotator("lower", lambda df: df.withColumn("low", F.lower("word")), ["word"], ["low"])
    seen = []

    def fit(data, gold):
        seen.append(data.columns)
        tag = ln.majority_tagger("low", "pos")(lower.annotate(gold))
        return ln.Annotator("tags", tag, ["low"], ["pred"])

    aid = ln.Annotator("aid", lambda df: df.withColumn("aid", F.lit(1)), [], ["aid"])
    stages = [ln.Trainable("aid", lambda data, gold: aid, transient=True), lower, ln.Trainable("tags", fit)]
    fitted, annotated = ln.AnnoPipeline(stages).train(tokens.drop("pos"), tokens)
    assert seen == [["corpus", "sent_id", "tok", "word", "aid", "low"]] and "aid" in annotated.columns
    out = fitted.annotate(tokens.drop("pos"))
    assert "aid" not in out.columns and {r.word: r.pred for r in out.collect()} == {"He": "P", "he": "P", "HE": "P", "ran": "V"}
    with pytest.raises(ValueError):
        fitted.stages[-1].annotate(tokens)
    accuracy = lambda g, p: g.join(p.select("tok", "pred"), "tok").agg(F.count_if(F.col("pos") == F.col("pred")).alias("right"), F.count("*").alias("all"))
    rows = ln.EvalPipeline({"one": accuracy, "two": accuracy}).evaluate(tokens, out).collect()
    assert sorted(map(tuple, rows)) == [("one", "all", 6.0), ("one", "right", 4.0), ("two", "all", 6.0), ("two", "right", 4.0)]


def test_reports_append(spark, tmp_path):
    path = str(tmp_path / "report")
    for name, n in (("a", 1), ("b", 2)):
        writers.write_report(writers.metric_rows(spark.createDataFrame([(n, n / 4)], "n int, score double"), name), path)
    got = spark.read.csv(path, sep="\t", schema="evaluator string, key string, value double").collect()
    assert sorted(map(tuple, got)) == [("a", "n", 1.0), ("a", "score", 0.25), ("b", "n", 2.0), ("b", "score", 0.5)]
    writers.write_lines(spark.createDataFrame([("y",), ("x",), ("y",)], "t string"), "t", str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["x", "y"]


def test_sample_by_a_hash_of_ones_own(spark):
    df = spark.range(40).withColumn("h", F.md5(F.col("id").cast("string")))
    got = sample_split(df, 0.25, 0, "id", by=F.col("h")).collect()
    wanted = {r.id for r in sorted(df.collect(), key=lambda r: (r.h, r.id))[:10]}
    assert {r.id for r in got if r.sampled} == wanted and len(got) == 40
