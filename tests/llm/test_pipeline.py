"""The pipeline's stages against what each is to do with its own input."""

import random

import pytest

import corpus_pipeline
from corpuscraft.llm.queries import QUERIES, SQL
from test_dedup import brute_lines
from test_texts import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels = corpus(120)
    rng = random.Random(2)
    extra = " ".join(f"w{rng.randrange(9999)}" for _ in range(300))
    docs += [(900, extra), (901, extra), (902, None), (None, "nameless text of the river and they said so")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "simhash near-dedup", "best-fit packing"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        rows[name] = (before.collect(), docs.collect())
        assert name == names[-1] or docs.columns == before.columns
    clean, kept = rows[names[0]]
    bad = {r.doc_id for r in clean if r.doc_id is not None and r.doc_id < 120 and r.doc_id % 4 == 0}
    left = {r.doc_id for r in kept}
    assert not bad & left and {r.doc_id for r in clean if r.doc_id and r.doc_id < 120} - bad <= left
    before, after = rows[names[1]]
    want = brute_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after} == {i: t for i, (t, _) in want.items()}
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after)
    before, after = rows[names[2]]
    texts = {}
    for r in before:
        texts.setdefault(r.text or "", []).append(r.doc_id)
    ids = [r.doc_id for r in after]
    for same in texts.values():
        assert sum(i in ids for i in same if i is not None) <= 1
    before, after = rows[names[3]]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert sorted(map(str, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(map(str, [r for r in docs.drop("sequence_id", "offset").collect()]))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
