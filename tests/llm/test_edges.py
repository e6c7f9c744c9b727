"""Cases that every operator of this folder must bear: clashing columns, odd types, ties, extreme values, hot keys."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscraft.llm import multiset_hash
from corpuscraft.llm.bestfit_packing import pack_documents
from corpuscraft.llm.embedding_dedup import embedding_dedup
from corpuscraft.llm.line_dedup import line_dedup
from corpuscraft.llm.mil_quality import Model, reject_low_quality, score, train
from corpuscraft.llm.multiset_hash import Fingerprint, document_fingerprints, edited
from corpuscraft.llm.simhash_dedup import fingerprint, keep_one, simhash_dedup

CONSTANT = Model(np.zeros(260, np.float32), np.ones(260, np.float32), [], 1.0)


def test_quality_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5, 0.25, "m")], "doc_id long, text string, _score string, c0 long, score double, predicted string")
    got = score(docs, CONSTANT, keep=True)
    assert got.columns == ["doc_id", "text", "_score", "c0", "held_out", "score", "predicted"]
    assert got.first()["_score"] == "x" and got.first()["score"] == 1.0
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert reject_low_quality(docs, labels).collect() == docs.collect()


def test_training_sample_is_bounded_and_ignores_repeats(spark):
    rows = [(i, ("good text and more of it. " if i % 2 else "!!! $$$ ### ") * 30) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once, twice = train(docs, labels), train(docs.union(docs), labels)
    assert all((a == b).all() for a, b in zip(once.weights, twice.weights))
    assert train(docs, labels, passages=0).constant == 1.0


def test_lines_keep_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "one two\none two", "x", "y", 7), (2, "one two", "x", "y", 7)], "doc_id long, text string, _gone string, row string, n_lines int")
    got = sorted(line_dedup(docs).collect())
    assert [(r.doc_id, r.text, r["_gone"], r["row"], r.n_lines, r.n_removed) for r in got] == [(1, "one two", "x", "y", 2, 1), (2, "", "x", "y", 1, 1)]


def test_a_line_in_every_document(spark):
    docs = spark.createDataFrame([(i, f"all of us have this line\nown line number {i} of {i * 7919} things {i}") for i in range(3000)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup(docs).collect()}
    assert got == {i: int(i > 0) for i in range(3000)}


def test_vectors_of_any_length(spark):
    rows = [(1, [1e-200, 2e-200], "a"), (2, [1e200, 2e200], "a"), (3, [1.0, 2.0], "a"), (4, [1.0, -2.0], "a"), (5, [5e-324, 1e-323], "a"), (6, [float("inf"), 1.0], "a")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1), 6: (0, 6)}


@pytest.mark.parametrize("kind", ["smallint", "int", "bigint", "string", "double"])
def test_packing_of_any_id(spark, kind):
    docs = spark.sql(f"select cast(id as {kind}) as doc_id, 'a b c' as text from range(3) union all select cast(null as {kind}), null")
    got = pack_documents(docs)
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert got.count() == 4 and got.where("doc_id is null and length = 1").count() == 1


def _triples(text: str) -> Counter:
    out: Counter = Counter()
    for p in text.split("\n"):
        w = p.split()
        out.update(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)) if w)
    return out


def test_likeness_is_that_of_the_counts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    apart = []
    for _ in range(60):
        a = "\n".join(" ".join(rng.choices(words, k=20)) for _ in range(20))
        b = edited(a, "\n".join(" ".join(rng.choices(words, k=20)) for _ in range(20)))
        x, y = _triples(a), _triples(b)
        gone = sum((x[t] - y[t]) ** 2 for t in x | y)
        want = max(0.0, 1 - gone / (sum(v * v for v in x.values()) + sum(v * v for v in y.values())))
        apart.append(Fingerprint.of(a).likeness(Fingerprint.of(b)) - want)
    assert abs(np.mean(apart)) < 0.05 and np.max(np.abs(apart)) < 0.35


def test_fingerprint_frame_against_each_row_and_its_next(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["", None, "same text\nhere", " ".join(rng.choices("abcdef", k=rng.randrange(40)))])) for _ in range(150)]
    got = document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((i, len(t or ""), Fingerprint.of(t).text()) for i, t in rows)
    ids = defaultdict(list)
    for r in got:
        ids[r.doc_id].append(r)
    order = sorted({i for i, _ in rows}, key=lambda i: -1 if i is None else i)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    import hashlib

    for here, after in zip(order, order[1:] + order[:1]):  # the last row of an id is followed by one of the next id
        crossing = {hashlib.sha256(edited(a, b).encode()).hexdigest() for a in texts[here] for b in texts[after] + texts[here]}
        assert all(r.edited_sha256 in crossing for r in ids[here])


def test_near_copies_of_one_id_are_decided_by_text(spark):
    a, b = "the first text of them all has words", "quite another one with other words in it"
    docs = spark.createDataFrame([(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, a, "x"), (3, b, "x")], "doc_id long, text string, kept string")
    got = sorted((r.doc_id or 0, r.text) for r in keep_one(docs).collect())
    assert got == [(0, a), (1, a), (2, b)]
    assert keep_one(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    rng, base = random.Random(5), [f"w{i}" for i in range(300)]
    rows = []
    for i in range(4000):
        words = list(base)
        words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    prints = [fingerprint(t) for _, t in rows]
    got = {r.doc_id: r.component_id for r in simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    classes = sorted(set(prints))
    root = {p: p for p in classes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = np.array(classes, np.uint64)
    for i, p in enumerate(classes):
        for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3)[0]:
            x, y = find(p), find(classes[i + 1 + int(j)])
            root[max(x, y)] = min(x, y)
    least: dict = {}
    for i, p in enumerate(prints):
        least.setdefault(find(p), i)
    assert got == {i: least[find(p)] for i, p in enumerate(prints)}


def test_stages_with_nothing_and_with_more_columns(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, _gone string, row string, score double"
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    full = spark.createDataFrame([(i, f"Some words of text number {i}\n\nand the same line", "en", "s", 9, "g", "r", 0.5) for i in range(6)] + [(None, None, None, None, None, None, None, None)], shape)
    for docs in (full, full.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == (docs is full)


def test_a_document_of_very_many_lines(spark):
    """In proportion to the lines: this took minutes when each line was looked up among all that go."""
    n = 120_000
    text = "the same line of some words\n" * n + "another line of its own here"
    docs = spark.createDataFrame([(1, text), (2, "the same line of some words\n\nlast")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(docs).collect()}
    assert got == {1: ("the same line of some words\nanother line of its own here", n + 1, n - 1), 2: ("\nlast", 3, 1)}


def test_fingerprints_of_long_texts_piece_by_piece(monkeypatch):
    from corpuscraft.llm import simhash_dedup as sd

    rng = random.Random(9)
    words = [f"w{rng.randrange(500)}" + "x" * rng.randrange(40) for _ in range(3000)]
    texts = [rng.choice([" ", "\n", "\t  "]).join(words[:k]) + tail for k in (0, 1, 2, 3, 4, 100, 3000) for tail in ("", " ", "\nend")]
    whole = [fingerprint(t) for t in texts]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(sd, "SLICE", size)
        assert [fingerprint(t) for t in texts] == whole
    assert [fingerprint(t, 5) for t in texts[:9]] and fingerprint("x" * 5000) == fingerprint(" " + "x" * 5000)


def test_a_long_text_takes_little_memory():
    import tracemalloc

    text = "some words of a text that is long " * 300_000  # 10 MB, 2.4 million words
    tracemalloc.start()
    fingerprint(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20


def test_bounds_of_fingerprints_stay_few(spark, monkeypatch):
    """However many bytes and however hot a row, the driver holds a bounded sample, and results stay whole."""
    rows = [(i, f"text {i % 50} " * (i % 9)) for i in range(900)] + [(5, "hot " * 40)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    wanted = Counter(map(tuple, document_fingerprints(df).collect()))
    monkeypatch.setattr(multiset_hash, "RANGE", 50)
    monkeypatch.setattr(multiset_hash, "RANGES", 40)
    monkeypatch.setattr(multiset_hash, "SAMPLE", 10)
    sampled = df.withColumn("place", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    assert 10 < len(multiset_hash._bounds(sampled, 3)) <= 41
    assert Counter(map(tuple, document_fingerprints(df).collect())) == wanted
