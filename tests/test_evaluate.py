"""Evaluators and windows on small cases with known answers."""

import pytest

from corpuscraft.operators import aggregates as ag
from corpuscraft.operators import evaluate as ev
from corpuscraft.operators import pairs as pr
from corpuscraft.operators import significance as sg
from corpuscraft.operators.tables import tokens
from corpuscraft.operators.windows import bio03_to_02, bio_spans, chunks, folds, sample_split


def tags(spark, *rows):
    data = [("x", s, t, tag) for s, row in enumerate(rows) for t, tag in enumerate(row.split())]
    return spark.createDataFrame(data, "corpus string, sent_id long, tok int, ne_tag string")


GOLD = "B-PER B-ORG I-ORG I-ORG O B-LOC"


@pytest.mark.parametrize(("pred", "want"), [(GOLD, (3, 3, 3)), ("B-PER B-ORG I-ORG O O B-LOC", (2, 3, 3)), ("O B-ORG I-ORG O O B-LOC", (1, 2, 3))])
def test_ner_f1(spark, pred, want):
    r = ev.ner_f1(tags(spark, GOLD), tags(spark, pred)).first()
    assert (r.n_correct, r.n_pred, r.n_gold) == want


def test_ner_without_prediction(spark):
    none = tags(spark, GOLD).selectExpr("corpus", "sent_id", "tok", "cast(null as string) ne_tag")
    r = ev.ner_f1(tags(spark, GOLD), none).first()
    assert (r.n_correct, r.n_pred, r.n_gold, r.f1) == (0, 0, 3, 0.0)


@pytest.mark.parametrize("row", [GOLD, "I-PER I-ORG I-ORG I-ORG O I-LOC"])
def test_chunks_of_bio_and_io(spark, row):
    got = {(r.start, r.end, r.type) for r in chunks(tags(spark, row)).collect()}
    assert got == {(0, 1, "PER"), (1, 4, "ORG"), (5, 6, "LOC")}


def test_bio_conversion_and_spans(spark):
    got = [r.ne_tag for r in bio03_to_02(tags(spark, "I-PER I-PER I-ORG O I-ORG B-ORG")).orderBy("tok").collect()]
    assert got == "B-PER I-PER B-ORG O B-ORG B-ORG".split()
    spans = bio_spans(tags(spark, "O B-NP I-NP O B-VP"), "ne_tag", include_o=True).orderBy("k").collect()
    assert [(r.start, r.end, r.label) for r in spans] == [(0, 1, "O"), (1, 3, "NP"), (3, 4, "O"), (4, 5, "VP")]


SRL_GOLD = [(-1, 1, "like.01"), (1, 0, "agent"), (1, 2, "patient"), (1, 3, "nonarg"), (-1, 2, "eat.01"), (2, 0, "agent"), (2, 3, "patient")]
SRL_PRED = [(-1, 1, "like.01"), (1, 0, "agent"), (1, 1, "patient"), (1, 3, "nonarg"), (-1, 2, "drink.01"), (2, 3, "theme"), (-1, 0, "run.02")]


def arcs(spark, rows):
    return spark.createDataFrame([("x", 0, *r) for r in rows], "corpus string, sent_id long, p int, c int, label string")


SRL_CASES = [("FFFT", 3, 4, 5), ("TFFT", 2, 4, 5), ("FTFT", 5, 6, 7), ("TTFT", 3, 6, 7), ("FFTT", 5, 7, 7), ("TFTT", 4, 7, 7), ("FTTT", 5, 7, 7), ("TTTT", 3, 7, 7), ("FFTF", 2, 3, 2), ("TTTF", 1, 3, 2)]


def test_srl_scores(spark):
    """Each choice of labeled, sense, position, roles, with whole sense labels; then two by their endings."""
    g, p = arcs(spark, SRL_GOLD), arcs(spark, SRL_PRED)
    counts = lambda df: {r.kind: (r.n_correct, r.n_pred, r.n_gold) for r in df.collect()}
    kinds = {k: tuple(x == "T" for x in k) for k, *_ in SRL_CASES}
    assert counts(ev.srl_scores(g, p, kinds, suffix=False)) == {k: tuple(w) for k, *w in SRL_CASES}
    assert counts(ev.srl_scores(g, p, {"all": kinds["TTFT"], "sense": (True, True, False, False)})) == {"all": (4, 6, 7), "sense": (2, 2, 2)}
    skip = spark.createDataFrame([("x", 0, 1, 0)], "corpus string, sent_id long, p int, c int")
    assert ev.srl_f1(g, p, skip=skip).first().n_gold == 6


def test_suite_of_equal_corpora(spark):
    toks = spark.createDataFrame([("x", 0, i, w, t, h, "r") for i, (w, t, h) in enumerate([("cats", "NN", 1), ("like", "VB", -1), (".", ".", 1)])], "corpus string, sent_id long, tok int, word string, pos string, parent int, deprel string")
    props = spark.createDataFrame([("x", 0, 1, 0, "volition", "LIKELY"), ("x", 0, 1, 2, "change", "UNLIKELY")], "corpus string, sent_id long, pred int, arg int, property string, label string")
    labels = spark.createDataFrame([("x", 0, 0, "ART(Arg-1,Arg-2)"), ("x", 0, 1, "NO_RELATION")], "corpus string, sent_id long, k int, label string")
    own = {"tokens": toks, "arcs": arcs(spark, [(-1, 1, "like.01"), (1, 0, "A0"), (1, 1, "A1"), (1, 2, "A2")]), "props": props, "labels": labels}
    got = {r.metric: r for r in ev.evaluate_suite(own, own | {"heads": pr.candidate_heads(toks, pr.fit_distance_pruner(toks))}).collect()}
    assert {m for m, r in got.items() if r.score != 1.0} == {"self_loops", "pruning_efficiency", "sprl_change", "sprl_majority_change", "sprl_majority_all"}
    assert got["self_loops"].score == 0.25 and got["sprl"].n_gold == 1 and got["relations"].n_gold == 1 and len(got) > 30


PAIRS = [(3, 3), (0, 2), (0, 1), (3, 1), (0, 1), (3, 5), (0, 0), (0, 0), (2, 0), (3, 3)]


def test_confusion(spark):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in PAIRS], "gold string, pred string")
    cells = ev.confusion(df)
    assert {(r.gold, r.pred): r.n for r in cells.collect()} == {("3", "3"): 2, ("0", "2"): 1, ("0", "1"): 2, ("3", "1"): 1, ("3", "5"): 1, ("0", "0"): 2, ("2", "0"): 1}
    r = ev.confusion_scores(cells, ["0"]).first()
    assert (r.n_correct, r.n_total, r.accuracy) == (2, 10, 0.4)
    empty = ev.confusion_scores(ev.confusion(df.limit(0)), ["0"]).first()
    assert (empty.precision, empty.recall, empty.f1, empty.accuracy) == (1.0, 1.0, 1.0, 1.0)
    grid = {r.gold: r.asDict() for r in ev.confusion_grid(cells, ["0", "1", "2", "3", "5"]).collect()}
    assert grid["3"]["total"] == 4 and grid["0"]["1"] == 2


@pytest.mark.parametrize(("n", "k", "want"), [(7, 2, [3, 4]), (7, 3, [2, 2, 3]), (9, 5, [1, 1, 1, 1, 5])])
def test_folds(spark, n, k, want):
    rows = folds(spark.range(n).withColumnRenamed("id", "sent_id"), k, "sent_id").collect()
    assert [sum(r.fold == i for r in rows) for i in range(k)] == want
    assert sorted(rows, key=lambda r: r.sent_id) == sorted(rows, key=lambda r: (r.fold, r.sent_id))


def test_too_many_folds(spark):
    with pytest.raises(ValueError, match="folds"):
        folds(spark.range(2), 3, "id")


def test_sample_has_the_asked_size(spark):
    x = sample_split(spark.range(101), 0.25, 3, "id").collect()
    assert sum(r.sampled for r in x) == 26 and len(x) == 101


def tree(spark, parents, words=None):
    data = [("x", 0, t, w, p, "r") for t, (p, w) in enumerate(zip(parents, words or ["w"] * len(parents)))]
    return spark.createDataFrame(data, "corpus string, sent_id long, tok int, word string, parent int, deprel string")


def test_attachment(spark):
    g, p = tree(spark, [-1, 0, 1], ["a", "b", "."]), tree(spark, [-1, 2, 1])
    assert ev.attachment(g, p).first().n_correct == 2 and ev.attachment(g, p, labeled=True, skip_punct=True).first()[:2] == (1, 2)
    assert ev.attachment(g, p.limit(0)).first()[:2] == (0, 3) and ev.tree_exact_match(g, g).first().score == 1.0


def test_evaluating_gold_against_itself(spark):
    x = tree(spark, [-1, 0, 1])
    assert all(r.score == 1.0 for r in ev.evaluate_all(x, x).collect())


def test_tree_stats(spark):
    r = ag.tree_stats(tree(spark, [-1, -1, -2])).first()
    assert (r.n_roots, r.n_sents, r.n_missing) == (2, 1, 1)


def test_vocabulary_cutoff(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 3), ("d", 1)], "word string, cnt long")
    got = {r.word: (r.cnt, r.id) for r in ag.build_vocab(counts, 7).collect()}
    assert got == {"<UNK>": (1, 0), "<START>": (0, 1), "<END>": (0, 2), "<WALL>": (0, 3), "a": (5, 4), "b": (3, 5), "c": (3, 6)}
    assert {r.word for r in ag.build_vocab(counts, 6).collect()} == {"<UNK>", "<START>", "<END>", "<WALL>", "a"}  # b and c don't fit together


def test_category_choice_beats_any_other(spark):
    cells = spark.createDataFrame([("a", "1", "0", 9), ("a", "0", "0", 1), ("b", "1", "0", 1), ("b", "0", "0", 9), ("c", "1", "0", 5), ("c", "0", "0", 5)], "cat string, gold string, pred string, n long")
    got = {r.cat: (r.guess, round(r.f1, 6)) for r in ev.category_max_f1(cells, ["0"], "cat").collect()}
    best = max(2 * sum(k for c, (k, _) in zip("abc", [(9, 10), (1, 10), (5, 10)]) if c in s) / (sum(10 for c in s) + 15) for s in ("a", "b", "c", "ab", "ac", "bc", "abc"))
    assert {c: g for c, (g, _) in got.items()} == {"a": "1", "b": "0", "c": "1"} and got["a"][1] == round(best, 6)


def stats(spark, rows):
    return spark.createDataFrame([("x", i, [float(c), 10.0]) for i, c in enumerate(rows)], "corpus string, sent_id long, ss array<double>")


def test_significance(spark):
    better, worse = stats(spark, [9] * 40), stats(spark, [5] * 40)
    assert sg.paired_permutation(better, worse, 500) < 0.01 and sg.paired_permutation_mean(better, worse, 500) < 0.01 and sg.paired_bootstrap(better, worse, 500) < 0.05
    mixed, other = stats(spark, [5, 6] * 20), stats(spark, [6, 5] * 19 + [6, 6])
    assert sg.paired_permutation(mixed, other, 500) > 0.3
    with pytest.raises(ValueError, match="equally"):
        sg.paired_permutation(better, better, 10)


def test_information_gain(spark):
    f = spark.createDataFrame([(i, "t", str(i % 2)) for i in range(8)] + [(i, "u", "x") for i in range(8)], "ex long, template string, feature string")
    v = spark.createDataFrame([(i, str(i % 2)) for i in range(8)], "ex long, value string")
    got = {r.template: round(r.ig, 9) for r in ag.information_gain(f, v, ["ex"]).collect()}
    assert got == {"t": 1.0, "u": 0.0}


def test_tokens_of_sentences(spark):
    df = spark.createDataFrame([("x", 1, ["a", "b"], None)], "corpus string, sent_id long, words array<string>, pos array<string>")
    assert [(r.tok, r.word, r.pos) for r in tokens(df).orderBy("tok").collect()] == [(0, "a", None), (1, "b", None)]
