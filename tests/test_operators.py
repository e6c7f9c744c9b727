"""Joins, pairs, pruning, trees, features, learning and streaming on small cases."""

import pytest
from pyspark.sql import functions as F

from corpuscraft.functions import lexical as lx
from corpuscraft.functions import trees
from corpuscraft.operators import constituents as cn
from corpuscraft.operators import features as ft
from corpuscraft.operators import joins as jn
from corpuscraft.operators import learning as ln
from corpuscraft.operators import pairs as pr
from corpuscraft.operators import tables as tb
from corpuscraft.operators import windows as wn
from corpuscraft.streaming.annotate import annotate_stream, cluster_step, stream_hit_rate, write_stream


def value(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, list)) else F.lit(v))
    return df.select(column.alias("x")).first().x


def toks(spark, tags, parents=None, sent=0):
    rows = [("x", sent, t, f"w{t}", p, (parents or [-1] * 99)[t]) for t, p in enumerate(tags.split())]
    return spark.createDataFrame(rows, "corpus string, sent_id long, tok int, word string, pos string, parent int")


def test_lexical_functions(spark):
    assert value(spark, lx.escape_word("w"), w="a-b.c") == "a_b_c" and value(spark, lx.clean("w"), w="Abc-12.3") == "abc_0_0"
    assert [value(spark, lx.is_punct("w"), w=w) for w in (".", "--", "،", "$", "a.", "«")] == [True, True, True, False, False, True]
    assert value(spark, lx.is_capitalized("w"), w="") and value(spark, lx.is_capitalized("w"), w="Éa") and not value(spark, lx.is_capitalized("w"), w="aB")
    assert value(spark, lx.normalize_role("w"), w="A1-AM") == "a1" and value(spark, lx.normalize_role("w"), w="_") == "_"
    assert value(spark, lx.sense_suffix("w"), w="like.v.01") == "01" and value(spark, lx.sense_suffix("w"), w="like") == "like"
    assert value(spark, lx.build_label(F.lit("ART"), F.lit("OWN"), F.lit("Arg-1"), F.lit("Arg-2"))) == "ART-OWN(Arg-1,Arg-2)"
    assert tuple(value(spark, lx.parse_label("w"), w="SEE(a,b)")) == ("SEE", None, "a", "b") and value(spark, lx.parse_label("w"), w="none") is None
    assert value(spark, lx.is_norel("w"), w="Other") and not value(spark, lx.is_norel(F.lit(None).cast("string")))
    assert [value(spark, lx.bin_int("w"), w=w) for w in (0, 1, 2, 7, -12, 99)] == [0, 0, 2, 5, -(2**31), 40]
    assert value(spark, lx.morpho6(F.array(F.lit("a")))) == ["a"] + ["NO_MORPH"] * 5
    assert value(spark, lx.ngrams(F.array(*map(F.lit, "abc")), 2)) == ["BOS_a", "a_b", "b_c"] and value(spark, lx.ngrams(F.array().cast("array<string>"), 3)) == []
    assert value(spark, lx.no_dup(F.array(*map(F.lit, "aabba")))) == ["a", "b", "a"]
    assert value(spark, lx.scale_vec(F.array(F.lit(3.0), F.lit(4.0)), "l2")) == [0.6, 0.8]
    assert tuple(value(spark, lx.span_between(lx.span(0, 2), lx.span(4, 5)))) == (2, 4) and tuple(value(spark, lx.span_between(lx.span(4, 6), lx.span(1, 5)))) == (4, 4)
    assert value(spark, lx.has_verb(F.array(F.lit("MD"), F.lit("VB")))) and not value(spark, lx.has_verb(F.array(F.lit("VB"))))


def test_tags_and_labels(spark):
    each = lambda f, *xs: [value(spark, f("w"), w=x) for x in xs]
    assert each(lx.strict_pos, "OTHER-VV", "VV", "NN", "PUNC", "Conj", "OTHER2-NN", "MD", ".", "PRP", "v") == ["OTHER", "VERB", "NOUN", "PUNC", "CONJ", "OTHER", "OTHER", "OTHER", "OTHER", "VERB"]
    coarse = lambda c: lx.strict_pos(F.lit(None).cast("string"), c)
    assert each(coarse, "VV-other", "VERB", "NOUN", ".", "CONJ", "NN-OTHER2") == ["OTHER", "VERB", "NOUN", "PUNC", "CONJ", "OTHER"]
    assert value(spark, lx.strict_pos(F.lit(None).cast("string"))) == "OTHER"
    assert each(lx.ptb45_to_17, "NN", "VBG", "-LRB-", "``", "CD", "WDT", "no tag") == ["N", "VBG", "LPUNC", "LPUNC", "ADJ", "W", None]
    assert [value(spark, lx.is_noun("w", lang), w=w) for lang, w in (("en", "NNS"), ("en", "nn"), ("es", "n"), ("es", "nc"), ("cs", "N"), ("cs", "NN"), ("de", "NE"))] == [True, False, True, False, True, False, True]
    assert [value(spark, lx.is_verb("w", lang), w=w) for lang, w in (("zh", "VV"), ("ca", "v"), ("cs", "Vf"))] == [True, True, False]
    kinds = ("auxiliary", "main", "common", "qualificative", "semiauxiliary", "other")
    senses = [value(spark, lx.default_sense("w", F.array(F.lit("gen=m"), F.lit(f"postype={k}")), "es"), w="ser") for k in kinds]
    assert senses == ["ser.c2", "ser.a2", "ser.a2", "ser.b2", "ser.c2", "ser.a2"]
    assert [value(spark, lx.default_sense("w", lang=lang), w="be") for lang in ("en", "de", "zh")] == ["be.01", "be.1", "be.01"]
    for wrong in (lambda: lx.is_noun("w", "xx"), lambda: lx.is_verb("w", "xx"), lambda: lx.default_sense("w", lang="xx")):
        with pytest.raises(ValueError, match="language"):
            wrong()
    assert each(lx.is_asymmetric, "ART", "GEN-AFF", "ORG-AFF", "PART-WHOLE", "PHYS", "GEN", "PER-SOC") == [True] * 4 + [False] * 3
    with pytest.raises(Exception, match="DISC"):
        each(lx.is_asymmetric, "DISC")
    assert each(lx.escape_word, "Señor", "a-b", "Ünß") == ["Señor", "a_b", "Ün_"]
    assert [value(spark, lx.affix("w", 3, side), w=w) for side in ("prefix", "suffix") for w in ("of", "often")] == ["of", "oft", "of", "ten"]
    assert value(spark, lx.morpho_str(F.array(F.lit("a"), F.lit("b")))) == "a_b" and value(spark, lx.morpho_str(F.array().cast("array<string>"))) == "NO_MORPH"
    none = F.lit(None).cast("string")
    assert value(spark, lx.entity_type_or(none, F.lit("0101101101"))) == "010110" and value(spark, lx.entity_type_or(none, F.lit("0101101101"), lx.SUBTYPE_BITS)) == "01011011" and value(spark, lx.entity_type_or(none)) == "NOTYPE"
    assert [value(spark, lx.sprl_label("w"), w=x) for x in (3.9, 4.0)] == ["UNLIKELY", "LIKELY"] and value(spark, lx.sprl_value("w"), w="LIKELY") == 5.0


#  0 <- 1 <- wall; 1 -> 3 -> 2, 3 -> 4
@pytest.fixture
def tree(spark):
    return F.array(*map(F.lit, (1, -1, 3, 1, 3)))


def test_trees(spark, tree):
    assert value(spark, trees.children(tree, F.lit(3))) == [2, 4] and value(spark, trees.root_path(tree, F.lit(4))) == [4, 3, 1]
    assert [tuple(s) for s in value(spark, trees.dep_path(tree, F.lit(0), F.lit(2)))] == [(0, "UP"), (1, "DOWN"), (3, "DOWN"), (2, "DOWN")]
    assert value(spark, trees.dep_path(F.array(F.lit(-1), F.lit(-1)), F.lit(0), F.lit(1))) is None
    kin = lambda a, b: value(spark, trees.genealogy(tree, F.lit(a), F.lit(b)))
    assert [kin(1, 1), kin(1, 0), kin(0, 1), kin(2, 4), kin(1, 4), kin(4, 1), kin(0, 4)] == ["SELF", "PARENT", "CHILD", "SIBLING", "ANCESTOR", "DESCENDENT", "COUSIN"]
    assert value(spark, trees.lca(tree, F.lit(2), F.lit(0))) == 1 and value(spark, trees.between(F.lit(3), F.lit(0))) == [2, 1]
    assert value(spark, trees.is_projective(tree)) and not value(spark, trees.is_projective(F.array(*map(F.lit, (2, 3, -1, 2)))))
    assert value(spark, trees.span_head(tree, F.lit(2), F.lit(5))) == 3
    assert value(spark, trees.root_path(F.array(F.lit(1), F.lit(0)), F.lit(0)))[:2] == [0, 1]  # a cycle ends
    flags = F.array(*map(F.lit, (False, True, True, True, False)))
    assert [value(spark, trees.support_token(tree, flags, F.lit(i), w)) for i in (2, 4) for w in ("low", "high")] == [2, 1, 3, 1]
    assert value(spark, trees.support_token(tree, F.array_repeat(F.lit(False), 5), F.lit(2))) == -1
    assert [[s.tok for s in value(spark, trees.path_part(tree, F.lit(2), F.lit(0), w))] for w in ("p_lca", "c_lca", "lca_root")] == [[2, 3, 1], [0, 1], [1, -1]]
    assert value(spark, trees.crossing_arcs(tree)) == [] and value(spark, trees.crossing_arcs(F.array(*map(F.lit, (2, 3, -1, 2))))) == [0, 1, 2]


def test_distance_pruner(spark):
    train, to = toks(spark, "N N V D N P N", [1, 2, -1, 4, 2, 2, 5]), toks(spark, "N V P D P P N", None, 1)
    kept = {(r.p, r.c): r.kept for r in pr.distance_prune(to, pr.fit_distance_pruner(train)).collect()}
    assert not any(kept[x] for x in ((0, 1), (1, 6), (1, 5)) if x != (0, 1)) and all(kept[x] for x in ((1, 0), (1, 2), (1, 4), (5, 6)))
    free = {(r.p, r.c): r.kept for r in pr.distance_prune(to, pr.fit_distance_pruner(train), keep_right_branching=False).collect()}
    assert not free[(0, 1)]


def mask(spark, kept, n):
    rows = [("x", 0, p, c, (p, c) in kept) for p in range(-1, n) for c in range(n) if p != c]
    return spark.createDataFrame(rows, "corpus string, sent_id long, p int, c int, kept boolean")


@pytest.mark.parametrize(("kept", "multi", "single"), [({(-1, 0), (0, 1), (1, 2)}, True, True), ({(-1, 0), (-1, 2), (0, 1)}, True, False), ({(-1, 0), (1, 2), (2, 1)}, False, False)])
def test_reachability(spark, kept, multi, single):
    lengths = spark.createDataFrame([("x", 0, 3)], "corpus string, sent_id long, n int")
    r = jn.reachable(mask(spark, kept, 3), lengths).first()
    assert (r.multi_root, r.single_root) == (multi, single)


def test_masks_and_scores(spark):
    a, b = mask(spark, {(0, 1), (-1, 0)}, 2), mask(spark, {(0, 1)}, 2)
    assert pr.mask_totals(jn.mask_and(a, b)).first().n_kept == 1 and pr.mask_totals(jn.mask_or(a, b)).first().n_kept == 2
    assert pr.mask_totals(jn.mask_and(a, a)).first() == pr.mask_totals(a).first()
    assert pr.mask_totals(jn.keep_gold(b, toks(spark, "A B", [-1, 0]))).first().n_kept == 2
    s = spark.createDataFrame([("x", 0, p, 1, x) for p, x in ((-1, 0.1), (0, 0.9), (2, 0.8))], "corpus string, sent_id long, p int, c int, score double")
    assert [r.kept for r in wn.topk_heads(s, 2).orderBy("p").collect()] == [False, True, True] and [r.kept for r in wn.max_marginal_prune(s, 0.5).orderBy("p").collect()] == [False, True, True]


MENTIONS = [("a", 0, 1, 0, "MAMMAL"), ("b", 2, 6, 3, "MAMMAL"), ("c", 5, 6, 5, "LOCATION")]
MSCHEMA = "corpus string, sent_id long, m_id string, start int, end int, head int, type string"


def relations(spark, *rels):
    return spark.createDataFrame([("x", 0, i, *r) for i, r in enumerate(rels)], "corpus string, sent_id long, rel_id int, type string, subtype string, args array<struct<role: string, m_id: string>>")


def test_pairs_and_labels(spark):
    m = spark.createDataFrame([("x", 0, *r) for r in MENTIONS], MSCHEMA)
    rels = relations(spark, ("ART", "SUBART", [("Arg-2", "b"), ("Arg-1", "a")]), ("PER-SOC", None, [("Arg-2", "b"), ("Arg-1", "c")]))
    got = {(r.m1, r.m2): r.label for r in pr.add_pairs_and_labels(m, rels).collect()}
    assert got == {("a", "b"): "ART-SUBART(Arg-1,Arg-2)", ("a", "c"): "NO_RELATION", ("b", "c"): "PER-SOC(Arg-1,Arg-1)"}
    assert {(r.m1, r.m2) for r in jn.ne_pairs(m, None, 0).collect()} == {("a", "b"), ("b", "c")}
    assert {(r.m1, r.m2): r.n_between for r in jn.n_mentions_between(jn.ne_pairs(m), m).collect()} == {("a", "b"): 0, ("b", "c"): 0, ("a", "c"): 1}
    back = pr.pairs_to_relations(pr.add_pairs_and_labels(m, rels)).collect()
    assert {(r.type, r.subtype, tuple(a.m_id for a in r.args)) for r in back} == {("ART", "SUBART", ("a", "b")), ("PER", "SOC", ("b", "c"))}
    assert jn.n_overlapping(m).first().n_overlapping == 1
    assert [r.end for r in pr.shorten_mentions(m).orderBy("m_id").collect()] == [1, 4, 6]


def test_pairs_keep_what_relations_say(spark):
    """A relation that repeats, one in the other order, and one of a mention with itself; then the rest."""
    m = spark.createDataFrame([("x", 0, *r) for r in MENTIONS], MSCHEMA)
    rels = relations(spark, ("ART", "S", [("Arg-2", "c"), ("Arg-1", "b")]), ("PHYS", "S", [("Arg-1", "a"), ("Arg-2", "b")]), ("PHYS", None, [("Arg-2", "b"), ("Arg-1", "a")]), ("GEN", None, [("Arg-1", "a"), ("Arg-2", "a")]))
    got = [(r.m1, r.m2, r.label) for r in pr.add_pairs_and_labels(m, rels).orderBy("k").collect()]
    assert got == [("b", "c", "ART-S(Arg-1,Arg-2)"), ("a", "b", "PHYS-S(Arg-1,Arg-1)"), ("a", "b", "PHYS-S(Arg-1,Arg-1)"), ("a", "a", "GEN(Arg-1,Arg-1)"), ("a", "c", "NO_RELATION")]
    assert [(r.m1, r.m2) for r in jn.ne_pairs(m).orderBy("k").collect()] == [("a", "b"), ("a", "c"), ("b", "c")]


def test_best_heads(spark):
    scores = F.array(F.lit(0.1), F.lit(None), F.lit(0.9), F.lit(0.8), F.lit(0.9), F.lit(0.8))
    assert [sorted(value(spark, pr.best_heads(scores, k))) for k in (1, 2, 3, 9)] == [[1], [1, 3], [1, 2, 3], [-1, 1, 2, 3, 4]]
    assert sorted(value(spark, pr.best_heads(scores, 9, 0.85))) == [1, 2, 3, 4] and value(spark, pr.best_heads(F.array(F.lit(None).cast("double")), 2)) == []


def test_a_raising_annotator_leaves_its_sentence_alone(spark):
    first = ln.tolerant(lambda words: words[0], "string")
    df = spark.createDataFrame([(1, ["a"]), (2, []), (3, ["b"])], "id int, words array<string>")
    assert [r.x for r in df.select("id", first("words").alias("x")).orderBy("id").collect()] == ["a", None, "b"]


def test_lookups(spark):
    t = spark.createDataFrame([("x", 0, i, w) for i, w in enumerate(("Dog", "in_casa", "77", "zz"))], "corpus string, sent_id long, tok int, word string")
    c = spark.createDataFrame([("casa", "01"), ("Dog", "11")], "word string, cluster string")
    assert [r.cluster for r in jn.cluster_lookup(t, c, "es").orderBy("tok").collect()] == ["11", "SW01", "UNK", "UNK"]
    v = spark.createDataFrame([("dog", 5), ("##", 6)], "word string, id int")
    assert [r.embed_id for r in jn.embed_lookup(t, v).orderBy("tok").collect()] == [5, -1, 6, -1]
    m = spark.createDataFrame([("x", 0, "a", 0, 1, 0, "T")], MSCHEMA)
    assert [r.entity_word for r in jn.entity_words(t, m).orderBy("tok").collect()] == ["Dog-ne", "in_casa", "77", "zz"]
    assert [r.word for r in jn.replace_oov(t, "word", v.union(c.selectExpr("word", "1"))).orderBy("tok").collect()] == ["Dog", "UNK", "UNK", "UNK"]


def test_role_pairs(spark):
    t = toks(spark, "N V N")
    preds = spark.createDataFrame([("x", 0, 1)], "corpus string, sent_id long, pred int")
    at = lambda df: {(r.p, r.c) for r in df.collect()}
    assert at(jn.role_pairs(t, "PREDS_GIVEN", preds)) == {(1, 0), (1, 1), (1, 2)} and at(jn.role_pairs(t, "PREDS_GIVEN", preds, self_loops=False)) == {(1, 0), (1, 2)}
    skip = spark.createDataFrame([("x", 0, 0, 1)], "corpus string, sent_id long, p int, c int")
    assert len(at(jn.role_pairs(t, "ALL_PAIRS", skip=skip))) == 8 and at(jn.role_pairs(t, "NO_ROLES")) == set()


def sentence(spark):
    rows = [("x", 0, "the dog ate the fish".split(), "DT NN VBD DT NN".split(), [1, 2, -1, 4, 2], "det sbj root det obj".split())]
    return spark.createDataFrame(rows, "corpus string, sent_id long, words array<string>, pos array<string>, parents array<int>, deprels array<string>")


def test_templates(spark):
    ex = ft.examples(sentence(spark), spark.createDataFrame([("x", 0, 1, 4)], "corpus string, sent_id long, p int, c int"))
    specs = ["word(p)", "pos(head(c)) + word(before2(c))", "seq(pos(path))", "2gram(pos(between))", "bag(word(line))", "word(after2(c))", "GENEALOGY", "chsuf2(c)", "seq(word(children(c)))", "pos(low_verb(p))", "deprel(lns(c))", "RELATIVE + DISTANCE  # a comment", "EDGE + DIRECTION_EDGE", "seq(word(path_lca_root))", "seq(word(path_p_lca))", "", "# none"]
    got = {}
    for r in ft.extract(ex, ft.parse_spec(specs)).collect():
        got.setdefault(r.template, []).append(r.feature)
    assert got == {
        "word(p)": ["dog"], "pos(head(c))+word(before2(c))": ["VBD_ate"], "seq(pos(path))": ["NN_VBD_NN"], "2gram(pos(between))": ["BOS_VBD", "VBD_DT"], "bag(word(line))": ["ate_dog_fish_the"], "word(after2(c))": ["EOS"],
        "GENEALOGY": ["SIBLING"], "chsuf2(c)": ["sh"], "seq(word(children(c)))": ["the"], "pos(low_verb(p))": ["VBD"], "deprel(lns(c))": ["sbj"], "RELATIVE+DISTANCE": ["BEFORE_3"], "EDGE+DIRECTION_EDGE": ["F_F"], "seq(word(path_lca_root))": ["ate_BOS"], "seq(word(path_p_lca))": ["dog_ate"],
    }
    assert ft.extract(ex, ft.parse_spec(["word(p)"]), mod=7).first().feature in range(7)
    assert ft.extract(ex, ft.template_set("arc")).count()
    assert [t.name() for t in ft.filter_templates(ft.template_set("role"), {"words"})] == ["word(p)", "word(c)", "bag(word(between))", "RELATIVE", "DISTANCE"]
    assert len(ft.all_bigrams(ft.parse_spec(["word(p)", "pos(p)", "pos(c)"]))) == 3 and len(ft.union_templates(ft.tag_set(), ft.tag_set())) == len(ft.tag_set())
    grams = [r.feature for r in ft.extract(ex, [ft.Pair("path_grams")]).collect()]
    assert "dog_VBD_fish" in grams and len(grams) == 3 * 2 + 2 * 4 + 8


def test_examples_of_other_keys(spark):
    keys = spark.createDataFrame([("x", 0, 1, 4, 2, 0, 1, 2, "S", "NP", None)], "corpus string, sent_id long, p int, c int, m int, ri int, rj int, rk int, rule_parent string, rule_left string, rule_right string")
    ex = ft.examples(sentence(spark), keys)
    rows = ft.extract(ex, ft.parse_spec(["word(m)", "pos(after1(rk))", "seq(word(rule))", "rule_parent + rule_left", "rule_right", "RULE_IS_UNARY"]))
    assert {r.template: r.feature for r in rows.collect()} == {"word(m)": "ate", "pos(after1(rk))": "DT", "seq(word(rule))": "the_dog_ate", "rule_parent+rule_left": "S_NP", "RULE_IS_UNARY": "T"}
    assert {"p", "c", "m", "ri", "rj", "rk"} <= set(rows.columns)


def test_word_and_triple_features(spark):
    s = sentence(spark)
    pairs = spark.createDataFrame([("x", 0, 1, 4)], "corpus string, sent_id long, p int, c int")
    clusters = s.withColumn("clusters", F.transform("words", lambda w: F.lit("01011011")))
    got = {(r.tok, r.feature) for r in ft.role_word_features(clusters, pairs, "head_type_between").collect()}
    assert (1, "head1") in got and (4, "head2-010110_010110") in got and (2, "on_path") in got and (3, "between") in got
    t = spark.createDataFrame([("x", 0, -1, 2, 1)], "corpus string, sent_id long, g int, p int, c int")
    assert ft.triple_features(t, s, ("g", "p", "c"), 100).count() == 7
    m = spark.createDataFrame([("x", 0, "a", 0, 2, 1, "ANI"), ("x", 0, "b", 3, 5, 4, None)], MSCHEMA)
    f = {r.template: r.feature for r in ft.relation_features(s, jn.ne_pairs(m), m).collect()}
    assert f["heads"] == "dog_fish" and f["between"] == "ate" and f["types"] == "ANI_NOTYPE" and f["path_words"] == "dog_ate_fish" and f["overlap"] == "NONE"


def test_constituents(spark):
    rows = [(0, None, "S", 0), (1, 0, "NP", 0), (2, 0, "VP", 1), (3, 1, "DT", 0), (4, 1, "NN", 1), (5, 2, "VBD", 0)]
    nodes = spark.createDataFrame([("x", 0, n, p, s, 0, 0, k) for n, p, s, k in rows], "corpus string, sent_id long, node int, parent int, symbol string, start int, end int, child_no int")
    pairs = spark.createDataFrame([("x", 0, 4, 5), ("x", 0, 3, 4)], "corpus string, sent_id long, a int, b int")
    assert [r.path for r in cn.constituent_path(nodes, pairs).orderBy("a").collect()] == ["DT^NP!NN", "NN^NP^S!VP!VBD"]
    assert [r.same for r in cn.same_phrase(nodes, pairs, "NP").orderBy("a").collect()] == [True, False]
    rules = {r.node: (r.parent_symbol, r.left, r.right, r.unary) for r in cn.rule_features(nodes).collect()}
    assert rules == {0: ("S", "NP", "VP", False), 1: ("NP", "DT", "NN", False), 2: ("VP", "VBD", None, True)}


def test_jackknife(spark):
    rows = [("x", i, "w", t) for i, t in enumerate("BRRGGB")]
    df = spark.createDataFrame(rows, "corpus string, sent_id long, word string, pos string")
    got = [r.pred for r in pr.jackknife(df, 3, ln.majority_tagger(), "sent_id").orderBy("sent_id").collect()]
    assert got == list("GGBBRR")
    marked = wn.folds(df, 3, "sent_id")
    assert [r.pred for r in pr.jackknife_majority(marked, 3).orderBy("sent_id").collect()] == list("GGBBRR")


def test_learning(spark, tmp_path):
    rows = [(i, "w", f"f{i % 2}") for i in range(40)]
    x = ln.vectors(spark.createDataFrame(rows, "id long, template string, feature string"), ["id"], 16)
    labels = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(40)], "id long, label string")
    model = ln.fit_classifier(x, labels, ["id"])
    ln.save(model, str(tmp_path / "m"))
    got = {r.id: r.tag for r in ln.annotate(ln.load(str(tmp_path / "m")), x, ["id"], "tag").collect()}
    assert all(t == ("odd" if i % 2 else "even") for i, t in got.items()) and ln.describe(spark, model, 2).count() > 0


def test_pipelines(spark):
    df = toks(spark, "N V")
    add = ln.Annotator("prefix", lambda d: d.withColumn("prefix", lx.prefix5("word")), ["word"], ["prefix"])
    passing = ln.Trainable("only in training", lambda data, gold: ln.Annotator("none", lambda d: d), transient=True)
    fitted, data = ln.AnnoPipeline([add, passing]).train(df, df)
    assert len(fitted.stages) == 1 and "prefix" in data.columns and fitted.annotate(df).columns == data.columns
    with pytest.raises(ValueError, match="needs"):
        add.annotate(df.drop("word"))


def test_splits_and_layers(spark):
    df = spark.createDataFrame([("x", i, ["a"], ["N"]) for i in range(10)], "corpus string, sent_id long, words array<string>, pos array<string>")
    s = pr.splits(df, predicted=("pos",), dev_prop=0.3)
    assert s["train"]["gold"].count() == 7 and s["dev"]["input"].columns == ["corpus", "sent_id", "words"] and s["test"]["gold"] is None
    assert tb.sentences(tb.tokens(df)).count() == 10
    copied = tb.copy_layer(df, s["dev"]["input"], "pos")
    assert copied.where("pos is not null").count() == 3


def test_properties_and_span_labels(spark):
    schema = "corpus string, sent_id long, pred int, arg int, property string, label string, seq int"
    p = spark.createDataFrame([("x", 0, 1, 2, "v", "likely", 0), ("x", 0, 1, 2, "v", "unlikely", 1)], schema)
    r = tb.set_props(p, "seq").first()
    assert (r.label, r.overwritten) == ("unlikely", 1)
    with pytest.raises(Exception, match="nil pair"):
        tb.set_props(p.union(spark.createDataFrame([("x", 0, 1, 2, "w", "NOT_AN_ARG", 2)], schema)), "seq").collect()
    labels = spark.createDataFrame([("x", 0, 0, 1, "A"), ("x", 0, 1, 2, "B")], "corpus string, sent_id long, start int, end int, label string")
    new = spark.createDataFrame([("x", 0, 0, 1, None), ("x", 0, 1, 2, "C")], labels.schema)
    assert [(r.start, r.label) for r in tb.set_span_labels(labels, new).collect()] == [(1, "C")]


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:30:00", w) for h, w in ((1, "a"), (1, "b"), (2, "a"), (5, "a"))], "t string, word string").selectExpr("cast(t as timestamp) ts", "word")
    rows.write.parquet(str(tmp_path / "in"))
    clusters = spark.createDataFrame([("a", "01")], "word string, cluster string")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    done = annotate_stream(stream, [cluster_step(clusters), lambda d: d.withColumn("prefix", lx.prefix5("word"))])
    write_stream(done, str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination()
    assert {(r.word, r.cluster) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "01"), ("b", "UNK")}
    rates = stream_hit_rate(done)
    q = rates.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.hit_rate) for r in spark.table("rates").collect()) == [(1, 1.0), (1, 1.0), (2, 0.5)]


LONG = 150


@pytest.fixture(scope="module")
def long_sentence(tmp_path_factory):
    """Tables with one sentence of LONG tokens, beyond the lengths that queries used to read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    home = tmp_path_factory.mktemp("long")
    text = " ".join(("Ann", "of", "seven", "walked")[i % 4] for i in range(LONG))
    pq.write_table(pa.table({"doc_id": pa.array([2], pa.int64()), "text": [text], "lang": ["en"]}), f"{home}/documents.parquet")
    return str(home)


def test_queries_read_long_sentences(spark, long_sentence):
    from corpuscraft.plans.queries import QUERIES, _toks

    run = lambda name: QUERIES[name](spark, long_sentence)
    parents = {r.tok: r.parent for r in _toks(spark, long_sentence).collect()}
    assert len(parents) == LONG

    def climb(i):
        return [] if i < 0 else [i, *climb(parents[i])]

    assert {r.tok: r.path for r in run("root_path").collect()} == {i: " ".join(map(str, climb(i))) for i in parents}
    spans = [sorted((i, p)) for i, p in parents.items()]
    assert run("projective").first().projective == (not any(a < c < b < d for a, b in spans for c, d in spans))
    pairs = {(i, i + k) for i in parents for k in (1, 2, 7) if i + k < LONG} | {x for i, p in parents.items() if p >= 0 for x in ((i, p), (p, i))}
    assert sum(r.cnt for r in run("dep_path").where("template = 'seq(pos&dir(path))'").collect()) == len(pairs) == sum(r.cnt for r in run("genealogy").collect())
    assert sum(r.cnt for r in run("arc_features").where("template like 'pos(p)%'").collect()) == LONG - 1
    assert sum(r.cnt for r in run("role_pairs").collect()) == sum(i % 4 == 2 for i in range(LONG)) * (LONG - 1)
    total = run("distance_prune").first()
    assert (total.n_total, total.n_gold, total.n_sents) == (LONG * LONG - LONG, LONG, 1)
    both = run("mask_ops").first()
    assert both.and_kept + both.and_pruned == both.or_kept + both.or_pruned == LONG * LONG
    top = run("topk_heads").first()
    assert top.n_kept + top.n_pruned == LONG * LONG
    assert run("mask_counts").first().n_kept == 3 * LONG
    assert tuple(run("reachable").first())[1:] == (True, True)


def test_walks_of_cyclic_and_crossing_trees(spark):
    rows = [([1, 0, 1],), ([-1, 0, 1],), ([2, 3, -1, 2],), ([-1, 3, 0, 0],), ([1, 2, 0, 5, -2, 4],), ([],)]
    df = spark.createDataFrame(rows, "parents array<int>")
    for r in df.select("parents", trees.root_paths("parents").alias("ps"), *(trees.root_path("parents", F.lit(i)).alias(f"p{i}") for i in range(6)), trees.is_projective("parents").alias("ok")).collect():
        assert r.ps == [r[f"p{i}"] for i in range(len(r.parents))]
        spans = [sorted((i, p)) for i, p in enumerate(r.parents)]
        assert r.ok == (not any(a < c < b < d for a, b in spans for c, d in spans))


def test_pairs_of_far_mentions(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from corpuscraft.plans.queries import QUERIES

    m = spark.createDataFrame([("x", s, f"m{i}", 2 * i, 2 * i + 1, 2 * i, "PER", None) for s, n in ((0, 7), (1, 1)) for i in range(n)], "corpus string, sent_id long, m_id string, start int, end int, head int, type string, subtype string")
    assert {(r.m1, r.m2) for r in jn.ne_pairs(m).collect()} == {(f"m{i}", f"m{j}") for j in range(7) for i in range(j)}
    assert {(r.m1, r.m2) for r in jn.ne_pairs(m, None, 2).collect()} == {(f"m{i}", f"m{j}") for j in range(7) for i in range(j) if j - i <= 3}
    assert pr.add_pairs_and_labels(m, relations(spark)).count() == 21
    pq.write_table(pa.table({"doc_id": pa.array([2], pa.int64()), "text": [" ".join(["Ann of"] * 7)], "lang": ["en"]}), f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert len(run("ne_pairs")) == sum(r.cnt for r in run("relation_labels")) == run("rel_f1")[0].n_total == 21


def test_pruner_is_fitted_on_all_sentences(spark, long_sentence):
    """The only document has an id that a third of the ids doesn't hold, so its tags would all be unknown."""
    from corpuscraft.plans.queries import QUERIES

    r = QUERIES["distance_prune"](spark, long_sentence).first()
    assert r.n_pruned > 0 and r.n_gold_kept == r.n_gold == LONG
