"""The index of trees against plain walks, and templates built on it."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscraft.functions import lexical as lx
from corpuscraft.functions import tree_index, trees
from corpuscraft.operators import features as ft

NO_HEAD = -2


def up(parents, i):
    way = []
    while 0 <= i < len(parents) and len(way) <= len(parents):
        way.append(i)
        i = parents[i] if parents[i] is not None else -1
    return way if len(way) <= len(parents) else None


def path(parents, a, b):
    """(tokens, how many steps go up, from the lowest common token to the root)."""
    x, y = up(parents, a), up(parents, b)
    common = [t for t in x or [] if t in (y or [])]
    if not common:
        return None
    own, other = x[: x.index(common[0])], y[: y.index(common[0])]
    return own + [common[0]] + other[::-1], len(own), common


def random_trees(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size = rng.randrange(1, 14)
        kind = rng.random()
        if kind < 0.6:  # a tree, its tokens in any order
            order = rng.sample(range(size), size)
            parents = [-1] * size
            for k, i in enumerate(order[1:], 1):
                parents[i] = rng.choice(order[:k])
        else:  # anything, cycles and what is no head included
            parents = [rng.choice([-1, NO_HEAD, None, *range(size + 1)]) for _ in range(size)]
        out.append(parents)
    return [*out, [], [0], [-1], [i - 1 for i in range(300)]]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [(i, p, [(a, b) for a in range(-1, min(len(p), 12) + 1) for b in range(-1, min(len(p), 12) + 1)]) for i, p in enumerate(random_trees(1, 400))]
    return rows, spark.createDataFrame(rows, "id int, parents array<int>, pairs array<struct<a: int, b: int>>").repartition(3)


def test_paths_of_all_pairs(sample):
    rows, df = sample
    got = {r.id: r.ways for r in df.select("id", tree_index.paths("parents", F.col("pairs"), True).alias("ways")).collect()}
    for i, parents, pairs in rows:
        assert len(got[i]) == len(pairs)
        for (a, b), way in zip(pairs, got[i]):
            want = path(parents, a, b)
            assert (way.toks and (way.toks, way.top, way.above)) == want, (parents, a, b)


def test_neighbours_children_supports_and_crossing_arcs(sample):
    rows, df = sample
    df = df.select("id", tree_index.near("parents").alias("near"), tree_index.children_of_all("parents").alias("kids"), tree_index.supports("parents", F.transform("parents", lambda p, i: i % 3 == 1)).alias("sup"), trees.crossing_arcs("parents").alias("cross"), trees.is_projective("parents").alias("nested"))
    got = {r.id: r for r in df.collect()}
    for i, parents, _ in rows:
        r, n = got[i], len(parents)
        for t in range(n):
            kids = [k for k in range(n) if parents[k] == t]
            left, right = [k for k in kids if k < t], [k for k in kids if k > t]
            same = [k for k in range(n) if parents[k] == parents[t] and parents[t] is not None]
            want = {"lmc": min(left, default=-2), "lnc": max(left, default=-2), "rnc": min(right, default=-2), "rmc": max(right, default=-2), "lns": max((k for k in same if k < t), default=-1), "rns": min((k for k in same if k > t), default=n)}
            assert {k: r.near[k][t] for k in want} == want and r.kids[t] == kids
            if up(parents, t) is not None:
                flagged = [k for k in up(parents, t) if k % 3 == 1]
                assert (r.sup.low[t], r.sup.high[t]) == ((flagged[0], flagged[-1]) if flagged else (-1, -1))
        arcs = [(min(h, k), max(h, k), k) for k, h in enumerate(parents) if h is not None and h >= -1]
        crossing = [k for a, b, k in arcs if any(a < x < b < y or x < a < y < b for x, y, _ in arcs)]
        spans = [(min(h, k), max(h, k)) for k, h in enumerate(parents) if h is not None]  # what is no head lies left of the wall here
        assert r.cross == crossing and r.nested == (not any(a < x < b < y for a, b in spans for x, y in spans))


def test_path_functions_of_one_pair(spark):
    df = spark.createDataFrame([([1, 2, -1, 4, 2, -1], 0, 3), ([1, 2, -1, 4, 2, -1], 0, 5)], "parents array<int>, a int, b int")
    one, none = df.select(trees.lca("parents", "a", "b").alias("lca"), trees.dep_path("parents", "a", "b").alias("path"), trees.path_to_lca("parents", "a", "b").alias("parts"), trees.genealogy("parents", "a", "b").alias("kin"), trees.path_part("parents", "a", "b", "lca_root").alias("root")).collect()
    assert one.lca == 2 and [tuple(s) for s in one.path] == [(0, "UP"), (1, "UP"), (2, "DOWN"), (4, "DOWN"), (3, "DOWN")]
    assert (one.parts.own, one.parts.other, one.parts.shared) == ([0, 1, 2], [3, 4, 2], [2]) and one.kin == "COUSIN" and [s.tok for s in one.root] == [2, -1]
    assert none.lca is None and none.path is None and none.kin == "COUSIN" and none.root is None


def test_list_functions_stay_linear(spark):
    items = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.concat(F.lit("w"), i % 7)).alias("x"))
    row = items.select(F.size(lx.ngrams("x", 3)).alias("n"), F.get(lx.ngrams("x", 2), F.lit(0)).alias("first"), F.size(lx.no_dup(F.transform("x", lambda v: F.lit("same")))).alias("one")).first()
    assert (row.n, row.first, row.one) == (20_000, "BOS_w1", 1)


SENTENCE = ("x", 0, "the dog ate the fish".split(), "DT NN VBD DT NN".split(), [1, 2, -1, 4, 2], "det sbj root det obj".split(), ["0101101", "11", "000000", "1", "0"], [["sg", "m"], None, ["past"], [], ["pl"]])
SCHEMA = "corpus string, sent_id long, words array<string>, pos array<string>, parents array<int>, deprels array<string>, clusters array<string>, feats array<array<string>>"


def features(spark, specs, p=1, c=4, **more):
    sents = spark.createDataFrame([SENTENCE], SCHEMA)
    pairs = spark.createDataFrame([("x", 0, p, c, *more.values())], "corpus string, sent_id long, p int, c int" + "".join(f", {k} int" for k in more))
    got = {}
    for r in ft.extract(ft.examples(sents, pairs), ft.parse_spec(specs)).collect():
        got.setdefault(r.template, []).append(r.feature)
    return got


def test_templates_in_the_notation_of_files(spark):
    wanted = {
        "pos(head(c))": ("pos(head(c))", ["VBD"]), "word(-1(c))": ("word(before1(c))", ["the"]), "pos(-2(1(c)))": ("pos(before2(after1(c)))", ["DT"]), "bc0(p) + bc1(c)": ("bc0(p)+bc1(c)", ["11_0"]), "morpho(p)": ("morpho(p)", ["NO_MORPH"]),
        "eachmorpho(c) + capitalized(p)": ("eachmorpho(c)+capitalized(p)", ["pl_LC"]), "morpho2(c)": ("morpho2(c)", ["NO_MORPH"]), "index(c)": ("index(c)", ["4"]), "deprel(dir(seq(path(p,c))))": ("seq(deprel&dir(path))", ["sbj_UP_root_DOWN_obj"]),
        "dir(path(p,c))": ("seq(dir(path))", ["UP_DOWN"]), "edgerel(bag(path(p,c)))": ("bag(rel(path))", ["obj_sbj"]), "pos(path(lca(p,c),root))": ("seq(pos(path_lca_root))", ["VBD_BOS"]), "word(bag(children(p)))": ("bag(word(children(p)))", ["the"]),
        "pos(noDup(btwn(p,c)))": ("no_dup(pos(between))", ["VBD_DT"]), "pos(2gram(line(p,c)))": ("2gram(pos(line))", ["BOS_NN", "NN_VBD", "VBD_DT", "DT_NN"]), "relative(p,c) + distance(p,c)": ("RELATIVE+DISTANCE", ["BEFORE_3"]), "relative(c,m)": ("RELATIVE(c,m)", ["AFTER"]),
        "geneology(p,c)": ("GENEALOGY", ["SIBLING"]), "len(path(p,c))": ("PATH_LEN", ["2"]), "continuity(path(p,c))": ("CONTINUITY", ["1"]), "undiredge(p,c)": ("EDGE", ["F"]), "sentlen": ("SENT_LEN", ["5"]), "word(lowsv(p))": ("word(low_verb(p))", ["ate"]),
        "deprel(lns(c))": ("deprel(lns(c))", ["sbj"]), "pos(seq(noFarChildren(c)))": ("seq(pos(no_far_children(c)))", [""]), "word(m)": ("word(m)", ["ate"]), "word(rmc(head(p)))": ("word(rmc(head(p)))", ["fish"]),
    }
    assert features(spark, list(wanted), m=2) == dict(wanted.values())
    names = [name for name, _ in wanted.values()]
    assert [t.name() for t in ft.parse_spec(names)] == names


def test_the_wall_as_an_end(spark):
    got = features(spark, ["pos(rmc(p))", "pos(lmc(p))", "word(p) + pos(c)", "seq(pos(path))", "word(bag(children(p)))", "GENEALOGY"], p=-1, c=2)
    assert got == {"pos(rmc(p))": ["VBD"], "pos(lmc(p))": ["BOS"], "word(p)+pos(c)": ["BOS_VBD"], "seq(pos(path))": ["NO_PATH"], "bag(word(children(p)))": ["ate"], "GENEALOGY": ["PARENT"]}


def test_unknown_parts(spark, tmp_path):
    for bad in ("word(x)", "colour(p)", "word(p", "pos(seq(bag(path(p,c))))", "dir(seq(children(p)))", "seq(path(p,c))", "hello"):
        with pytest.raises(ValueError):
            ft.parse_spec([bad])
    assert [t.name() for t in ft.parse_spec(["word(p) + colour(c)", "word(p)", " # none"], unknown="skip")] == ["word(p)"]
    (tmp_path / "one.txt").write_text("# first\nword(p)\n\npos(c) + word(c) # two\n")
    (tmp_path / "two.txt").write_text("sentlen\n")
    sets = ft.read_template_sets(spark, str(tmp_path))
    assert {k: [t.name() for t in v] for k, v in sets.items()} == {"one": ["word(p)", "pos(c)+word(c)"], "two": ["SENT_LEN"]}


def test_joint_templates_cross_what_has_several_features(spark):
    got = features(spark, ["pos(1gram(btwn(p,c))) + word(1gram(btwn(p,c)))", "pos(1gram(btwn(p,c))) + word(p) + pos(p)", "rule_right + word(p)"])
    assert got == {"1gram(pos(between))+1gram(word(between))": ["VBD_ate", "VBD_the", "DT_ate", "DT_the"], "1gram(pos(between))+word(p)+pos(p)": ["VBD_dog_NN", "DT_dog_NN"]}


def test_all_unigrams_follow_the_rules():
    found = ft.all_unigrams(("word", "eachmorpho"))
    lists = [t for t in found if isinstance(t, ft.List)]
    assert len(found) == len(set(found)) and all(t.prop or t.edge for t in lists) and not any(t.edge for t in lists if t.source not in ft.PATHS) and not any(t.prop in ft.EACH for t in lists)
    assert len([t for t in found if isinstance(t, ft.Token)]) == 2 * 2 * len(ft.MODIFIERS) and {t.kind for t in found if isinstance(t, ft.Pair)} == set(ft.KINDS)
    assert all(ft.parse_spec([t.name()]) == [t] for t in found)


def test_examples_of_a_long_sentence_are_dealt_out(spark):
    n = 300
    sents = spark.createDataFrame([("x", 0, ["w"] * n, ["N"] * n, [-1, *range(n - 1)], ["r"] * n)], "corpus string, sent_id long, words array<string>, pos array<string>, parents array<int>, deprels array<string>")
    ex = ft.tree_examples(sents)
    assert ex.count() == -(-n // ft.BLOCK) and ft.extract(ex, ft.parse_spec(["index(p) + index(c)"])).distinct().count() == n - 1
    assert ft.extract(ft.tree_examples(sents, wall=True), ft.parse_spec(["RELATIVE"])).count() == n
    pairs = ft.extract(ft.examples(sents, spark.range(n - 1).selectExpr("'x' as corpus", "0L as sent_id", "cast(id as int) as p", "cast(id + 1 as int) as c")), ft.parse_spec(["index(p) + index(c)"]))
    assert pairs.distinct().count() == n - 1


def test_places_and_nested_sets(spark, sample):
    rows = [([1, 4, 9], [9, 1, 5, None, 4]), ([], [1]), ([7], []), ([2, 3], [3, 3, 1])]
    df = spark.createDataFrame(rows, "ids array<int>, wanted array<int>").coalesce(1)
    assert [r.at for r in df.select(tree_index.positions("ids", "wanted").alias("at")).collect()] == [[2, 0, -1, -1, 1], [-1], [], [1, 1, -1]]
    rows, df = sample
    for r in df.select("parents", tree_index.intervals("parents").alias("s")).collect():
        n = len(r.parents)
        ways = [up(r.parents, t) for t in range(n)]
        assert sorted(b for b in r.s.begin if b >= 0) == list(range(sum(w is not None for w in ways)))
        for a in range(n):
            for b in range(n):
                if ways[a] and ways[b]:
                    assert (r.s.begin[b] <= r.s.begin[a] < r.s.end[b]) == (b in ways[a])


def test_chunks_and_their_heads(spark):
    rows = [(["B-NP", "I-NP", "O", "B-VP", "I-NP", None], [1, 3, 3, -1, 3, 4]), ([], []), (["I-X", "I-X", "B-X", "O"], [-1, 0, 1, 2])]
    df = spark.createDataFrame(rows, "tags array<string>, parents array<int>").coalesce(1)
    got = [(r.c.of, r.c.labels, r.c.heads) for r in df.select(tree_index.chunks("tags", "parents").alias("c")).collect()]
    assert got == [([0, 0, 1, 2, 3, 4], ["NP", "O", "VP", "NP", "O"], [1, 2, 3, 4, 5]), ([], [], []), ([0, 0, 1, 2], ["X", "X", "O"], [0, 2, 3])]


def test_relation_features_with_phrases_and_chunks(spark):
    sents = spark.createDataFrame([("x", 0, "the dog ate the fish".split(), [1, 2, -1, 4, 2], ["B-NP", "I-NP", "B-VP", "B-NP", "I-NP"])], "corpus string, sent_id long, words array<string>, parents array<int>, chunks array<string>")
    mentions = spark.createDataFrame([("x", 0, "a", 0, 2, 1, "ANI", "NOM"), ("x", 0, "b", 3, 5, 4, None, "NAM")], "corpus string, sent_id long, m_id string, start int, end int, head int, type string, level string")
    nodes = [(0, None, "S", 0, 5), (1, 0, "NP", 0, 2), (2, 0, "VP", 2, 5), (3, 2, "NP", 3, 5), (10, 1, "DT", 0, 1), (11, 1, "NN", 1, 2), (12, 2, "VBD", 2, 3), (13, 3, "DT", 3, 4), (14, 3, "NN", 4, 5)]
    tree = spark.createDataFrame([("x", 0, *n) for n in nodes], "corpus string, sent_id long, node int, parent int, symbol string, start int, end int")
    from corpuscraft.operators import joins as jn

    got = {}
    for r in ft.relation_features(sents, jn.ne_pairs(mentions), mentions, tree).collect():
        got.setdefault(r.template, []).append(r.feature)
    want = {
        "phrase_path": ["NN^NP^S!VP!NP!NN"], "phrase_path+lowest": ["NN^NP^S!VP!NP!NN|ate"], "types+same_VP": ["ANI_NOTYPE|false"], "levels": ["NOM_NAM"], "word_path": ["dog_UP_ate_DOWN_fish"], "types+word_path": ["ANI_NOTYPE|UP_ate_DOWN"], "words1": ["dog_the"],
        "chunk_only": ["ate"], "chunk_path_heads": ["VP:ate"], "chunk_before1": ["BOS"], "chunk_after2": ["EOS"], "between_first": ["ate"], "between_last": ["the"], "between_pair": ["dog_ate", "ate_the", "the_fish"], "head_m1+dependent": ["dog|ate"], "genealogy": ["SIBLING"], "m1_holds": ["false"],
    }
    assert {k: got.get(k) for k in want} == want and "between_none" not in got
    assert ft.relation_features(sents, jn.ne_pairs(mentions.where("m_id = 'a'")), mentions, tree).count() == 0
