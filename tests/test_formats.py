"""Corpus formats: what is read is written back."""

import pytest

from corpuscraft.sources.documents import NESTED, doc_mentions, doc_relations, doc_srl, flatten_documents, ingest_text, nest_annotations
from corpuscraft.sources.readers import read_clusters, read_conll02, read_conll03, read_conll08, read_conll09, read_conll_lite, read_conllx, read_embeddings, read_json_sents, read_semeval, read_tag_map
from corpuscraft.sources.writers import TEXTS, semeval_text

X = "1\tThe\tthe\tD\tDT\tdef|sg\t2\tdet\t_\t_\n2\tdog\t_\tN\tNN\t_\t0\troot\t_\t_\n"
C09 = "1\tcats\tcat\tcat\tNNS\tNNS\t_\t_\t2\t2\tsbj\tsbj\t_\t_\tA0\tA1\n2\tlike\tlike\tlike\tVBP\tVBP\t_\t_\t0\t0\troot\troot\tY\tlike.01\t_\t_\n3\teating\teat\teat\tVBG\tVBG\ta|b\ta|b\t2\t2\toprd\toprd\tY\teat.02\tA1\t_\n"
C08 = "1\tcats\tcat\tNNS\tNNS\tcats\tcat\tNNS\t2\tsbj\t_\tA0\n2\tlike\tlike\tVBP\tVBP\tlike\tlike\tVBP\t0\troot\tlike.01\t_\n"
FILES = {
    "conll02": (read_conll02, "El DA O\nAbogado NC B-PER\n\n. Fp O\n"),
    "conll03": (read_conll03, "-DOCSTART- -X- O O\n\nEU NNP I-NP I-ORG\nrejects VBZ I-VP O\n"),
    "conllx": (read_conllx, X + "\n" + X),
    "conll08": (read_conll08, C08),
    "conll09": (read_conll09, C09 + "\n" + C09),
    "lite": (read_conll_lite, "a\tcats\tb, A0\nb\tlike\t0, like.01\n"),
    "json": (read_json_sents, '{"words":["a","b"],"posTags":["X","Y"],"parents":[-1,0]}\n\n{"words":["c"]}\n'),
}


def put(tmp_path, text, name="in.txt"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


@pytest.mark.parametrize("kind", FILES)
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_round_trip(spark, tmp_path, kind, end):
    reader, text = FILES[kind]
    df = reader(spark, put(tmp_path, text.replace("\n", end)))
    out = [r.value for r in TEXTS[kind](df).orderBy("sent_id").collect()]
    assert "\n".join(out) == text


def test_blank_lines_are_only_separators(spark, tmp_path):
    df = read_conll02(spark, put(tmp_path, "\n\na X O\n\n\n \nb Y O\n\n"))
    assert [(r.sent_id, r.words) for r in df.orderBy("sent_id").collect()] == [(0, ["a"]), (1, ["b"])]


def test_short_lines_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="fewer than 3 columns"):
        read_conll02(spark, put(tmp_path, "a X\n")).collect()


def test_heads_and_arcs(spark, tmp_path):
    r = read_conll09(spark, put(tmp_path, C09)).first()
    assert r.parents == [1, -1, 1] and r.feats == [None, None, ["a", "b"]]
    assert {tuple(a) for a in r.arcs} == {(-1, 1, "like.01"), (-1, 2, "eat.02"), (1, 0, "A0"), (1, 2, "A1"), (2, 0, "A1")}
    x = read_conllx(spark, put(tmp_path, X.replace("\t2\tdet", "\t_\tdet"))).first()
    assert x.parents == [-2, -1] and x.lemmas == ["the", None]


def test_latin_1(spark, tmp_path):
    (tmp_path / "l").write_bytes("España NP B-LOC\n\nx Y O\n".encode("latin-1"))
    df = read_conll02(spark, str(tmp_path / "l"), encoding="ISO-8859-1")
    assert [r.words for r in df.orderBy("sent_id").collect()] == [["España"], ["x"]]


def test_unknown_json_key(spark, tmp_path):
    with pytest.raises(Exception, match="unknown keys: other"):
        read_json_sents(spark, put(tmp_path, '{"words":["a"],"other":1}\n')).collect()


def test_semeval(spark, tmp_path):
    text = '7\t"The <e2><e1>man</e1></e2> jumped over the moon ."\nOther\nComment: none\n\n8\t"A <e1>big cat</e1> sat in <e2>it</e2> ."\nContent-Container(e1,e2)\nComment:\n'
    a, b = read_semeval(spark, put(tmp_path, text)).orderBy("sent_id").collect()
    assert [(m.start, m.end) for m in a.mentions] == [(1, 2), (1, 2)] and a.words[1] == "man" and a.rel_label == "Other" and a.comment == "none"
    assert [(m.start, m.end) for m in b.mentions] == [(1, 3), (5, 6)]
    df = spark.createDataFrame([("s", 1, "The man sat".split())], "corpus string, sent_id long, words array<string>")
    pairs = spark.createDataFrame([("s", 1, 0, "x", "y", "Other")], "corpus string, sent_id long, k int, m1 string, m2 string, label string")
    mentions = spark.createDataFrame([("s", 1, "x", 0, 2), ("s", 1, "y", 1, 2)], "corpus string, sent_id long, m_id string, start int, end int")
    assert semeval_text(df, pairs, mentions).first().value.split("\n")[0].split("\t")[1] == '"<e1>The <e2>man</e2></e1> sat"'


def test_lexicons(spark, tmp_path):
    vecs = read_embeddings(spark, put(tmp_path, "a\t1\t2\nb\t3\t4\n"), spark.createDataFrame([("b",)], "word string"))
    assert [(r.word, r.vec) for r in vecs.collect()] == [("b", [3.0, 4.0])]
    with pytest.raises(ValueError, match="lengths"):
        read_embeddings(spark, put(tmp_path, "a\t1\nb\t3\t4\n", "bad"))
    assert read_clusters(spark, put(tmp_path, "010110\tdog\t5\n", "c"), 4).first()[:] == ("dog", "0101")
    assert read_tag_map(spark, put(tmp_path, "NN\tN\nodd\n", "m")).collect() == [("NN", "N")]


def test_offsets(spark):
    text = "Hello  world\n\n a b\n"
    rows = ingest_text(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [(r.line_no, r.tok, r.word) for r in rows] == [(0, 0, "Hello"), (0, 1, "world"), (2, 0, "a"), (2, 1, "b")]
    assert all(text[r.start : r.end] == r.word for r in rows)


def nested(spark):
    tok = lambda *ws: [{"idx": i, "text": w, "start": 0, "end": 1} for i, w in enumerate(ws)]
    sent = {"tok_uuid": "t1", "tokens": tok("cats", "like", "fish"), "taggings": [{"type": "POS", "tool": "old", "tags": ["A", "B", "C"]}, {"type": "POS", "tool": "my tagger", "tags": ["N", "V", "N"]}], "parses": [{"tool": "p", "deps": [{"gov": 1, "dep": 0, "edge": "sbj"}, {"gov": -1, "dep": 1, "edge": "root"}]}]}
    mention = lambda u, i, t: {"uuid": u, "tok_uuid": "t1", "token_idx": [i], "anchor": i, "type": t, "phrase": "NAM"}
    args = [{"role": "Arg-1", "mention_uuid": "m1", "props": [{"name": "volition", "value": "likely", "polarity": 4.5}]}, {"role": "Arg-2", "mention_uuid": "m2", "props": []}]
    doc = {"id": "d", "text": "cats like fish", "sections": [{"sentences": [sent]}], "mention_sets": [{"tool": "m", "mentions": [mention("m1", 0, "B-ANI:CAT"), mention("m2", 2, "ANI:FISH")]}],
           "situation_sets": [{"tool": "s", "situations": [{"kind": "RELATION", "type": "ART:OWN", "token_idx": [], "args": args}, {"kind": "SITUATION", "type": "like.01", "token_idx": [1], "args": args}]}]}
    return spark.createDataFrame([doc], NESTED)


def test_nested_documents(spark):
    d = nested(spark)
    r = flatten_documents(d, pos="tagger").first()
    assert r.words == ["cats", "like", "fish"] and r.pos == ["N", "V", "N"] and r.parents == [1, -1, -2] and r.deprels == ["sbj", "root", None]
    assert flatten_documents(d).first().pos == ["A", "B", "C"]
    assert {(m.m_id, m.type, m.subtype, m.start, m.end) for m in doc_mentions(d).collect()} == {("m1", "ANI", "CAT", 0, 1), ("m2", "ANI", "FISH", 2, 3)}
    rel = doc_relations(d).first()
    assert (rel.type, rel.subtype) == ("ART", "OWN") and [a.m_id for a in rel.args] == ["m1", "m2"]
    arcs, props = doc_srl(d)
    assert {(a.p, a.c, a.label) for a in arcs.collect()} == {(-1, 1, "like.01"), (1, 0, "Arg-1"), (1, 2, "Arg-2")}
    assert props.first().property == "volition"


def test_nesting_annotations(spark):
    d = nested(spark)
    layers = flatten_documents(d, pos="tagger").select("doc_id", "tok_uuid", "pos", "parents", "deprels")
    out = nest_annotations(d, layers, "mine", mentions=doc_mentions(d), relations=doc_relations(d))
    assert out.count() == 1
    back = flatten_documents(out, pos="mine", parse="mine").first()
    assert back.pos == ["N", "V", "N"] and back.parents == [1, -1, -2]
    assert {m.m_id for m in doc_mentions(out, "mine").collect()} == {"m1", "m2"} and doc_relations(out, "mine").first().type == "ART"
