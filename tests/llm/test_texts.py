"""HTML, fingerprints, quality, URLs and the pipeline."""

import hashlib
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuscraft.llm.html_extract import extract, extract_pages
from corpuscraft.llm.mil_quality import FEATURES, Model, _gradients, encode, fit, reject_low_quality, score, train
from corpuscraft.llm.multiset_hash import Fingerprint, document_fingerprints, edited
from corpuscraft.llm.url_automaton import RULES, Automaton, judge_urls

SENTENCE = "It was the best of times and it was the worst of times, and all of the people were there with their families to see it."


# html


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>no</a></ul></nav>
    <div class="cookie-notice">no</div><aside class="sidebar">no</aside><article><h1>Title &amp; more</h1><p>First   <b>bo</b>ld&nbsp;x<br>y<p>Short.<div class="ad">no</div><form><p>no</form><ul><li>one<li>two</ul>
    <p>{SENTENCE}</p><section id="comments"><p>no {SENTENCE}</section></article><footer>no</footer><!-- no --></body></html>"""
    assert extract(page) == f"Title & more First bold x y Short. one two {SENTENCE}"


def test_page_without_article_mark():
    page = f'<body><div class="menu"><a href=/>no</a></div><h1>Head</h1><p>{SENTENCE} {SENTENCE}<p>Short one.<p>{SENTENCE}</p><p><a href=a>no link</a> <a href=b>no other</a></p><p class="footer">no</p>'
    assert extract(page) == f"Head {SENTENCE} {SENTENCE} Short one. {SENTENCE}"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain &lt;text", "plain <text"), ("<p>a < b & c</p><script>x", "a < b & c"), ("<article>x<!-- open", "x"), ("<article><p>a</p></article>" * 2, "a a"), ("<div hidden>x</div>", "")])
def test_odd_pages(page, text):
    assert extract(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f'<article><a class="share">no</a><p>{SENTENCE}</p></article>',
        f'<article><a class="share" href=x>no<a href=y></a><p>{SENTENCE}</p></article>',
        f'<article><p><a class="social">no</a>{SENTENCE}</article>',
        f'<body class="has-sidebar"><article><p>{SENTENCE}</p></article>',
        f'<html id="no-comments"><body class="page widget"><p>{SENTENCE} {SENTENCE}</p>',
        f'<main class="with-side"><p>{SENTENCE}</p></main>',
        f'<article id="ad"><p>{SENTENCE}</p></article>',
        f'<div class="widget-container"><p>no</p><article><p>{SENTENCE}</p></article></div>',
        f'<div class="widget-container"><article><p>{SENTENCE}</p></article><div class="related"><article>no</article></div></div>',
        f'<article><p>{SENTENCE}</p></article><div class="related"><article>no</article></div>',
        f'<div class="related"><article hidden>{SENTENCE} {SENTENCE}</article></div><div class="page no-sidebar"><article>{SENTENCE}</article></div>',
    ],
)
def test_marks_lose_no_article(page):
    got = extract(page)
    assert got in (SENTENCE, f"{SENTENCE} {SENTENCE}") and "no" not in got.split()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<main><div class="search-results-article"><p>Real article text.', "Real article text."),
        ("<article><p>See <a>the manual</a></p>", "See the manual"),
        ("<article><header><h1>Title</h1></header><p>Text.", "Title Text."),
        ('<article><div class="article-header"><h2>Part</h2></div><p>Text.', "Part Text."),
        ("<article><p>Text.<aside>no</aside><p>End.<footer>no</footer></article>", "Text. End."),
        ("<article><p>Text.<ul><li><a>no one</a><li><a>no two</a><li><a>no three</a></ul></article>", "Text."),
    ],
)
def test_marks_are_features_only(page, text):
    assert extract(page) == text


@pytest.mark.parametrize("depth", [1, 2, 49, 50, 60, 300])
def test_nested_wrappers_with_bad_names_keep_the_text(depth):
    page = "<div class='menu'><p>Not this menu of the site.</p></div>" + "<div class='sidebar-wrap'>" * depth + f"<p>{SENTENCE}</p><p>{SENTENCE}</p>" + "</div>" * depth
    assert extract(page) == f"{SENTENCE} {SENTENCE}"
    assert extract("<div class='sidebar-wrap'>" * depth + SENTENCE + "</div>" * depth) == SENTENCE


def test_reader_comments_under_other_names():
    for name in ("discussion", "responses", "user-feedback", "guestbook", "comments-area"):
        page = f"<article><p>{SENTENCE}</p><div class='{name}'><p>I think that this is not what the author had in mind, and the rest of it is as bad as it was.</p></div></article>"
        assert extract(page) == SENTENCE


def test_languages_without_a_list_of_stop_words():
    chinese = "网页抽取的任务是把一页里的正文与菜单、广告和页脚分开。" * 12
    page = f"<div><a href='/'>首页</a> <a href='/n'>新闻</a></div><div>{chinese}</div><div><a href='/c'>联系我们</a> <a href='/p'>隐私</a></div>"
    assert extract(page) == chinese
    russian = "Задача состоит в том, чтобы отделить основной текст страницы от меню, рекламы и нижней части. " * 4
    assert extract(f"<div><p>{russian}</p><p><a href='/a'>{russian}</a></p></div>") == russian.strip()


def test_densities_find_the_article_of_unmarked_pages(spark):
    lost = extra = total = 0
    for row in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        want = Counter(extract(row.html).split())
        got = Counter(extract(row.html.replace("<article>", "<div>").replace("</article>", "</div>")).split())
        lost, extra, total = lost + (want - got).total(), extra + (got - want).total(), total + want.total()
    assert lost < 0.12 * total and extra < 0.02 * total


def test_nesting_takes_linear_time():
    def seconds(n: int) -> float:
        began = time.process_time()
        extract("<div>" * n + '<div class="ad">' * n + "<p>x" * n + "</div>" * n)
        return time.process_time() - began

    assert seconds(20_000) < 20 * max(seconds(4_000), 0.01)


def test_pages_frame(spark):
    rows = [(1, "u", f"<article><p>{SENTENCE}", "x"), (2, None, None, "x"), (None, "u", "", None), (1, "u", f"<article><p>{SENTENCE}", "x"), (3, "u", "<article>" + "<p>word " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_pages(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(SENTENCE)), (1, len(SENTENCE)), (2, 0), (3, 5 * 200_000 - 1)]
    assert extract_pages(df.limit(0)).count() == 0


# fingerprints


def test_multiset_hash_adds_up():
    a = Fingerprint.of("a b c d\ne f\n\ng")
    assert a.text() == Fingerprint.of("g\na b c d\ne f").text() == Fingerprint.of("a b c d\ne f").add(Fingerprint.of("g")).text()
    assert a.remove(Fingerprint.of("g")).text() == Fingerprint.of("e f\na b c d").text() != a.text()
    assert a.text() != Fingerprint.of("a b c d\ne f\ng\ng").text() and Fingerprint.parse(a.text()).text() == a.text()
    assert Fingerprint.of("").likeness(Fingerprint.of(None)) == 1 and Fingerprint.of("a").likeness(Fingerprint.of("")) == 0


def test_likeness_follows_what_is_shared():
    rng = random.Random(1)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))
    x, y = text(), text()
    near = Fingerprint.of(x).likeness(Fingerprint.of(edited(x, y)))
    assert 0.3 < near < 0.7 and Fingerprint.of(x).likeness(Fingerprint.of(y)) < 0.25


def test_document_fingerprints(spark):
    rows = [(i * 3, " ".join(f"w{i}x{k}" for k in range(i % 17)) or None, "x") for i in range(60)] + [(6, "again", "x"), (None, "nameless é", None), (500, "long text " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(5)
    got = document_fingerprints(df).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k, (i, text, _) in enumerate(order):
        following = order[(k + 1) % len(order)]
        if i == 6 or following[0] == 6:  # which of the two comes first is by hash
            continue
        (r,), text, other = by[i], text or "", following[1] or ""
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited(text, other).encode()).hexdigest()
        assert r.fingerprint == Fingerprint.of(text).text() and r.edited_fingerprint == Fingerprint.of(edited(text, other)).text()
        assert r.near_next == Fingerprint.of(text).likeness(Fingerprint.of(other))
    assert document_fingerprints(df.limit(0)).count() == 0
    (one,) = document_fingerprints(df.where("doc_id = 500")).collect()
    assert one.near_next == 1.0


# quality


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    shapes = [(FEATURES, 3), (3,), (3, 2), (3, 2), (2,), (3,), (1,)]
    w = [rng.normal(0, 0.5, s) for s in shapes]
    x, starts, y = rng.normal(0, 0.3, (7, FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss(w):
        from corpuscraft.llm.mil_quality import _forward

        logit, _ = _forward(w, x, starts)
        return np.mean(np.logaddexp(0, logit) - y * logit)

    grads = _gradients(w, x, starts, y)
    for k, s in enumerate(shapes):
        at = tuple(rng.integers(0, n) for n in s)
        step = 1e-5
        up, down = [v.copy() for v in w], [v.copy() for v in w]
        up[k][at] += step
        down[k][at] -= step
        assert abs((loss(up) - loss(down)) / (2 * step) - grads[k][at]) < 1e-6


def test_encoding_passages():
    assert encode(None).shape == encode(" \n").shape == (1, FEATURES) and encode("x").shape[0] == 1
    assert encode("word " * 129).shape[0] == 3 and np.isfinite(encode("é" * 10_000)).all()


def corpus(n=240):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "was", "slow", "and", "old", "they", "said"]) for _ in range(rng.randint(5, 200)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW###", "$$$", "CLICK!!", "a|b"]) for _ in range(rng.randint(5, 200)))
    labels = [(i, int(i % 4 > 0), 0) for i in range(n)]
    return [(i, good() if q else bad()) for i, q, _ in labels], labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = score(d, train(d, lab)).collect()
    quality = {i: q for i, q, _ in labels}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.95 * len(held)
    flipped = spark.createDataFrame([(i, 1 - q if crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q, _ in labels], "doc_id long, quality int, toxic int")
    assert [r.score for r in score(d, train(d, flipped)).orderBy("doc_id").collect()] == [r.score for r in sorted(rows, key=lambda r: r.doc_id)]  # held-out labels play no part


def test_quality_edges(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some words", "x"), (3, "word " * 100_000, None), (1, None, "x")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = score(d, train(d, none)).collect()
    assert len(got) == 5 and all(r.score == 1.0 and r.predicted == 1 for r in got)
    assert reject_low_quality(d, none).columns == d.columns and reject_low_quality(d, none).count() == 5
    assert score(d.limit(0), train(d.limit(0), none)).count() == 0
    one_class = fit([encode("a"), encode("b")], np.array([0.0, 0.0], np.float32))
    assert isinstance(one_class, Model) and one_class.score(encode("x")) == 0


# URLs


def plain_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


URLS = [None, "", "no scheme", "http://NET", "http://a.Example.NET/en/x?y#z", "https://xexample.net/en/", "http://example.com/de", "http://m.example.com/de/1", "ftp://org/fr/", "http://a.org/fr/?q=://net/", "http://a.com/x.net/", "http://a.com?net/", "http://é.net/ü", "http://example.com:80/de/", "http:///x", "http://net/\nx", "x://y://net/", "http://sub.sub.net/" + "p" * 100_000]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://net/", "x"), (0, None, None)], "page_id long, url string, rule string")
    got = judge_urls(df).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None:
            assert tuple(r)[1:] == plain_judge(URLS[r.page_id])
    assert judge_urls(df.limit(0)).count() == 0


def test_automaton_of_many_words():
    from corpuscraft.llm.url_automaton import Rule

    rules = tuple(Rule(f"host{i}.net", f"/path{i}/", "block") for i in range(40))
    a = Automaton(rules)
    assert a.words > 8
    fits = a.match([f".x.host{i}.net/path{i}/y".encode() for i in range(40)] + [b".host1.net/path2/"])
    assert (fits[:40] == np.eye(40, dtype=bool)).all() and not fits[40].any()


def plain_glob(glob):
    return "".join(".*" if t == "*" else "." if t == "?" else re.escape(t[-1]) for t in re.findall(r"(?s)\\.|.", glob))


HOSTS = st.text("ab.é", max_size=5)


@given(st.lists(st.tuples(st.text("ab.é*?\\", min_size=1, max_size=5), st.one_of(st.just(""), st.text("a/é*?", max_size=5).map(lambda t: "/" + t))), min_size=1, max_size=9), st.lists(st.tuples(HOSTS, st.one_of(st.just(""), st.text("a/éb", max_size=6).map(lambda t: "/" + t))), min_size=1, max_size=9))
def test_wildcards_against_patterns(globs, urls):
    """Hosts and paths apart, by the engine of patterns, over all rules at once."""
    from corpuscraft.llm.url_automaton import Rule

    fits = Automaton(tuple(Rule(h, p, "block") for h, p in globs)).match([f".{h}{p}".encode() for h, p in urls])
    for i, (host, path) in enumerate(urls):
        for k, (h, p) in enumerate(globs):
            wanted = re.fullmatch(rf"(?s)(.*\.)?{plain_glob(h)}", host) and re.match(rf"(?s){plain_glob(p)}", path)
            assert fits[i, k] == bool(wanted), (globs[k], urls[i])


def test_wildcards_of_rules(spark):
    from corpuscraft.llm.url_automaton import Rule

    rules = (Rule("ads?.*", "", "block"), Rule("shop.example.net", "/*/cart", "block"), Rule("net", "/", "allow"), Rule("a\\*b", "/", "block"))
    urls = ["http://ads1.com", "http://x.ads9.org/p", "http://ads.com/", "http://shop.example.net/en/cart?x", "http://shop.example.net/cart", "http://a*b/", "http://axb/", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df, rules, "none").collect()}
    assert got == {0: ("ads?.*", "block"), 1: ("ads?.*", "block"), 2: (None, "none"), 3: ("shop.example.net/*/cart", "block"), 4: ("net/", "allow"), 5: ("a\\*b/", "block"), 6: (None, "none"), 7: (None, "none")}
    with pytest.raises(ValueError):
        Rule("net", "x", "block")
