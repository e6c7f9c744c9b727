"""Embedding, SimHash and line dedup against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from corpuscraft.llm.common import Scratch, components
from corpuscraft.llm.embedding_dedup import calibrate, embedding_dedup
from corpuscraft.llm.line_dedup import _lines, line_dedup
from corpuscraft.llm.simhash_dedup import _forest, fingerprint, fingerprint_links, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def least_reachable(ids, links):
    """The smallest id reachable from each."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 200), (5, 5)]
    got = {r.id: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    want = least_reachable({x for e in links for x in e}, links)
    assert got == {i: c for i, c in want.items() if i != c}


# embeddings


def brute_embeddings(rows):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[k] = np.array(v, np.float64)
    links = [(a, b) for a, b in combinations(ok, 2) if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.93]
    return links


def test_embedding_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        base = rng.standard_normal(16)
        rows.append((len(rows), base.tolist(), i % 3))
        for scale in (0.2, 0.35, 0.5)[: i % 4]:
            rows.append((len(rows), (base + scale * rng.standard_normal(16)).tolist(), i % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(50)]  # copies
    got = {r.vec_id: r for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links = brute_embeddings(rows)
    want = least_reachable(range(len(rows)), links)
    degree = {i: 0 for i in range(len(rows))}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_links for i, r in got.items()} == degree
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_dedup_edges(spark):
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, None, 1, None), (4, [0.0, 0.0], 1, "x"), (5, [float("nan"), 1.0], 1, "x"), (6, [1.0, None], 1, "x"), (7, [1.0, 0.0], None, "x"), (8, [1.0, 0.0], 2, "x"), (None, [1.0, 0.0], 1, "x"), (9, [1.0, 0.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "y"), (10, [float("inf"), 1.0], 1, ""), (11, [], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, component_id string")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup(df).collect()), key=str)
    assert len(got) == len(rows)
    assert got.count((2, 2, 1, False)) == 2 and (1, 2, 1, True) in got and (0, 0, None, False) in got
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert (i, 0, i, True) in got
    assert embedding_dedup(df.limit(0)).count() == 0


def test_calibrated_count_reaches_the_recall():
    window, count, strip = calibrate(0.93, 32, 1.0, 0.999)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    directions = rng.standard_normal((64, 33))
    apart = np.abs((x - y) @ directions)
    assert ((apart[:, :32] <= window).sum(axis=1) >= count).mean() > 0.99
    assert (apart[:, 32] <= strip).mean() > 0.995


# SimHash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one two", "A b\u00a0c D é\x1fü f", "x " * 50, "ÀB cd ef gh", "a b c a b c a b c"])
def test_fingerprint_by_definition(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_hash_is_the_engines(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("ab cd éf",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("ab cd éf".encode(), 42)


def test_links_lose_nothing(spark):
    """Random fingerprints, a chain, and one large group of near ones, which is split into blocks."""
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 7}
    base = rng.getrandbits(64)
    for _ in range(400):
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    for f in list(fps)[:150]:
        fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3)
    got = least_reachable(signed, [(r.a, r.b) for r in links.collect()])
    near = [(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert got == least_reachable(signed, near)


def test_forest_joins_what_links():
    a = np.array([0, 1, 3, 15 << 40, (15 << 40) | 1], np.uint64)
    x, y = _forest(a, a, 1)
    assert least_reachable(a.tolist(), zip(x.tolist(), y.tolist())) == {0: 0, 1: 0, 3: 0, 15 << 40: 15 << 40, (15 << 40) | 1: 15 << 40}


def test_simhash_dedup_edges(spark):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text + " w"), (9, text), (7, None), (8, ""), (2, " \n "), (None, text), (10, "other words entirely here"), (9, text), (11, "word " * 200_000)]
    df = spark.createDataFrame([(i, t, "en", None, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, component_id string")
    got = [(r.doc_id, r.fingerprint, r.component_id, r.kept) for r in simhash_dedup(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[7][1:] == ("0" * 16, 2, False) and by[8][2] == 2 and by[2][3]
    assert by[9][2] == by[5][2] == by[None][2] and not by[None][3]
    assert all(r[1] == f"{plain_fingerprint(dict(rows)[r[0]]):016x}" for r in got if r[0] != 11)
    assert simhash_dedup(df.limit(0)).count() == 0


# lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    lines = sorted((i, k, tuple(w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w)) for i, t in rows if i is not None and t is not None for k, line in enumerate(t.split("\n")))
    gone = {}
    for n, (i, k, words) in enumerate(lines):
        if words and any(other == words or min(len(words), len(other)) >= 5 and abs(len(words) - len(other)) <= 1 and edit_distance(words, other) <= 1 for _, _, other in lines[:n] if other):
            gone.setdefault(i, set()).add(k)
    return {i: (t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone.get(i, ()))) for i, t in rows}


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(40)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            at = rng.randrange(len(x) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                x.insert(at, rng.choice(words))
            elif x and kind == 1:
                x.pop(at % len(x))
            elif x:
                x[at % len(x)] = rng.choice(words)
        return " ".join(x)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(120)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_lines_are_tidied_by_searches(spark):
    rng = random.Random(8)
    odd = ["", " ", "\t", "a", " a", "a ", "a  b", "a\tb", "a\r", "\x0ba\fb", "é\u00a0b c", "a\u2003b"] + ["".join(rng.choice("aé \t\r\f\x0b\u00a0") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    found = _lines(spark.createDataFrame([(0, None), (None, "x"), (1, "\n".join(odd))], "doc_id long, text string"))
    tidy = [b" ".join(x.encode().split()).decode() for x in odd]
    assert [(r.line_no, r.line) for r in sorted(found.collect())] == [(k, x) for k, x in enumerate(tidy) if x]
    assert "rlike" not in found._jdf.queryExecution().toString().lower()  # no regular expression over every line


def test_line_dedup_edges(spark):
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(1, "a b c d e\n\n a  b\tc d e \nq"), (2, None), (3, ""), (None, "a b c d e"), (4, "a b c d f\nq\n"), (5, long), (6, long + " y"), (7, "a b c d"), (8, "q"), (8, "q")]
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], "doc_id long, text string, n_lines string, n_chars long")
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed, r.n_chars) for r in line_dedup(df).collect()]
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows)
    assert by[1] == ("a b c d e\n\nq", 4, 1, 9) and by[2] == (None, 0, 0, 9) and by[3] == ("", 1, 0, 9) and by[None][:1] == ("a b c d e",)
    assert by[4] == ("", 3, 2, 9) and by[5][2] == 0 and by[6] == ("", 1, 1, 9) and by[7][0] == "a b c d" and by[8] == ("", 1, 1, 9)
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowColumnar", "")
