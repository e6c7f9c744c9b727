"""Annotators that are counts, joint features, second-order features and resampling, against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from corpuscraft.operators import aggregates as ag
from corpuscraft.operators import features as ft
from corpuscraft.operators import masks
from corpuscraft.operators import pairs as pr
from corpuscraft.operators import significance as sg
from corpuscraft.streaming import annotate as st


def test_jackknife_with_backoff(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), rng.choice(["a", "b", "c", None, f"r{i}"]), rng.choice(["x", "y", None]), rng.choice(["N", "V", "D", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, fold int, word string, suffix string, tag string")

    def predict(row):
        for level in ([2], [3], []):
            n = Counter(r[4] for r in rows if r[1] != row[1] and r[4] is not None and all(r[c] == row[c] for c in level))
            if n:
                return max((k, t) for t, k in n.items())[1]

    got = {r.id: r.pred for r in pr.jackknife_backoff(df, [["word"], ["suffix"], []], "tag").collect()}
    assert got == {r[0]: predict(r) for r in rows}
    assert [r.pred for r in pr.jackknife_backoff(df.where("fold = 1"), [["word"], []], "tag").collect()][0] is None
    assert pr.jackknife_backoff(df.where("false"), [["word"]], "tag").count() == 0


def test_joint_counts_and_gains(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["N", "V", None]), [rng.choice([None, *range(6)]) for _ in range(4)]) for _ in range(500)]
    df = spark.createDataFrame(rows, "value string, fs array<long>").repartition(3)
    names = ["a", "b", "c", "d"]
    for order in (1, 2, 3):
        want = Counter()
        for value, fs in rows:
            for c in combinations(range(4), order):
                if value and all(fs[i] is not None for i in c):
                    bucket = 0
                    for k, i in enumerate(c):
                        bucket = (bucket * 1_000_003 * (k > 0) + fs[i]) % 7
                    want["+".join(names[i] for i in c), bucket, value] += 1
        counts = ag.joint_counts(df, names, 7, order)
        assert {(r.template, r.feature, r.value): r.n for r in counts.collect()} == want
    single = Counter((v, fs[0]) for v, fs in rows if v and fs[0] is not None)
    n = sum(single.values())
    ig = sum(k / n * math.log2(k * n / (sum(c for (w, _), c in single.items() if w == v) * sum(c for (_, g), c in single.items() if g == f))) for (v, f), k in single.items())
    got = {r.template: r.ig for r in ag.gains(ag.joint_counts(df, names, 100, 1)).collect()}
    assert abs(got["a"] - ig) < 1e-9
    report = ag.select_bigrams(df, names, 1, 3, 64).collect()
    assert len(report) == 3 and [r.selected for r in sorted(report, key=lambda r: r["rank"])] == ["Y", "N", "N"]
    assert ag.joint_counts(df.where("false"), names, 7).count() == 0


def test_second_order_features_from_masks(spark):
    rng = random.Random(3)
    sizes = {1: 1, 2: 3, 3: 9, 4: 70}
    kept = {(s, p, c) for s, n in sizes.items() for c in range(n) for p in range(-1, n) if p != c and rng.random() < 3 / (n + 1)}
    sents = spark.createDataFrame([("x", s, [f"w{i % 5}" for i in range(n)], ["NVD"[i % 3] for i in range(n)]) for s, n in sizes.items()], "corpus string, sent_id long, words array<string>, pos array<string>")
    lengths = spark.createDataFrame([("x", s, n) for s, n in sizes.items()], "corpus string, sent_id long, n int")
    mask = masks.packed(spark.createDataFrame([("x", *a, True) for a in kept], "corpus string, sent_id long, p int, c int, kept boolean"), lengths)
    want = defaultdict(set)
    by_head = defaultdict(list)
    for s, p, c in sorted(kept):
        by_head[s, p].append(c)
    for s, p, c in kept:
        want["grandparent"] |= {(s, g, p, c) for t, g, d in kept if t == s and d == p and g != c}
        want["sibling"] |= {(s, p, c, d) for d in by_head[s, p] if d > c}
        want["bigram"] |= {(s, p, q, c) for t, q, d in kept if t == s and d == c - 1}
    want["consecutive"] = {(s, p, a, b) for (s, p), kids in by_head.items() for a, b in zip(kids, kids[1:])}
    got = defaultdict(list)
    rows = ft.second_order_features(sents, mask).collect()
    for r in rows:
        if r.template == "bias":
            got[r.kind].append((r.sent_id, r.h, r.m, r.s))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    word, tag = (lambda i: f"w{i % 5}" if i >= 0 else "WALL"), (lambda i: "NVD"[i % 3] if i >= 0 else "WALL")
    for r in rows:
        if r.kind == "sibling" and r.template == "S_h":
            assert r.feature == "".join("R" if r.h < x else "L" for x in (r.m, r.s)) + f"_{word(r.s)}_{tag(r.h)}"
    hashed = ft.second_order_features(sents, mask, ["bigram"], 50)
    assert {r.feature for r in hashed.select("feature").distinct().collect()} <= set(range(50))
    ex = ft.extract(ft.mask_examples(sents, mask), ft.parse_spec(["index(c)"]))
    assert sorted((r.sent_id, r.p, r.c) for r in ex.collect()) == sorted(kept)


def test_draws_that_sql_repeats(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.random() < 0.6), 1.0], [float(rng.random() < 0.4), 1.0]) for i in range(80)]
    df = spark.createDataFrame(rows, "key int, a array<double>, b array<double>")
    got = {r["sample"]: (r.a, r.b) for r in sg.resampled(df, 20, "permutation", 3).collect()}
    weighed = {r["sample"]: (r.a, r.b) for r in sg.resampled(df, 20, "bootstrap", 3).collect()}
    for s in range(20):
        digests = {k: hashlib.md5(f"3:{k}:{s}".encode()).hexdigest() for k, _, _ in rows}
        swapped = [(b, a) if digests[k][0] < "8" else (a, b) for k, a, b in rows]
        assert got[s] == tuple([sum(x[side][i] for x in swapped) for i in range(2)] for side in (0, 1))
        weight = {k: sum(int(h[:13], 16) / 2**52 >= c for c in sg.POISSON) for k, h in digests.items()}
        assert weighed[s] == tuple([sum(weight[r[0]] * r[1 + side][i] for r in rows) for i in range(2)] for side in (0, 1))
    share = lambda x: F.get(x, F.lit(0)) / F.get(x, F.lit(1))
    p = sg.resampled_p(sg.resampled(df, 200, "permutation"), df, "permutation", share).first()
    assert p.p == (p.n_extreme + 1) / 201
    exact = sg.paired_permutation(df.selectExpr("'x' as corpus", "key as sent_id", "a as ss"), df.selectExpr("'x' as corpus", "key as sent_id", "b as ss"), 1 << 14)
    assert abs(exact - p.p) < 0.1


def test_running_counts_survive_a_restart(spark, tmp_path):
    rows = [(i, "ab"[i % 2], i % 3 == 0 if i % 5 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, kind string, hit boolean")
    arrivals, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for low, high in ((0, 7), (7, 7), (7, 30)):
        df.where(f"id >= {low} and id < {high}").write.mode("append").parquet(arrivals)
        st.write_updates(st.running_counts(spark.readStream.schema(df.schema).parquet(arrivals), ["kind"]), out, mark).awaitTermination()
        seen = [r for r in rows if r[0] < high]
        assert {r.kind: (r.n, r.n_hit) for r in st.latest_counts(spark, out, ["kind"]).collect()} == {k: (sum(r[1] == k for r in seen), sum(r[1] == k and bool(r[2]) for r in seen)) for k in "ab"}
