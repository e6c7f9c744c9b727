"""Embedding near-dedup by collision-counting projections (C2LSH and QALSH are the published relatives).

Vectors are scaled to length one and projected on many random directions. Two vectors at the cosine
threshold lie within a window of each other on a direction with a known chance, so over all directions
they collide at least ``count`` times with a chance that the binomial law gives; ``count`` is the
largest that still reaches the wanted recall. Pairs that collide so often are verified by their exact
cosine in double precision.

Equal vectors are one class from the start. The classes of a group are sorted into strips along one more
direction; those of near pairs are the same or adjacent (its chance of failing is part of the recall). Strips
are split into blocks by a hash, so a hot label spreads over as many tasks as it has pairs of blocks, and a pair
of blocks is compared in one task: for each query the windows around it in every sorted projection are found
by binary search and counted. It returns how many vectors each class links with, and a spanning forest of the
links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Classes of a block.
BLOCK = 2048


def calibrate(threshold: float, directions: int, width: float, recall: float) -> tuple[float, int, float]:
    """Window, least collisions, and strip width for pairs of unit vectors at the cosine threshold.

    width: the window in units of the standard deviation of the pair's distance along a direction. Half
    of the misses that ``recall`` allows goes to the strips, half to the count.
    """
    spread = math.sqrt(2 - 2 * threshold)
    p = math.erf(width / math.sqrt(2))
    miss = (1 - recall) / 2
    below, count = 0.0, 0
    while count < directions:
        below += math.comb(directions, count) * p**count * (1 - p) ** (directions - count)
        if below > miss:
            break
        count += 1
    far = 1.0
    while math.erfc(far / math.sqrt(2)) > miss:
        far += 0.01
    return width * spread, count, far * spread


def _valid(vectors: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    ok = np.zeros(len(vectors), bool)
    out = []
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            if np.isfinite(x).all() and x.any():
                ok[i] = True
                out.append(np.ldexp(x, -np.frexp(np.abs(x).max())[1]))  # a power of two off, so that its norm is finite and not zero
    return ok, out


def _directions(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, count))


def _links(a: pd.DataFrame, b: pd.DataFrame, window: float, count: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs between the rows of a and b."""
    pa_, pb = np.stack(a.projections), np.stack(b.projections)
    xa, xb = np.stack(a.vector), np.stack(b.vector)
    order = np.argsort(pb, axis=0)
    bounds = [(np.searchsorted(s := pb[order[:, k], k], pa_[:, k] - window), np.searchsorted(s, pa_[:, k] + window, "right")) for k in range(pb.shape[1])]
    columns = [np.ascontiguousarray(order[:, k]) for k in range(pb.shape[1])]
    left, right = [], []
    for q in range(len(a)):
        hits = np.bincount(np.concatenate([c[lo[q] : hi[q]] for c, (lo, hi) in zip(columns, bounds)]), minlength=len(b))
        j = np.nonzero(hits >= count)[0]
        if len(j):
            j = j[xb[j] @ xa[q] >= threshold]
            left.append(np.full(len(j), q))
            right.append(j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, directions: int = 32, width: float = 1.0, recall: float = 0.999, seed: int = 11) -> DataFrame:
    """Near copies among vectors of equal label: vec_id, n_links, component_id, kept.

    A vector is scaled by a power of two before its norm is taken, so tiny and huge ones keep their direction.

    vectors: vec_id (long), embedding (array of numbers), label; other columns are ignored. Two vectors link
    if their labels are equal and not null, they are as long as each other, and their cosine in double precision is
    at least ``threshold``. Vectors that are null, empty or zero, or hold a null or a component that isn't finite, and rows with a null vec_id link
    with nothing. n_links counts the other rows linked directly; component_id is the smallest vec_id
    reachable, itself included; kept says whether that is its own. Repeated rows link like any two
    equal vectors, and each returns; rows of one vec_id share the result. No rows give no rows. ``recall`` is the least expected recall of a pair exactly at the threshold; nearer pairs are likelier found.
    """
    spark = vectors.sparkSession
    window, count, strip = calibrate(threshold, directions, width, recall)
    scratch = Scratch(spark, "vectors")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, found = _valid(batch.column("embedding").to_pandas())
            raw = [x.astype("<f8").tobytes() for x in found]
            strips = [int(math.floor((x / np.linalg.norm(x)) @ _directions(len(x), directions + 1, seed)[:, -1] / strip)) for x in found]
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array([len(x) for x in found], pa.int32()), pa.array(strips, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "size", "strip", "raw"])

    kind = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    rows = vectors.where("vec_id is not null and label is not null").select("vec_id", "label", "embedding")
    usable = scratch.write(rows.mapInArrow(prepare, f"vec_id {kind['vec_id']}, label {kind['label']}, size int, strip int, raw binary"))
    classes = scratch.write(usable.groupBy("label", "size", "strip", "raw").agg(F.min("vec_id").alias("class"), F.count("*").alias("copies")))

    strips = classes.groupBy("label", "size", "strip").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    blocks = strips.select("label", "size", "strip", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    here = blocks.select("label", "size", F.col("strip").alias("s1"), F.col("block").alias("b1"), F.explode(F.array("strip", F.col("strip") + 1)).alias("s2"))
    there = blocks.select("label", "size", F.col("strip").alias("s2"), F.col("block").alias("b2"))
    pairs = here.join(there, ["label", "size", "s2"]).where("s1 <> s2 or b1 <= b2").withColumn("pair", F.xxhash64("label", "size", "s1", "b1", "s2", "b2"))
    first = F.struct(F.col("s1").alias("strip"), F.col("b1").alias("block"), F.lit(1).alias("side"))
    second = F.struct(F.col("s2").alias("strip"), F.col("b2").alias("block"), F.lit(2).alias("side"))
    alone = (F.col("s1") == F.col("s2")) & (F.col("b1") == F.col("b2"))
    sides = pairs.select("label", "size", "pair", F.explode(F.when(alone, F.array(first)).otherwise(F.array(first, second))).alias("x")).select("label", "size", "pair", "x.*")
    placed = classes.join(strips, ["label", "size", "strip"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
    sent = placed.join(sides, ["label", "size", "strip", "block"]).select("label", "size", "pair", "side", "class", "copies", "raw")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        vector = np.frombuffer(b"".join(pdf.raw), "<f8").reshape(len(pdf), -1)
        vector = vector / np.linalg.norm(vector, axis=1, keepdims=True)
        projected = vector @ _directions(vector.shape[1], directions + 1, seed)[:, :directions]
        pdf = pdf.assign(vector=list(vector), projections=list(projected.astype(np.float32))).sort_values("class")
        a, b = pdf[pdf.side == 1], pdf[pdf.side == 2]
        own = not len(b)
        b = a if own else b
        i, j = _links(a, b, window, count, threshold) if len(a) else (np.empty(0, int),) * 2
        if own:
            i, j = i[i < j], j[i < j]
        left, right = a["class"].to_numpy()[i], b["class"].to_numpy()[j]
        degree = pd.concat([pd.Series(b.copies.to_numpy()[j]).groupby(left).sum(), pd.Series(a.copies.to_numpy()[i]).groupby(right).sum()])
        ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        at_i, at_j, label = at[: len(i)], at[len(i) :], np.arange(len(ids))
        while len(i):
            low, new = np.minimum(label[at_i], label[at_j]), label.copy()
            for k in (at_i, at_j, label[at_i], label[at_j]):
                np.minimum.at(new, k, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        root = dict(zip(ids, ids[label]))
        return pd.DataFrame({"a": degree.index.to_numpy(np.int64), "b": np.array([root[x] for x in degree.index], np.int64), "n": degree.to_numpy(np.int64)})

    found = scratch.write(sent.groupBy("label", "size", "pair").applyInPandas(compare, "a long, b long, n long"))
    joined = components(spark, found.where("a <> b").select("a", "b"), Scratch(spark, "vector-links"))
    degree = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    per_class = classes.join(degree, "class", "left").join(joined.withColumnRenamed("id", "class"), "class", "left")
    per_class = per_class.select("label", "size", "strip", "raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class").alias("component_id"))
    linked = usable.join(per_class, ["label", "size", "strip", "raw"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "vec_id")
    return vectors.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )
