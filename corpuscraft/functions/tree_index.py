"""An index of the dependency tree of a sentence, built once for all its tokens and all pairs of its row.

Sentences of a batch are one forest of numbered nodes. Powers of two of the step to the parent (binary lifting) give every
node's depth and the lowest common ancestor of any pair in about log2(depth) steps; what is written out then costs its
length. Functions take and return array columns. A token whose way up ends in a cycle has no path to any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import col

#: Bytes of an Arrow batch, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
NEAR = ("lmc", "lnc", "rnc", "rmc", "lns", "rns")


def batched(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of BATCH_BYTES at most. Sets the session's bound if it is higher."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str(2**31 - 1))) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def _rows(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's items begin (and the last end), and all items."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lists.flatten()


def _lists(begins: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values.astype(np.int32)))


class Forest:
    """The trees of a batch of sentences. Node ``n`` (their number) stands for the wall and whatever is no token."""

    def __init__(self, parents: pa.Array):
        self.begins, heads = _rows(parents)
        heads = heads.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, size = len(heads), np.diff(self.begins)
        self.base = np.repeat(self.begins[:-1], size)
        inside = (heads >= 0) & (heads < np.repeat(size, size))
        self.up = np.append(np.where(inside, heads + self.base, self.n), self.n)
        self.lifts = [self.up]
        self.depth = np.append((self.up[:-1] < self.n).astype(np.int64), 0)
        for _ in range(int(size.max() if len(size) else 0).bit_length()):
            above = self.lifts[-1]
            if (above == self.n).all():
                break
            self.depth = self.depth + self.depth[above]
            self.lifts.append(above[above])
        self.cyclic = self.lifts[-1] != self.n

    def nodes(self, row: np.ndarray, tok: np.ndarray) -> np.ndarray:
        """The nodes of tokens of rows; the wall for a token that isn't there or goes up in a cycle."""
        ok = (tok >= 0) & (tok < np.diff(self.begins)[row])
        node = np.where(ok, self.begins[row] + tok, self.n)
        return np.where(self.cyclic[node], self.n, node)

    def lca(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest common ancestor of pairs of nodes; the wall if there is none."""
        apart = self.depth[a] - self.depth[b]
        a, b = np.where(apart >= 0, a, b), np.where(apart >= 0, b, a)
        apart = np.abs(apart)
        for k, lift in enumerate(self.lifts):
            a = np.where(apart >> k & 1, lift[a], a)
        for lift in reversed(self.lifts):
            x, y = lift[a], lift[b]
            a, b = np.where(x != y, x, a), np.where(x != y, y, b)
        return np.where(a == b, a, self.up[a])

    def climb(self, start: np.ndarray, steps: np.ndarray, out: np.ndarray, at: np.ndarray, way: int) -> None:
        """Writes the nodes from ``start`` over ``steps`` steps up to out[at], and on in direction ``way``. Takes as long as what it writes."""
        order = np.argsort(-steps, kind="stable")
        left = np.sort(steps)
        node = start[order]
        for t in range(int(left[-1]) if len(left) else 0):
            n = len(left) - int(np.searchsorted(left, t, "right"))
            order, node = order[:n], node[:n]
            out[at[order] + way * t] = node
            node = self.up[node]


def paths(parents: Column | str, pairs: Column, above: bool = False) -> Column:
    """For each of a row's pairs (a struct of two tokens) the way from the first to the second over the tree.

    An array of struct(toks, top, above), as pairs has: the tokens of the path, which place among them the lowest common one has (up to
    which steps go up, from which down), and, if asked for, the tokens from it up to the child of the wall. toks is null if there is no path.
    """
    kind = "array<struct<toks: array<int>, top: int, above: array<int>>>"

    @F.arrow_udf(kind)
    def find(parents: pa.Array, pairs: pa.Array) -> pa.Array:
        forest = Forest(parents)
        begins, items = _rows(pairs)
        row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        first, second = (items.field(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        a, b = forest.nodes(row, first), forest.nodes(row, second)
        top = forest.lca(a, b)
        none = top == forest.n
        up, down = (np.where(none, -1, forest.depth[x] - forest.depth[top]) for x in (a, b))
        base = forest.begins[row]

        def lists(sizes: np.ndarray, fill) -> pa.ListArray:
            at = np.concatenate([[0], np.cumsum(sizes)])
            out = np.zeros(int(at[-1]), np.int64)
            fill(out, at)
            return _lists(at, out - np.repeat(base, sizes))

        def fill_path(out: np.ndarray, at: np.ndarray) -> None:
            forest.climb(a, up + 1, out, at[:-1], 1)
            forest.climb(b, np.where(none, 0, down), out, at[1:] - 1, -1)

        toks = lists(np.where(none, 0, up + down + 1), fill_path)
        toks = pa.ListArray.from_arrays(pa.array(toks.offsets.to_numpy(), pa.int32(), mask=np.append(none, False)), toks.values) if none.any() else toks
        way = lists(np.where(none, 0, forest.depth[top] + 1), lambda out, at: forest.climb(top, np.where(none, 0, forest.depth[top] + 1), out, at[:-1], 1)) if above else pa.nulls(len(row), pa.list_(pa.int32()))
        return _lists(begins, pa.StructArray.from_arrays([toks, pa.array(np.where(none, 0, up).astype(np.int32)), way], ["toks", "top", "above"]))

    return find(col(parents), pairs)


def _ends(forest: Forest, pairs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of a batch: where each row's begin, their rows, both nodes, the lowest common one, and whether there is none."""
    begins, items = _rows(pairs)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    a, b = (forest.nodes(row, items.field(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)) for i in (0, 1))
    top = forest.lca(a, b)
    return begins, row, a, b, top, top == forest.n


def _nodes_along(forest: Forest, source: str, a: np.ndarray, b: np.ndarray, top: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the paths of a source, where each path begins among them (and the last ends), and how many steps of each go up."""
    up, down, root = (np.where(none, 0, x) for x in (forest.depth[a] - forest.depth[top], forest.depth[b] - forest.depth[top], forest.depth[top] + 1))
    there = (~none).astype(np.int64)
    size = {"path": up + down + 1, "path_p_lca": up + 1, "path_c_lca": down + 1, "path_lca_root": root + 1}[source] * there
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(at[-1]), forest.n, np.int64)  # what stays is the wall at a root's end
    if source == "path":
        forest.climb(a, (up + 1) * there, out, at[:-1], 1)
        forest.climb(b, down, out, at[1:] - 1, -1)
    else:
        first, steps = {"path_p_lca": (a, up + 1), "path_c_lca": (b, down + 1), "path_lca_root": (top, root)}[source]
        forest.climb(first, steps * there, out, at[:-1], 1)
    return out, at, up if source == "path" else size


def _nested(begins: np.ndarray, at: np.ndarray, none: np.ndarray, values: pa.Array) -> pa.Array:
    """Rows of lists of texts; null where there is no path."""
    return _lists(begins, pa.ListArray.from_arrays(pa.array(at, pa.int32(), mask=np.append(none, False)), values))


def path_texts(parents: Column | str, pairs: Column, layer: Column, source: str, edge: str = "", rels: Column | str | None = None) -> Column:
    """For each of a row's pairs the texts along a path (see paths): array of arrays, null where there is no path.

    source: path, path_p_lca, path_c_lca (from either end up to the lowest common token) or path_lca_root (from there to the wall, BOS). layer: a text for each token, or null
    for one that has none. edge: between two tokens also UP or DOWN (dir) or the relation of the lower one (rel); then layer may be null for edges alone.
    """

    @F.arrow_udf("array<array<string>>")
    def find(parents: pa.Array, pairs: pa.Array, layer: pa.Array, rels: pa.Array) -> pa.Array:
        forest = Forest(parents)
        begins, _, a, b, top, none = _ends(forest, pairs)
        node, at, ups = _nodes_along(forest, source, a, b, top, none)
        texts = pa.concat_arrays([_rows(layer)[1].cast(pa.string()), pa.array(["BOS"])]) if len(layer.flatten()) == forest.n else None
        path = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(node)) - at[path]
        pieces, keys = [], []
        if texts is not None:
            pieces.append(texts.take(pa.array(node)))
            keys.append(2 * np.arange(len(node)))
        if edge:
            inner = np.flatnonzero(place < (at[1:] - at[:-1])[path] - 1)
            upward = place[inner] < ups[path[inner]]
            if edge == "dir":
                pieces.append(pa.array(["DOWN", "UP"]).take(pa.array(upward.astype(np.int32))))
            else:
                low = np.where(upward, node[inner], node[np.minimum(inner + 1, len(node) - 1)])
                pieces.append(pa.concat_arrays([_rows(rels)[1].cast(pa.string()), pa.nulls(1, pa.string())]).take(pa.array(low)))
            keys.append(2 * inner + 1)
        values = pa.concat_arrays(pieces) if pieces else pa.array([], pa.string())
        key = np.concatenate([*keys, np.empty(0, np.int64)])
        order = np.argsort(key, kind="stable") if len(keys) > 1 else np.arange(len(key))
        order = order[values.is_valid().to_numpy(zero_copy_only=False)[order]]
        of = path[key[order] // 2]
        return _nested(begins, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(at) - 1))]), none, values.take(pa.array(order)))

    empty = F.lit(None).cast("array<string>")
    return find(col(parents), pairs, layer, col(rels) if rels is not None else empty)


def path_grams(parents: Column | str, pairs: Column, words: Column | str, pos: Column | str) -> Column:
    """For each of a row's pairs all 1-, 2- and 3-grams along its path with every choice of word or tag at each place; null where there is no path."""

    @F.arrow_udf("array<array<string>>")
    def find(parents: pa.Array, pairs: pa.Array, words: pa.Array, pos: pa.Array) -> pa.Array:
        forest = Forest(parents)
        begins, _, a, b, top, none = _ends(forest, pairs)
        node, at, _ = _nodes_along(forest, "path", a, b, top, none)
        path = np.repeat(np.arange(len(at) - 1), np.diff(at))
        left = at[1:][path] - np.arange(len(node))  # tokens from here to the path's end
        layers = [_rows(x)[1].cast(pa.string()).fill_null("").take(pa.array(node)) for x in (words, pos)]
        pieces, of = [pa.array([], pa.string())], [np.empty(0, np.int64)]
        for n in (1, 2, 3):
            first = np.flatnonzero(left >= n)
            for pattern in range(2**n):
                parts = [layers[pattern >> k & 1].take(pa.array(first + k)) for k in range(n)]
                pieces.append(pc.binary_join_element_wise(*parts, "_") if n > 1 else parts[0])
                of.append(path[first])
        of, values = np.concatenate(of), pa.concat_arrays(pieces)
        order = np.argsort(of, kind="stable")
        return _nested(begins, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(at) - 1))]), none, values.take(pa.array(order)))

    return find(col(parents), pairs, col(words), col(pos))


def near(parents: Column | str) -> Column:
    """For all tokens, their leftmost and nearest left child, nearest right and rightmost child (-2: none) and nearest siblings (left -1, right the length): a struct of arrays by NEAR."""

    @F.arrow_udf("struct<" + ", ".join(f"{k}: array<int>" for k in NEAR) + ">")
    def find(parents: pa.Array) -> pa.Array:
        begins, heads = _rows(parents)
        heads = heads.fill_null(-3).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(begins)
        n, row = len(heads), np.repeat(np.arange(len(size)), size)
        tok = np.arange(n) - begins[row]
        found = {k: np.full(n, -2, np.int64) for k in NEAR[:4]} | {"lns": np.full(n, -1, np.int64), "rns": size[row]}
        child = np.flatnonzero((heads >= 0) & (heads < size[row]))
        head = heads[child] + begins[row[child]]
        left, right = tok[child] < heads[child], tok[child] > heads[child]
        for k, side, backwards in (("lmc", left, True), ("lnc", left, False), ("rnc", right, True), ("rmc", right, False)):
            to, who = head[side], tok[child[side]]
            found[k][to[::-1] if backwards else to] = who[::-1] if backwards else who  # the last that is written stays
        # siblings: by parent (the wall's children, and those without a head, are siblings too), then by place
        order = np.lexsort((tok, heads, row))
        one, two = order[:-1], order[1:]
        same = (row[one] == row[two]) & (heads[one] == heads[two]) & (heads[one] != -3)
        found["lns"][two[same]], found["rns"][one[same]] = tok[one[same]], tok[two[same]]
        return pa.StructArray.from_arrays([_lists(begins, found[k]) for k in NEAR], list(NEAR))

    return find(col(parents))


def children_of_all(parents: Column | str) -> Column:
    """The children of every token, in order: array of arrays."""

    @F.arrow_udf("array<array<int>>")
    def find(parents: pa.Array) -> pa.Array:
        begins, heads = _rows(parents)
        heads = heads.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(begins)
        row = np.repeat(np.arange(len(size)), size)
        child = np.flatnonzero((heads >= 0) & (heads < size[row]))
        head = heads[child] + begins[row[child]]
        counts = np.bincount(head, minlength=len(heads))
        order = np.argsort(head, kind="stable")
        return _lists(begins, _lists(np.concatenate([[0], np.cumsum(counts)]), child[order] - begins[row[child[order]]]))

    return find(col(parents))


def turned(heads: Column | str) -> Column:
    """From the heads of every token (-1: the wall) the tokens of every head, the wall's first: array of arrays, each in order."""

    @F.arrow_udf("array<array<int>>")
    def find(heads: pa.Array) -> pa.Array:
        begins, lists = _rows(heads)
        to, flat = _rows(lists)
        size = np.diff(begins)
        base = begins[:-1] + np.arange(len(size))  # a row of n tokens has n + 1 heads
        node = np.repeat(np.arange(len(to) - 1), np.diff(to))
        row = np.repeat(np.arange(len(size)), size)
        at = base[row[node]] + flat.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        counts = np.bincount(at, minlength=int(size.sum()) + len(size))
        order = np.argsort(at, kind="stable")
        tokens = (node - begins[row[node]])[order]
        return _lists(np.append(base, int(size.sum()) + len(size)), _lists(np.concatenate([[0], np.cumsum(counts)]), tokens))

    return find(col(heads))


def supports(parents: Column | str, flags: Column) -> Column:
    """For every token the first and the last on its way up, itself included, that is flagged (-1: none): struct of arrays low and high."""

    @F.arrow_udf("struct<low: array<int>, high: array<int>>")
    def find(parents: pa.Array, flags: pa.Array) -> pa.Array:
        forest = Forest(parents)
        own = np.append(_rows(flags)[1].fill_null(False).to_numpy(zero_copy_only=False).astype(bool), False)
        low = np.where(own, np.arange(forest.n + 1), forest.n)
        high = low.copy()
        for lift in forest.lifts:  # what is known covers 1, 2, 4, ... steps
            low, high = np.where(low == forest.n, low[lift], low), np.where(high[lift] != forest.n, high[lift], high)
        base = forest.base
        return pa.StructArray.from_arrays([_lists(forest.begins, np.where(x[:-1] == forest.n, -1, x[:-1] - base)) for x in (low, high)], ["low", "high"])

    return find(col(parents), flags)


def positions(ids: Column | str, wanted: Column | str) -> Column:
    """For each wanted value its place in ``ids``, an array in ascending order; -1 if it isn't there or is null."""

    @F.arrow_udf("array<int>")
    def find(ids: pa.Array, wanted: pa.Array) -> pa.Array:
        begins, known = _rows(ids)
        to, asked = _rows(wanted)
        known = known.to_numpy(zero_copy_only=False).astype(np.int64)
        null = asked.is_null().to_numpy(zero_copy_only=False)
        asked = asked.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, own = np.repeat(np.arange(len(to) - 1), np.diff(to)), np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        # both as (row, rank of the value), so that one search serves all rows
        values = np.unique(known)
        rank = np.searchsorted(values, asked)
        there = (rank < len(values)) & (np.append(values, 0)[np.minimum(rank, max(0, len(values) - 1))] == asked) & ~null if len(values) else np.zeros(len(asked), bool)
        keys = own * (len(values) + 1) + np.searchsorted(values, known)
        key = row * (len(values) + 1) + rank
        at = np.searchsorted(keys, key)
        there &= np.append(keys, -1)[np.minimum(at, len(keys))] == key
        return _lists(to, np.where(there, at - begins[row], -1))

    return find(col(ids), col(wanted))


def intervals(parents: Column | str) -> Column:
    """The nested-set numbers of all tokens: struct of arrays begin and end. A token lies below another, or is it, if its begin is in the other's [begin, end).

    The wall's children follow one another. Tokens whose way up is a cycle have -1.
    """

    @F.arrow_udf("struct<begin: array<int>, end: array<int>>")
    def find(parents: pa.Array) -> pa.Array:
        forest = Forest(parents)
        n, up = forest.n, forest.up
        size = np.append(np.ones(n, np.int64), 0)
        order = np.argsort(np.where(forest.cyclic[:-1], -1, forest.depth[:-1]), kind="stable")
        depth = np.where(forest.cyclic[:-1], -1, forest.depth[:-1])[order]
        cuts = np.searchsorted(depth, np.arange(-1, int(depth[-1] if n else -1) + 2))
        levels = [order[a:b] for a, b in zip(cuts[1:-1], cuts[2:])]
        for level in reversed(levels[1:]):
            np.add.at(size, up[level], size[level])
        begin = np.full(n + 1, -1, np.int64)
        for k, level in enumerate(levels):
            # siblings lie together by parent (the roots by sentence), each after what the ones before it take
            group = up[level] if k else forest.base[level]
            level = level[np.argsort(group, kind="stable")]
            group = np.sort(group, kind="stable")
            before = np.cumsum(size[level]) - size[level]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            own = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(level))))
            begin[level] = own + (begin[up[level]] + 1 if k else 0)
        begin, size = begin[:-1], size[:-1]
        return pa.StructArray.from_arrays([_lists(forest.begins, begin), _lists(forest.begins, np.where(begin < 0, -1, begin + size))], ["begin", "end"])

    return find(col(parents))


def chunks(tags: Column | str, parents: Column | str) -> Column:
    """The chunks of BIO tags, every O a chunk of its own: struct(of: each token's chunk, labels, heads: of each the token reached from its first without leaving it)."""

    @F.arrow_udf("struct<of: array<int>, labels: array<string>, heads: array<int>>")
    def find(tags: pa.Array, parents: pa.Array) -> pa.Array:
        begins, flat = _rows(tags)
        tag = np.array(flat.fill_null("O").to_pylist(), object)
        forest = Forest(parents)
        n = len(tag)
        row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
        label = np.array([t[2:] if t[:2] in ("B-", "I-") else t for t in tag], object)
        new = np.ones(n, bool)
        if n:
            inside = np.array([t[:2] == "I-" for t in tag])
            new[1:] = ~(inside[1:] & (label[1:] == label[:-1]) & (row[1:] == row[:-1]) & np.array([t[:2] in ("B-", "I-") for t in tag[:-1]]))
        chunk = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        head, of_row = at.copy(), row[at]
        for _ in range(int(np.diff(np.append(at, n)).max()) if n else 0):
            above = forest.up[head] if len(forest.up) > 1 else np.full(len(head), forest.n)
            stay = above < n
            stay[stay] = chunk[above[stay]] == chunk[head[stay]]
            if not stay.any():
                break
            head = np.where(stay, above, head)
        per = np.concatenate([[0], np.cumsum(np.bincount(of_row, minlength=len(begins) - 1))]) if n else np.zeros(len(begins), np.int64)
        first = per[row]
        return pa.StructArray.from_arrays([_lists(begins, chunk - first), _lists(per, pa.array(label[at].tolist(), pa.string())), _lists(per, head - begins[of_row])], ["of", "labels", "heads"])

    return find(col(tags), col(parents))


def crossing(parents: Column | str, least: int = -1) -> Column:
    """The tokens whose arc to their parent crosses another, in order; the wall (-1) stands left of the first token. Parents under ``least`` are no arcs.

    A sweep over the arcs by their left ends: of two arcs that begin at or before one place the one that
    ends first lies inside, or they cross. Sparse tables of the farthest and nearest ends answer for each arc whether any
    arc that begins inside it ends outside, or any that ends inside begins outside: n log n in all.
    """

    @F.arrow_udf("array<int>")
    def find(parents: pa.Array) -> pa.Array:
        begins, heads = _rows(parents)
        heads = heads.fill_null(-9).to_numpy(zero_copy_only=False).astype(np.int64)
        found = [_crossing(heads[a:b], least) for a, b in zip(begins[:-1], begins[1:])]
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int64)]).astype(np.int32)))
        return out

    return find(col(parents))


def _crossing(heads: np.ndarray, least: int = -1) -> np.ndarray:
    tok = np.flatnonzero(heads >= least)
    low, high = np.minimum(heads[tok], tok) - least, np.maximum(heads[tok], tok) - least  # the least is place 0
    places = len(heads) - least + 1
    far, near_ = np.full(places, -1), np.full(places, places)
    np.maximum.at(far, low, high)  # the farthest right end of arcs that begin at a place
    np.minimum.at(near_, high, low)  # the farthest left end of arcs that end at one
    wide = high - low > 1
    a, b = low[wide] + 1, high[wide] - 1  # the places strictly inside
    k = np.frexp((b - a + 1).astype(float))[1] - 1
    right, left = [far], [near_]
    for j in range(int(k.max()) if len(k) else 0):
        right.append(np.maximum(right[-1], np.append(right[-1][1 << j :], np.full(min(1 << j, places), -1))))
        left.append(np.minimum(left[-1], np.append(left[-1][1 << j :], np.full(min(1 << j, places), places))))
    right, left = np.stack(right), np.stack(left)
    second = b - (1 << k) + 1
    out = (np.maximum(right[k, a], right[k, second]) > high[wide]) | (np.minimum(left[k, a], left[k, second]) < low[wide])
    return np.sort(tok[wide][out])
