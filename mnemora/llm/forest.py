"""Operator 4: near-duplicate vectors by a random-projection tree forest.

Vectors of a label are split at random hyperplanes, again and again, in several
trees.  Of some random directions a node takes the threshold with the fewest
vectors near it; vectors within the margin go both ways, so linked ones seldom
part.  A group's trees are fitted on a bounded sample of it, in a task of its own,
and every vector goes through them; a leaf that is still large is split again on
a sample of its own.  Within leaves all vectors are compared.  A pair counts in
the first leaf that it shares alone, so leaves give counts and spanning links,
never all pairs.  Leaves that no hyperplane splits and that are too large for a
task are compared block against block: rows grow with their blocks there.

Defined results: null, zero, empty, null-holding and non-finite vectors, those
without a label and those without an id link with nothing; so do vectors of
different lengths; equal vectors of a label are one class that counts each of its
rows; a repeated vec_id gives a row for each of its vectors; a vector that links
with nothing is its own component and kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.components import components, merge_labels
from mnemora.llm.runtime import join_hot, only, written

#: Rows that one task places or holds against each other at a time.
TASK_ROWS = 16_384
#: Random directions of a tree, and how many of them a node tries.
POOL, TRIED = 64, 8
#: Share of a node's vectors that may lie within the margin.
NEAR = 0.25
#: Links whose leaf lists are compared at a time.
LINKS_AT_ONCE = 100_000


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def directions(node: int, trees: int, dim: int) -> np.ndarray:
    """The unit directions of a node's trees, POOL each; they follow from the node's number."""
    d = np.random.default_rng(node & (2**63 - 1)).normal(size=(trees * POOL, dim))
    return unit(d)


def grow(p: np.ndarray, rows: float, leaf_rows: int, margin: float, rng: np.random.Generator, least: int = 16, depth: int = 0):
    """A tree over a sample's projections p that stand for so many rows: nested (direction, threshold, left, right), None is a leaf."""
    if rows <= leaf_rows or len(p) < 2 * least or depth >= 40:
        return None
    tried = rng.choice(p.shape[1], TRIED, replace=False)
    own = p[:, tried]
    cuts = np.quantile(own, (0.35, 0.42, 0.5, 0.58, 0.65), axis=0)
    near = (np.abs(own[None] - cuts[:, None, :]) <= margin).mean(1)
    best = np.unravel_index(int(near.argmin()), near.shape)
    if near[best] > NEAR:
        return None
    d, cut = int(tried[best[1]]), float(cuts[best])
    a, b = p[:, d] <= cut + margin, p[:, d] > cut - margin
    return d, cut, grow(p[a], rows * a.mean(), leaf_rows, margin, rng, least, depth + 1), grow(p[b], rows * b.mean(), leaf_rows, margin, rng, least, depth + 1)


def reach(tree, p: np.ndarray, margin: float) -> list[np.ndarray]:
    """The rows of p in each of the tree's leaves, in the leaves' order."""
    out, todo = [], [(tree, np.arange(len(p)))]
    while todo:
        node, rows = todo.pop()
        if node is None:
            out.append(rows)
            continue
        d, cut, left, right = node
        x = p[rows, d]
        todo += [(left, rows[x <= cut + margin]), (right, rows[x > cut - margin])]
    return out


def _leaf_number(node: int, tree: int, k: int) -> int:
    h = np.random.SeedSequence([node & (2**64 - 1), tree, k]).generate_state(1, np.uint64)
    return int(h.view(np.int64)[0])


def _vectors(t: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    column = t.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(at, at[1:], strict=False)]


def _groups(*keys: np.ndarray) -> list[np.ndarray]:
    """Rows of equal keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    return np.split(order, np.flatnonzero(new)) if len(order) else []


class Forest:
    """Places vectors in leaves; all of it is state of tasks, none of the driver's."""

    def __init__(self, trees: int, leaf_rows: int, sample_rows: int, margin: float):
        self.trees, self.leaf_rows, self.sample_rows, self.margin = trees, leaf_rows, sample_rows, margin

    def models(self, rows: DataFrame, trees: int, salt: int) -> DataFrame:
        """node, model, n: trees of each node of rows (cid, embedding, size, node, n), fitted on a sample of it."""
        own = self

        def fit(t: pa.Table) -> pa.Table:
            node, n = t.column("node")[0].as_py(), t.column("n")[0].as_py()
            vectors = [v for _, v in sorted(zip(t.column("cid").to_pylist(), _vectors(t), strict=True), key=lambda x: x[0])]
            dim = min(map(len, vectors))  # one length, but for two labels that share a number
            x = unit(np.array([v for v in vectors if len(v) == dim], np.float64))
            p = x @ directions(node, trees, dim).T
            rng = np.random.default_rng([node & (2**63 - 1), 1])
            grown = [grow(p[:, k * POOL : (k + 1) * POOL], n, own.leaf_rows, own.margin, rng) for k in range(trees)]
            return pa.table({"node": [node], "model": pa.array([pickle.dumps((dim, grown))], pa.binary()), "n": [n]})

        share = F.least(F.lit(1.0), F.lit(float(self.sample_rows)) / F.col("n"))
        sample = rows.where(F.pmod(F.xxhash64("cid", F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30))
        return written(sample.select("cid", "node", "n", "embedding").groupBy("node").applyInArrow(fit, "node long, model binary, n long"), "trees")

    def place(self, rows: DataFrame, trees: int, salt: int) -> DataFrame:
        """The rows (cid, embedding, node, n and others) with `leaves`; nodes are dealt over as many tasks as they need."""
        own, kind = self, dict(rows.dtypes)

        def route(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left):
                return left.append_column("leaves", pa.array([], pa.list_(pa.int64())))
            node = left.column("node")[0].as_py()
            of: list[list[int]] = [[] for _ in range(len(left))]
            if len(right):
                dim, grown = pickle.loads(right.column("model")[0].as_py())
                vectors = _vectors(left)
                at = np.array([i for i, v in enumerate(vectors) if len(v) == dim], np.int64)
                p = unit(np.array([vectors[i] for i in at], np.float64)) @ directions(node, trees, dim).T if len(at) else None
                for k, tree in enumerate(grown if len(at) else []):
                    if tree is None:  # not split: the node is its leaf, in each such tree the same
                        leaves = [(node, np.arange(len(at)))]
                    else:
                        leaves = [(_leaf_number(node, k, i), r) for i, r in enumerate(reach(tree, p[:, k * POOL : (k + 1) * POOL], own.margin))]
                    for leaf, reached in leaves:
                        for i in at[reached].tolist():
                            of[i].append(leaf)
            return left.append_column("leaves", pa.array([sorted(set(x)) or [node] for x in of], pa.list_(pa.int64())))

        tasks = F.ceil(F.col("n") / TASK_ROWS).cast("int")
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("cid"), tasks).cast("int"))
        models = self.models(rows, trees, salt).withColumn("salt", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("n")
        schema = ", ".join(f"{c} {kind.get(c, 'int')}" for c in dealt.columns) + ", leaves array<long>"
        return dealt.groupBy("node", "salt").cogroup(models.groupBy("node", "salt")).applyInArrow(route, schema).drop("salt")


def _valid():
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def _classes(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (vec_id, h1, h2) and classes of equal vectors, with numbers of their own: repeated vec_ids don't mix them."""
    h = [F.xxhash64(F.lit(s), "label", "embedding").alias(f"h{s}") for s in (1, 2)]  # 128 bits
    members = written(valid.select("vec_id", *h), "members")
    grouped = valid.select("vec_id", "label", "embedding", *h).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    return members, written(grouped.withColumn("size", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "vectors")


def _leaves(classes: DataFrame, forest: Forest) -> DataFrame:
    """cid, label, size, copies, embedding, leaves (rising numbers)."""
    total = classes.count()
    rows = classes.select("cid", "label", "size", "copies", "embedding", F.xxhash64("label", "size").alias("node"))
    groups = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "groups")
    sized = join_hot(rows, groups, "node", "n", total)
    whole = sized.where(F.col("n") <= forest.leaf_rows).withColumn("leaves", F.array("node"))
    placed = written(forest.place(sized.where(F.col("n") > forest.leaf_rows), forest.trees, 0).unionByName(whole).drop("node", "n"), "placed")
    # leaves that are still large, split again on samples of their own until none is or none can be
    again, tried, turn = 16 * forest.leaf_rows, None, 0
    while True:
        turn += 1
        counts = placed.select(F.explode("leaves").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > again)
        large = written(counts if tried is None else counts.join(tried, "node", "left_anti"), "large")
        if large.isEmpty():
            return placed
        tried = large.select("node") if tried is None else written(tried.unionByName(large.select("node")), "tried")
        at = join_hot(placed.withColumn("node", F.explode("leaves")).select("cid", "embedding", "node"), large, "node", "n", total)
        new = forest.place(at, 1, turn).groupBy("cid").agg(F.collect_set("node").alias("old"), F.array_distinct(F.flatten(F.collect_list("leaves"))).alias("new"))
        updated = F.when(F.col("old").isNull(), F.col("leaves")).otherwise(F.array_sort(F.array_union(F.array_except("leaves", "old"), "new")))
        placed = written(placed.join(new, "cid", "left").withColumn("leaves", updated).drop("old", "new"), "placed")


def _first_shared(leaves: np.ndarray, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether rows a and b share no leaf before this one; unused places of `leaves` hold the largest number."""
    out = np.ones(len(a), bool)
    if leaves.shape[1] > 1:
        for i in range(0, len(a), LINKS_AT_ONCE):
            x, y = leaves[a[i : i + LINKS_AT_ONCE]], leaves[b[i : i + LINKS_AT_ONCE]]
            out[i : i + LINKS_AT_ONCE] = ~((x[:, :, None] == y[:, None, :]) & (x < leaf)[:, :, None]).any((1, 2))
    return out


def compare(t: pa.Table, threshold: float) -> pa.Table:
    """cid, n (rows linked first in these leaves), root: for rows of one leaf or of several whole ones."""
    cid, copies, leaf, block = (t.column(c).to_numpy() for c in ("cid", "copies", "leaf", "block"))
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    vectors, lists = _vectors(t), t.column("leaves").to_pylist()
    leaves = np.full((len(lists), max(map(len, lists))), 2**63 - 1, np.int64)
    for k, own in enumerate(lists):
        leaves[k, : len(own)] = own
    counts, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
    for rows in _groups(t.column("size").to_numpy(), label, leaf):
        if len(rows) < 2:
            continue
        x = unit(np.array([vectors[k] for k in rows], np.float64))
        now = int(leaf[rows[0]])
        for at in range(0, len(rows), 256):
            hit = x[at : at + 256] @ x.T >= threshold
            hit &= np.arange(len(rows))[None, :] > np.arange(at, at + len(hit))[:, None]
            if i != j:
                hit &= block[rows[at : at + 256], None] != block[rows][None, :]
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            a, b = rows[a + at], rows[b]
            merge_labels(root, a, b)
            new = _first_shared(leaves, a, b, now)
            a, b = a[new], b[new]
            counts += np.bincount(a, copies[b], len(cid)).astype(np.int64) + np.bincount(b, copies[a], len(cid)).astype(np.int64)
    some = np.flatnonzero((counts > 0) | (root != np.arange(len(cid))))
    return pa.table({"cid": pa.array(cid[some], pa.int64()), "n": pa.array(counts[some], pa.int64()), "root": pa.array(cid[root[some]], pa.int64())})


def near_vectors(vectors: DataFrame, threshold: float = 0.98, trees: int = 6, leaf_rows: int = 32, sample_rows: int = 8192, margin: float = 0.01, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept.  sample_rows bounds what a node's trees are fitted on; every vector is indexed."""
    every = only(vectors, vec_id=id_col, label=group_col, embedding=vector_col).withColumn("label", F.col("label").cast("string"))
    if dict(every.dtypes)["embedding"] != "array<float>":
        every = every.withColumn("embedding", F.col("embedding").cast("array<double>"))
    valid = every.where(_valid())
    members, classes = _classes(valid)
    placed = _leaves(classes, Forest(trees, leaf_rows, sample_rows, margin))

    per = placed.withColumn("leaf", F.explode("leaves"))
    counts = written(per.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")), "leaf-sizes")
    total = counts.agg(F.sum("m")).first()[0] or 0
    # whole leaves share tasks; what no hyperplane split and no task holds meets in blocks
    pots = max(1, total // TASK_ROWS)
    dealt = per.withColumn("key", F.pmod("leaf", F.lit(pots))).withColumns({"i": F.lit(0), "j": F.lit(0), "block": F.lit(0)})
    huge = counts.where(F.col("m") > TASK_ROWS // 2).select("leaf", "m")
    if not huge.isEmpty():
        of = join_hot(per, huge, "leaf", "m", total).withColumn("blocks", F.ceil(F.col("m") * 4 / TASK_ROWS).cast("int")).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        of = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).withColumn("key", F.col("leaf"))
        dealt = dealt.join(huge.select("leaf"), "leaf", "left_anti").unionByName(of.select(dealt.columns))
    columns = ["key", "i", "j", "block", "leaf", "cid", "label", "size", "copies", "embedding", "leaves"]
    found = written(dealt.select(columns).groupBy("key", "i", "j").applyInArrow(lambda t: compare(t, threshold), "cid long, n long, root long"), "links")

    linked = written(components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "linked")
    smallest = linked.join(classes.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_linked = linked.join(smallest, "component").select(F.col("node").alias("cid"), "component_id")
    per_class = found.groupBy("cid").agg(F.sum("n").alias("n"))
    of_class = written(classes.select("cid", "h1", "h2", "rep", "copies").join(per_class, "cid", "left").join(of_linked, "cid", "left").select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "of-class")
    out = join_hot(members, of_class, ["h1", "h2"], "copies", members.count()).select("vec_id", "n_links", "component_id")
    alone = every.where(~_valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
