"""Connected components of link tables, without gathering links anywhere.

Each Arrow batch of links first shrinks to a forest.  Then large-star and
small-star rounds alternate until nothing changes; each round is a written table
in the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.runtime import join_hot, written


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a and b, pair by pair; label[x] <= x leads to the smallest member of x's set, and does so in one step after."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each stretch of links: x's smallest known relative, where there is one."""
    for rows in batches:
        nodes, place = np.unique(np.concatenate([rows.column("a").to_numpy(), rows.column("b").to_numpy()]), return_inverse=True)
        label = np.arange(len(nodes))
        merge_labels(label, place[: len(rows)], place[len(rows) :])
        some = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(nodes[label[some]], pa.int64())], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours move to the smallest one; a > b in all rows, before and after.  A hub's rows are dealt over tasks."""
    near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    moved = join_hot(near.where(F.col("b") > F.col("a")), least, "a", "n", 2 * edges.count())
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours, of which a node has few, move to the smallest one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m")).where(F.col("x") != F.col("m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node with a link; links: a, b long."""
    # what finds the links may run in Python too: written first, so that no task holds two workers
    found = written(links.select("a", "b").where(F.col("a") != F.col("b")), "found")
    edges = written(found.mapInArrow(_forest, "a long, b long"), "forest")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    if not edges.isEmpty():
        before = None
        while True:
            edges = written(_small_star(_large_star(edges)), "stars")
            now = state(edges)
            if now == before:
                break
            before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
