"""Vector expressions and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query batches up to this many numbers are broadcast; larger ones meet the rows in blocks of these sizes.
BROADCAST_NUMBERS = 4_000_000
QUERY_BLOCK, ROW_BLOCK = 1024, 8192
#: More than two computations of one cosine differ by.
ROUNDING = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity(a: Column, b: Column) -> Column:
    """Cosine in double precision; null with a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, by: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k of each group; partial limits run before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of the rows from left to right, as `dot` has them, whatever rows stand beside."""
    return np.add.accumulate(x, axis=1)[:, -1]


def _best(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, place of a row and similarity of all that can be among a query's first k in this block, equal ones by id.

    One matrix product rules out what is less like a query than the k-th by more than
    rounding; the rest is computed again in the order of `similarity`.
    """
    own_norm, norms = np.sqrt(_summed(q * q)), np.sqrt(_summed(x * x))
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = np.nan_to_num((q @ x.T) / (own_norm[:, None] * norms[None, :]), nan=-np.inf)  # a zero vector has none
    by_id = np.empty(len(ids), np.int64)
    by_id[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
    out = []
    for i in range(len(q)):
        near = np.flatnonzero(rough[i] >= least[i] - ROUNDING)
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = _summed(x[near] * q[i]) / (norms[near] * own_norm[i])
        first = np.lexsort((by_id[near], -np.nan_to_num(sim, nan=-np.inf)))[:k]
        out.append((np.repeat(qid[i], len(first)), near[first], sim[first]))
    which, near, sim = map(np.concatenate, zip(*out, strict=True))
    return which, near, sim


def nearest(queries: DataFrame, rows: DataFrame, k: int, blocks: bool | None = None) -> DataFrame:
    """query_id, id, similarity, rank: the k rows of each query's collective most like it.

    queries: query_id, collective_id, embedding; rows: id, collective_id, embedding.
    A batch of bounded size is broadcast to the rows' Arrow batches.  Of a larger one,
    blocks of a collective's queries meet blocks of its rows: R rows and Q queries go
    to tasks as R * Q / QUERY_BLOCK + Q * R / ROW_BLOCK rows.  Both give the same;
    `blocks` asks for one of them.
    """
    kinds = dict(queries.dtypes) | {"id": dict(rows.dtypes)["id"]}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double"
    if blocks is None:
        width = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
        blocks = width[0] * (width[1] or 0) > BROADCAST_NUMBERS
    if blocks:
        scored = _in_blocks(queries, rows, k, schema)
    else:
        held = queries.select("query_id", "collective_id", "embedding").toPandas()
        shared = rows.sparkSession.sparkContext.broadcast({c: (g["query_id"].to_numpy(), np.stack(g["embedding"]).astype(float)) for c, g in held.groupby("collective_id")})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for b in batches:
                coll = np.array(b.column("collective_id").to_pylist(), object)
                ids = np.array(b.column("id").to_pylist(), object)
                vectors = b.column("embedding").to_pylist()
                for c in set(coll.tolist()) & own.keys():
                    at = np.flatnonzero(coll == c)
                    which, near, sim = _best(*own[c], ids[at], np.array([vectors[i] for i in at], float), k)
                    yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(ids[at][near].tolist()), pa.array(sim, mask=np.isnan(sim))], names=["query_id", "id", "similarity"])

        scored = rows.select("id", "collective_id", "embedding").mapInArrow(run, schema)
    return top_per(scored, ["query_id"], k, F.desc("similarity"), F.asc("id"))


def _in_blocks(queries: DataFrame, rows: DataFrame, k: int, schema: str) -> DataFrame:
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("collective_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    n = blocks(rows, ROW_BLOCK, "row_blocks").join(blocks(queries, QUERY_BLOCK, "query_blocks"), "collective_id")
    left = queries.select("query_id", "collective_id", "embedding").join(n, "collective_id").withColumn("j", F.pmod(F.xxhash64("query_id"), "query_blocks").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    right = rows.select("id", "collective_id", "embedding").join(n, "collective_id").withColumn("i", F.pmod(F.xxhash64("id"), "row_blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))

    def run(t: pa.Table) -> pa.Table:
        role = t.column("is_query").to_numpy(zero_copy_only=False)
        q, r = t.filter(pa.array(role)), t.filter(pa.array(~role))
        if not len(q) or not len(r):
            return t.slice(0, 0).select(["query_id", "id"]).append_column("similarity", pa.array([], pa.float64()))
        qid, ids = (np.array(x.column(c).to_pylist(), object) for x, c in ((q, "query_id"), (r, "id")))
        which, near, sim = _best(qid, np.array(q.column("embedding").to_pylist(), float), ids, np.array(r.column("embedding").to_pylist(), float), k)
        return pa.table({"query_id": pa.array(which.tolist(), t.schema.field("query_id").type), "id": pa.array(ids[near].tolist(), t.schema.field("id").type), "similarity": pa.array(sim, mask=np.isnan(sim))})

    key, x = ["collective_id", "i", "j"], F.col("embedding").cast("array<double>").alias("embedding")
    both = left.select(*key, F.lit(True).alias("is_query"), "query_id", x).unionByName(right.select(*key, F.lit(False).alias("is_query"), "id", x), allowMissingColumns=True)
    return both.groupBy(*key).applyInArrow(run, schema)


def mean_vector(df: DataFrame, by: list[str], vector: str = "embedding", out: str = "embedding") -> DataFrame:
    """Element-wise mean of each group's vectors."""
    parts = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out))


def recall_at(found: DataFrame, truth: DataFrame, by: str, k: int) -> DataFrame:
    """Share of each query's k true neighbours that were found."""
    hits = truth.join(found, [by, "id"], "left_semi").groupBy(by).agg(F.count(F.lit(1)).alias("hits"))
    return truth.select(by).distinct().join(hits, by, "left").select(by, (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def block_products(rows: DataFrame, block_rows: int = 1024) -> DataFrame:
    """a, b, similarity of all pairs a < b of a collective, by products of blocks.

    rows: id, collective_id, embedding.  A collective of R rows goes to tasks as
    R * R / block_rows rows; the pairs themselves are what was asked for.
    """
    sizes = rows.groupBy("collective_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "collective_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("collective_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "embedding")
    kind = dict(rows.dtypes)["id"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = np.array(t.column("embedding").to_pylist(), float)
        block = t.column("block").to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            sim = x @ x.T
        keep = np.triu(np.ones(sim.shape, bool), 1)
        if t.column("i")[0].as_py() != t.column("j")[0].as_py():
            keep &= block[:, None] != block[None, :]
        a, b = np.nonzero(keep)
        ids = t.column("id").combine_chunks()
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "similarity": pa.array(sim[a, b], mask=np.isnan(sim[a, b]))})

    return dealt.groupBy("collective_id", "i", "j").applyInArrow(run, f"a {kind}, b {kind}, similarity double")


def bucketed(df: DataFrame, key: str, tables: int, bucket: float, seed: int) -> DataFrame:
    """key, collective_id, embedding, slot: a row for each table's bucket of a random projection of the unit vector."""
    kind = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng_of: dict[int, np.ndarray] = {}
        for b in batches:
            slots: list[list[int]] = []
            for v in b.column("embedding").to_pylist():
                x = np.array(v, float)
                n = np.sqrt((x * x).sum())
                if len(x) not in rng_of:
                    d = np.random.default_rng(seed).normal(size=(tables, len(x)))
                    rng_of[len(x)] = d / np.sqrt((d * d).sum(1, keepdims=True))
                slots.append([] if not n else [int(h) * tables + t for t, h in enumerate(np.floor(rng_of[len(x)] @ (x / n) / bucket))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slots, pa.list_(pa.int64()))], names=[*b.schema.names, "slots"])

    schema = f"{key} {kind[key]}, collective_id {kind['collective_id']}, embedding {kind['embedding']}, slots array<bigint>"
    return df.select(key, "collective_id", "embedding").mapInArrow(run, schema).withColumn("slot", F.explode("slots")).drop("slots")


def lsh_candidates(queries: DataFrame, rows: DataFrame, k: int, tables: int = 8, bucket: float = 0.8, seed: int = 3) -> DataFrame:
    """Approximate neighbours by buckets of random projections: rows of the query's collective that share a bucket (`nearest` is exact)."""
    q = bucketed(queries, "query_id", tables, bucket, seed).select("query_id", "collective_id", "slot")
    hits = q.join(bucketed(rows, "id", tables, bucket, seed).select("id", "collective_id", "slot"), ["collective_id", "slot"]).select("query_id", "id").distinct()
    scored = hits.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(rows.select("id", "embedding"), "id").select("query_id", "id", similarity(F.col("embedding"), F.col("q")).alias("similarity"))
    return top_per(scored, ["query_id"], k, F.desc("similarity"), F.asc("id"))


class Cells:
    """An approximate index: each collective's space in cells around centres, of which a query looks at the nearest.

    Centres are fitted in a task of their own on a bounded sample of each collective;
    every row lies in the cell of its nearest centre.
    """

    def __init__(self, rows: DataFrame, cell_rows: int = 256, most_cells: int = 1024, sample_rows: int = 16_384, steps: int = 8, seed: int = 3):
        kind = dict(rows.dtypes)

        def fit(t: pa.Table) -> pa.Table:
            x = np.array([v for _, v in sorted(zip(t.column("id").to_pylist(), t.column("embedding").to_pylist(), strict=True))], float)
            x = x[(x * x).sum(1) > 0]
            x = x / np.sqrt((x * x).sum(1, keepdims=True))
            n = int(min(most_cells, max(1, t.column("n")[0].as_py() // cell_rows), max(1, len(x))))
            c = x[np.random.default_rng(seed).choice(len(x), n, replace=False)] if len(x) else np.zeros((1, 1))
            for _ in range(steps if len(x) else 0):
                near = (x @ c.T).argmax(1)
                sums = np.zeros_like(c)
                np.add.at(sums, near, x)
                size = np.sqrt((sums * sums).sum(1, keepdims=True))
                c = np.where(size > 0, sums / np.where(size > 0, size, 1), c)
            return pa.table({"collective_id": t.column("collective_id").slice(0, 1), "centres": pa.array([c.tolist()], pa.list_(pa.list_(pa.float64())))})

        sizes = rows.groupBy("collective_id").agg(F.count(F.lit(1)).alias("n"))
        sample = rows.select("id", "collective_id", "embedding").join(sizes, "collective_id").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n")) * (1 << 30))
        self.centres = sample.groupBy("collective_id").applyInArrow(fit, f"collective_id {kind['collective_id']}, centres array<array<double>>").cache()
        self.rows = self._placed(rows, "id", 1)

    def _placed(self, df: DataFrame, key: str, probes: int) -> DataFrame:
        """A row for each of the `probes` cells nearest to a vector."""
        kind = dict(df.dtypes)

        def run(t: pa.Table) -> pa.Table:
            of = t.column("centres").to_pylist()
            left = t.filter(pa.array([c is None for c in of]))
            centres = next((c for c in of if c is not None), None)
            cells: list[list[int]] = [[] for _ in range(len(left))]
            if centres is not None and len(left):
                c, x = np.array(centres, float), np.array(left.column("embedding").to_pylist(), float)
                cells = (np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes] if x.shape[1] == c.shape[1] else np.zeros((len(left), 1), int)).tolist()
            return left.select([key, "collective_id", "embedding"]).append_column("cells", pa.array(cells, pa.list_(pa.int64())))

        # a collective's rows are dealt over tasks; its centres go along
        parts = 64
        dealt = df.select(key, "collective_id", "embedding").withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        both = dealt.unionByName(self.centres.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), allowMissingColumns=True)
        schema = f"{key} {kind[key]}, collective_id {kind['collective_id']}, embedding {kind['embedding']}, cells array<bigint>"
        return both.groupBy("collective_id", "part").applyInArrow(run, schema).withColumn("cell", F.explode("cells")).drop("cells")

    def nearest(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """query_id, id, similarity, rank among the rows in the query's nearest cells."""
        q = self._placed(queries, "query_id", probes).select("query_id", "collective_id", "cell", F.col("embedding").alias("q"))
        scored = self.rows.join(q, ["collective_id", "cell"]).select("query_id", "id", similarity(F.col("embedding"), F.col("q")).alias("similarity"))
        return top_per(scored, ["query_id"], k, F.desc("similarity"), F.asc("id"))
