"""Operator 7: a quality classifier.

Statistics of each text go through random Fourier features of a Gaussian kernel;
partitions sum their normal equations, ridge regression solves them, and isotonic
regression on other documents of the sample turns margins into probabilities.

Defined results: a null or empty text has all statistics 0 and the score that
they get; repeated rows get equal scores; without labelled documents every score
is 0; a null doc_id counts as not held out; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.runtime import keep_rows, only, row_blocks
from mnemora.llm.samples import crc_of, labelled_sample

SYMBOLS = "#*$%&|<>"
STATISTICS = ["words", "characters", "word_mean", "word_sd", "short", "symbols", "pipes", "punctuation", "digits", "distinct", "repeats", "line_words", "line_copies", "line_ends", "capitals"]


def statistics(text: str) -> tuple[float, ...]:
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    count = text.count
    total = int(sizes.sum())
    return (
        math.log1p(n),
        math.log1p(len(text)),
        total / n,
        float(sizes.std()),
        float((sizes <= 3).mean()),
        sum(map(count, SYMBOLS)) / total,
        count("|") / n,
        sum(map(count, ".,;:!?")) / n,
        sum(map(count, "0123456789")) / total,
        len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        math.log(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(x.endswith((".", "!", "?")) for x in lines) / len(lines),
        sum(map(str.istitle, words)) / n,
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), z / 10, np.ones((len(z), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(x))
        return np.interp(self.features(x) @ self.beta, self.knots, self.values)


def _moments(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_blocks(batches):
            x = [list(statistics(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label").cast(pa.float64()), rows.column("weight"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "weight", "x"])

    return sample.select("doc_id", "label", "weight", "text").mapInArrow(run, "doc_id long, label double, weight double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 0, modulus: int = 5, per_class: int = 8000, size: int = 256, bandwidth: float = 4.0, ridge: float = 1e-3, seed: int = 7, tasks: int = 8) -> Model:
    """A model from at most per_class training documents of each class, weighted to the classes' own shares."""
    from mnemora.llm.runtime import written

    sample = labelled_sample(docs, labels, label, held_out, modulus, {0: per_class, 1: per_class}, keep_text=False)
    points = written(_moments(sample), "statistics")
    d = len(STATISTICS)
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, 1 / bandwidth, (d, size)), rng.uniform(0, 2 * np.pi, size)
    rows = points.groupBy("label", "weight").agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.var_pop))], F.count(F.lit(1)).alias("n")).collect()  # a row a class
    if not rows:
        return Model(np.zeros(d), np.ones(d), omega, phase, np.zeros(size + d + 1), np.zeros(0), np.zeros(0))
    share = np.array([r["weight"] * r["n"] for r in rows])
    share /= share.sum()
    means, spreads = (np.array([[r[f"{n}{i}"] for i in range(d)] for r in rows]) for n in "ms")
    mean = share @ means
    scale = np.sqrt(share @ (spreads + (means - mean) ** 2))
    model = Model(mean, np.where(scale > 0, scale, 1.0), omega, phase, np.zeros(size + d + 1), np.zeros(0), np.zeros(0))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size + d + 1
        a, b = np.zeros((n, n)), np.zeros(n)
        for rows in batches:
            z = model.features(np.array(rows.column("x").to_pylist()).reshape(-1, d))
            w = z * rows.column("weight").to_numpy()[:, None]
            a += w.T @ z
            b += w.T @ rows.column("label").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    # `tasks` matrices of a fixed size
    parts = points.where(fold != 0).select("label", "weight", "x").repartition(tasks).mapInArrow(sums, "a binary, b binary").collect()
    n = size + d + 1
    a = sum(np.frombuffer(p["a"]).reshape(n, n) for p in parts)
    b = sum(np.frombuffer(p["b"]) for p in parts)
    model.beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(n), b)
    rest = points.where(fold == 0).select("label", "weight", "x").toPandas()
    if not len(rest):
        rest = points.select("label", "weight", "x").toPandas()
    margin = model.features(np.array(rest["x"].tolist()).reshape(-1, d)) @ model.beta
    model.knots, model.values = isotonic(margin, rest["label"].to_numpy(), rest["weight"].to_numpy())
    return model


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the rising step function nearest to y, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, weight, first x, last x
    weight = np.ones(len(x)) if weight is None else weight
    for at, value, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([value * w, w, at, at])
        while len(pools) > 1 and (pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1] or pools[-2][3] == pools[-1][2]):
            s, c, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += c
            pools[-1][3] = last
    knots = [v for p in pools for v in ((p[2], p[0] / p[1]), (p[3], p[0] / p[1]))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def score(docs: DataFrame, model: Model, held_out: int = 0, modulus: int = 5, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, texts in row_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(own.score(np.array([statistics(t) for t in texts])), pa.float64())], names=["doc_id", "score"])

    scored = only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_of("doc_id") % modulus == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold; a model without training documents rejects none."""
    if not len(model.knots):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: (shared.value.score(np.array([statistics(t) for t in texts])) >= threshold).tolist())
