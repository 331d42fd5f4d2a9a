"""Operator 3: language by a string kernel.

A text is the set of its 1- to 3-grams over letters and blanks, all other
characters being one symbol; two texts' kernel is the size of the sets'
intersection over the root of the product of their sizes.  Landmark texts give
Nystroem features, and kernel ridge regression one language against the rest
gives the weights, so scoring is a product of presence vectors, landmarks and
weights in batches.  An n-gram is its code points in one number, so no script
needs an alphabet.

Defined results: a null text or one without a letter is `und` with score 0;
repeated rows get equal predictions; ties go to the language first in order;
without training documents all are `und`; a null doc_id counts as not held out and
is not learned from; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.pretok import K_LETTER, classes
from mnemora.llm.runtime import only, row_blocks, written
from mnemora.llm.samples import crc_of

UNKNOWN = "und"
#: Characters of a text whose n-grams are found at a time, and texts whose presence vectors are multiplied at a time.
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 128
_BITS = 21


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray = field(repr=False)  # the landmarks' n-grams, rising
    landmarks: np.ndarray = field(repr=False)  # n-grams x landmarks
    landmark_sizes: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)  # landmarks x languages

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """texts x landmarks."""
        presence = np.zeros((len(sets), len(self.vocabulary)), np.float32)
        for k, grams in enumerate(sets):
            at = np.searchsorted(self.vocabulary, grams)
            at[at == len(self.vocabulary)] = 0
            presence[k, at[self.vocabulary[at] == grams]] = 1
        sizes = np.array([max(1, len(g)) for g in sets], float)
        return (presence @ self.landmarks) / np.sqrt(sizes[:, None] * self.landmark_sizes[None, :])

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            sets = [grams(t) for t in texts[at : at + TEXTS_AT_ONCE]]
            lettered = np.array([has_letter(t) for t in texts[at : at + TEXTS_AT_ONCE]])
            margins = self.margins(sets)
            best = margins.argmax(1)
            e = np.exp(6 * (margins - margins.max(1, keepdims=True)))
            top = (e / e.sum(1, keepdims=True))[np.arange(len(sets)), best]
            names += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            scores[at : at + len(sets)] = np.where(lettered, top, 0)
        return names, scores


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.int32)


def has_letter(text: str) -> bool:
    return any((classes().take(_codes(text[i : i + CHARS_AT_ONCE])) == K_LETTER).any() for i in range(0, len(text), CHARS_AT_ONCE))


def grams(text: str) -> np.ndarray:
    """The distinct n-grams, n from 1 to 3, of the text in lower case and between blanks: rising numbers."""
    text = f" {text.lower()} "
    parts = []
    for i in range(0, len(text), CHARS_AT_ONCE):
        codes = _codes(text[i : i + CHARS_AT_ONCE + 2])  # with what n-grams that start here reach into
        s = np.where((classes().take(codes) == K_LETTER) | (codes == 0x20), codes, 0).astype(np.int64) + 1
        two = (s[:-1] << _BITS) | s[1:]
        parts.append(np.unique(np.concatenate([s, two, (two[:-1] << _BITS) | s[2:]])))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


def training_sample(docs: DataFrame, held_out: int, modulus: int, rows: int) -> DataFrame:
    """doc_id, text_hash, lang, grams of at most `rows` training documents, as many of each language as of others where it has them.

    Of each language those come first whose doc_id and text have the smallest hash.
    """
    known = only(docs, doc_id="doc_id", lang="lang", text="text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(crc_of("doc_id") % modulus != held_out, F.lit(False)))
    keys = known.select("doc_id", "lang", F.xxhash64("text").alias("text_hash")).withColumn("place", F.xxhash64("doc_id", "text_hash"))
    sizes = {r["lang"]: r["count"] for r in keys.groupBy("lang").count().collect()}  # a row a language
    each = max(1, rows // max(1, len(sizes)))
    # of a language of n rows those with the smallest hashes: six deviations more than are needed, then the first of these
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, (each + 6 * each**0.5 + 10) / n))]) if sizes else F.lit(None).cast("map<string,double>")
    few = keys.where(F.pmod("place", F.lit(1 << 53)).cast("double") < share[F.col("lang")] * float(1 << 53))
    order = Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 53)), "doc_id", "text_hash")
    ids = written(few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= each).select("doc_id", "lang", "text_hash").distinct(), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_blocks(batches):
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("doc_id", "text_hash", "lang")], pa.array([grams(t) for t in texts], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "lang", "grams"])

    chosen = known.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "lang", "text_hash"])  # at most `rows` ids
    return chosen.select("doc_id", "text_hash", "lang", "text").mapInArrow(run, "doc_id long, text_hash long, lang string, grams array<long>").dropDuplicates(["doc_id", "text_hash", "lang"])


def fit(docs: DataFrame, held_out: int = 1, modulus: int = 3, rows: int = 1200, landmarks: int = 160, ridge: float = 1e-3) -> Model | None:
    """A model from at most `rows` training documents (the bound), of which n-gram sets come to the driver; None without any."""
    sample = training_sample(docs, held_out, modulus, rows).toArrow().sort_by([(c, "ascending") for c in ("lang", "doc_id", "text_hash")]).combine_chunks()
    if not len(sample):
        return None
    lists = sample.column("grams").chunk(0)
    flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
    return train([flat[i:j] for i, j in zip(at, at[1:], strict=False)], sample.column("lang").to_pylist(), landmarks, ridge)


def train(sets: list[np.ndarray], langs: list[str], landmarks: int = 160, ridge: float = 1e-3) -> Model:
    """Landmarks are taken in turn from each language."""
    languages, turn, order = sorted(set(langs)), Counter(), []
    for i, x in enumerate(langs):
        turn[x] += 1
        order.append((turn[x], x, i))
    chosen = [i for _, _, i in sorted(order)[:landmarks]]
    vocabulary = np.unique(np.concatenate([sets[i] for i in chosen]))
    columns = np.zeros((len(vocabulary), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        columns[np.searchsorted(vocabulary, sets[i]), k] = 1
    model = Model(languages, vocabulary, columns, np.array([max(1, len(sets[i])) for i in chosen], float), np.zeros((len(chosen), len(languages))))
    kernel = np.concatenate([model.kernel(sets[i : i + TEXTS_AT_ONCE]) for i in range(0, len(sets), TEXTS_AT_ONCE)])
    among = kernel[chosen]
    value, vector = np.linalg.eigh((among + among.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 1e-8))  # Nystroem: features are kernel @ root
    features = kernel @ root
    share = Counter(langs)
    weight = np.array([len(langs) / (len(languages) * share[x]) for x in langs])
    target = np.array([[1.0 if x == y else -1.0 for y in languages] for x in langs])
    a = features.T @ (features * weight[:, None]) + ridge * len(langs) * np.eye(features.shape[1])
    model.weights = root @ np.linalg.solve(a, features.T @ (target * weight[:, None]))
    return model


def predict(docs: DataFrame, model: Model | None, held_out: int = 1, modulus: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of a fixed number of landmarks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for rows, texts in row_blocks(batches):
            names, scores = own.predict(texts) if own else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(crc_of("doc_id") % modulus == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
