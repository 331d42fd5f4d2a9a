"""Operator 5: toxicity by a weighted lexicon.

Texts are folded (lower case, compatibility forms such as mathematical and wide
letters, stray combining marks, homoglyphs, digit and sign substitutions; accents
stay, as they tell words of other languages apart).  The lexicon holds whole words
and word beginnings; it is learned on a bounded labelled sample by
sequential covering: of all beginnings that toxic documents have far more often,
the one that explains most words not yet explained comes next; then the same goes
on for documents without any.  Words that only ride along in copies earn no place.  An Aho-Corasick automaton finds
entries at word starts, entries inside exception phrases don't count, and the
summed weight is divided by the logarithm of the length before a logistic curve
makes it a score.

Defined results: a null or empty text has no match and the score of one without
any; repeated rows get equal scores; without labelled documents of both classes
every score is 0; a null doc_id counts as not held out; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.runtime import keep_rows, only, row_blocks
from mnemora.llm.samples import crc_of, labelled_sample

#: Letters that look like Latin ones, and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ⅼ": "l"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Harmless phrases with words that could be entries.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "clown fish", "stupid question")
FOLD = str.maketrans({k: v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()} | {chr(c): "" for c in range(0x300, 0x370)} | {"​": "", "‌": "", "‍": "", "­": ""})
WORD = re.compile(r"[^\W\d_]+")
#: Letters of a beginning; whole words may be of any length.
SHORTEST, LONGEST = 4, 16
#: Ends an entry that must be the whole word.
END = "|"


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return text.lower().translate(FOLD)


def beginnings(words: set[str]) -> set[str]:
    """The words' beginnings, and the words as a whole."""
    return {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {w + END for w in words}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -math.inf  # no labels of both classes: every score is 0
    slope: float = 0.0
    _found: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_found": None}

    def _automaton(self):
        if self._found is None:
            import ahocorasick

            a, phrases = ahocorasick.Automaton(), {*map(fold, self.exceptions)}
            for x in {*(e.removesuffix(END) for e in self.weights), *map(fold, self.exceptions)}:
                a.add_word(x, (len(x), self.weights.get(x, 0.0), self.weights.get(x + END, 0.0), x in phrases))
            if len(a):
                a.make_automaton()
            self._found = a
        return self._found

    def matches(self, text: str) -> list[tuple[int, str, float]]:
        """Place in the folded text, entry and weight of each match that counts; of entries at one place the heaviest."""
        a = self._automaton()
        if not len(a):
            return []
        folded = fold(text)
        free: list[tuple[int, int]] = []
        best: dict[int, tuple[float, int]] = {}
        for last, (n, w, whole, phrase) in a.iter(folded):
            at = last - n + 1
            if at and folded[at - 1].isalpha():
                continue
            if (phrase or whole > w) and (last + 1 == len(folded) or not folded[last + 1].isalpha()):
                w = max(w, whole)
                if phrase:
                    free.append((at, last))
            if w and (at not in best or w > best[at][0]):
                best[at] = (w, n)
        return [(at, folded[at : at + n], w) for at, (w, n) in sorted(best.items()) if not any(i <= at <= j for i, j in free)]

    def density(self, text: str) -> float:
        total = sum(w for _, _, w in self.matches(text))
        return total and total / math.log2(4 + text.count(" ") + text.count("\n"))

    def score(self, text: str) -> float:
        if self.bias == -math.inf:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * self.density(text)))))


def _presence(sample: DataFrame, among: set[str] | None, label: int) -> DataFrame:
    """entry, n: the sample's documents of that label with a word of that beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for _, texts in row_blocks(batches):
            for t in texts:
                b = beginnings(set(WORD.findall(fold(t))))
                seen.update(b if among is None else b & among)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["entry", "n"])

    counts = sample.where(F.col("label") == label).select("text").mapInArrow(run, "entry string, n long")
    return counts.groupBy("entry").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, modulus: int = 5, positives: int = 6000, negatives: int = 14000, ratio: float = 20.0, weak_ratio: float = 5.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from at most `positives` + `negatives` training documents."""
    sample = labelled_sample(docs, labels, label, held_out, modulus, {1: positives, 0: negatives})
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions)
    least = max(3, n1 // 500)
    # entries of the bounded sample's toxic documents, at most a few for each of its words
    pos = {r["entry"]: r["n"] for r in _presence(sample, None, 1).where(F.col("n") >= least).collect()}
    neg = {r["entry"]: r["n"] for r in _presence(sample, set(pos), 0).collect()}
    weight = {e: math.log((n + 0.5) / (n1 + 1)) - math.log((neg.get(e, 0) + 0.5) / (n0 + 1)) for e, n in pos.items()}
    candidates = {e for e, w in weight.items() if w >= math.log(weak_ratio)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in row_blocks(batches):
            out = [[c for w in sorted(set(WORD.findall(fold(t)))) if (c := sorted(beginnings({w}) & candidates))] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.list_(pa.string())))], names=["words"])

    of_doc = [r["words"] for r in sample.where(F.col("label") == 1).select("text").mapInArrow(held, "words array<array<string>>").collect()]
    strong = {e for e in candidates if weight[e] >= math.log(ratio)}
    chosen = cover([[e for e in w if e in strong] for d in of_doc for w in d], weight, max(least, n1 // 50))
    for among in (strong, candidates):
        rest = [[e for w in d for e in w if e in among] for d in of_doc if not any(e in chosen for w in d for e in w)]
        chosen += cover(rest, weight, least)
    lexicon = Lexicon({e: weight[e] for e in chosen}, exceptions)

    def densities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("label").cast(pa.int32()), rows.column("weight"), pa.array([lexicon.density(t) for t in texts], pa.float64())], names=["label", "weight", "x"])

    points = sample.select("label", "weight", "text").mapInArrow(densities, "label int, weight double, x double").toPandas()
    lexicon.bias, lexicon.slope = logistic(points["x"].to_numpy(), points["label"].to_numpy(), points["weight"].to_numpy())
    return lexicon


def cover(items: list[list[str]], weight: dict[str, float], least: int) -> list[str]:
    """Entries by what they explain first: items not explained yet times weight; of equals the longest."""
    left = dict(enumerate(map(set, items)))
    having: dict[str, set[int]] = defaultdict(set)
    for k, entries in left.items():
        for e in entries:
            having[e].add(k)
    chosen: list[str] = []
    while having:
        e = max(having, key=lambda x: (len(having[x]) * weight[x], len(x), x))
        if len(having[e]) >= least:
            chosen.append(e)
        else:
            having.pop(e)
            continue
        for k in list(having[e]):
            for x in left.pop(k):
                if x in having:
                    having[x].discard(k)
        having = {x: s for x, s in having.items() if len(s) >= least}
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, steps: int = 60) -> tuple[float, float]:
    """Bias and slope, by Newton steps."""
    weight = np.ones(len(x)) if weight is None else weight
    z = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge * np.eye(2)
        w += np.clip(np.linalg.solve(h, z.T @ (weight * (y - p)) - ridge * w), -5, 5)
    return float(w[0]), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon, held_out: int = 0, modulus: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)  # a few hundred entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for rows, texts in row_blocks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([own.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    scored = only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_of("doc_id") % modulus == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score stays under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)
    return keep_rows(docs, lambda texts: [model.value.score(t) < threshold for t in texts])
