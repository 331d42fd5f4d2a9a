"""Operator 10: best-fit packing by large-item matching.

Documents longer than the capacity are cut; the first piece holds the remainder.
Only lengths matter for packing, and there are at most `capacity` of them, so a
bounded histogram is planned on the driver: items of above a third of the
capacity pair at most twice a bin, the longest with the longest that fits; then
shorter ones go, longest first, to the tightest gap.  Bins of equal content are
one range of numbers, so the plan is a table of rank ranges by length.  Ranks
within a length come from counts by input partition, without gathering a length
in one task.

Defined results: a null or empty text is the end id alone; equal lengths are
interchangeable and any choice between them is a right packing; repeated rows are
each packed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext
from pyspark.sql.window import Window

from mnemora.llm.library import encoder
from mnemora.llm.runtime import only, row_blocks, written
from mnemora.llm.words import with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"


class _Bins:
    """Ranges of equal bins, by the gap that each of them still has."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.gaps, self.at = capacity, 0, [], {}
        self.plan: list[tuple[int, int, int, int, int, int]] = []  # length, rank from, rank to, first bin, items a bin, offset

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.at:
                insort(self.gaps, gap)
            self.at.setdefault(gap, []).append((first, n))

    def take(self, gap: int) -> tuple[int, int]:
        ranges = self.at[gap]
        got = ranges.pop()
        if not ranges:
            del self.at[gap]
            self.gaps.pop(bisect_left(self.gaps, gap))
        return got

    def fill(self, length: int, rank: int, n: int, first: int, bins: int, gap: int, each: int) -> tuple[int, int]:
        """Puts n items, `each` a bin, into bins of that gap, as far as both go: the next rank and the items left."""
        whole = min(bins, n // each)
        if whole:
            self.plan.append((length, rank, rank + whole * each, first, each, self.capacity - gap))
            self.put(gap - each * length, first, whole)
            rank, n, first, bins = rank + whole * each, n - whole * each, first + whole, bins - whole
        if n and bins and n < each:
            self.plan.append((length, rank, rank + n, first, n, self.capacity - gap))
            self.put(gap - n * length, first, 1)
            rank, n, first, bins = rank + n, 0, first + 1, bins - 1
        self.put(gap, first, bins)
        return rank, n


def plan_packing(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, rank from, rank to, first bin, items a bin, offset) rows, and the number of bins."""
    bins = _Bins(capacity)
    left = {k: v for k, v in histogram.items() if v}
    rank = dict.fromkeys(left, 0)
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        n = left[a]
        i = bisect_left(large, capacity - a + 1) - 1  # the longest partner that fits
        b = large[i] if i >= 0 else 0
        if not b:
            m = n
        elif b == a:
            m = n // 2
        else:
            m = min(n, left[b])
        if b == a and m == 0:  # a single one is left; its partner is the next shorter
            b = large[i - 1] if i > 0 else 0
            m = 1
        first, bins.next = bins.next, bins.next + m
        if b == a:
            bins.plan.append((a, rank[a], rank[a] + 2 * m, first, 2, 0))
            rank[a] += 2 * m
            left[a] -= 2 * m
        else:
            bins.plan.append((a, rank[a], rank[a] + m, first, 1, 0))
            rank[a] += m
            left[a] -= m
            if b:
                bins.plan.append((b, rank[b], rank[b] + m, first, 1, a))
                rank[b] += m
                left[b] -= m
        bins.put(capacity - a - b, first, m)
        for k in {a, b} - {0}:
            if not left[k]:
                large.remove(k)
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n, r = left[length], 0
        while n:
            i = bisect_left(bins.gaps, length)
            if i < len(bins.gaps):
                gap = bins.gaps[i]
                first, m = bins.take(gap)
                r, n = bins.fill(length, r, n, first, m, gap, gap // length)
            else:
                each = capacity // length
                m = -(-n // each)
                first, bins.next = bins.next, bins.next + m
                r, n = bins.fill(length, r, n, first, m, capacity, each)
    return bins.plan, bins.next


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, number, start and length of the pieces of documents of these sizes (1 at least); the first holds the remainder."""
    n = -(-sizes // capacity)
    doc = np.repeat(np.arange(len(sizes)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    head = (sizes - (n - 1) * capacity)[doc]
    return doc, piece, np.where(piece == 0, 0, head + (piece - 1) * capacity), np.where(piece == 0, head, capacity)


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's place among those of its length; seen counts those before and goes on."""
    order = np.argsort(lengths, kind="stable")
    own = lengths[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    n = np.diff(np.append(first, len(own)))
    out = np.empty(len(own), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(first, n) + seen[own]
    seen[own[first]] += n
    return out


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(tokenizer)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows, texts in row_blocks(batches):
            ids, sizes = with_end(*lib.encode_flat(texts), end_id)
            doc, piece, start, length = cut(sizes, capacity)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            edges = np.concatenate([[0], np.cumsum(length)]).tolist()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
            columns = [rows.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(_ranks(length, seen))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = plan_packing(histogram, capacity)
    by_length: dict[int, list[tuple[int, ...]]] = {}
    for length, *rest in sorted(plan):
        by_length.setdefault(length, []).append(tuple(rest))
    table = {k: np.array(v, np.int64).T for k, v in by_length.items()}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # a few rows for each length, whatever the input

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for rows in batches:
            length = rows.column("length").to_numpy()
            rank = rows.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, edges) if len(order) else []:
                size = int(length[own[0]])
                lo, _, first, each, base = ranges[size]
                k = np.searchsorted(lo, rank[own], "right") - 1
                nth = rank[own] - lo[k]
                sequence[own] = first[k] + nth // each[k]
                offset[own] = base[k] + nth % each[k] * size
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
