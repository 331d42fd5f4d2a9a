"""Operator 1: byte-level BPE encoding and decoding.

`pretok` finds the pieces by a scan over transition functions; distinct pieces
are merged once and kept.  Ids and each token's byte offset make decoding, whole
or of a byte range, a table lookup.

Defined results: a null or empty text has no ids and decodes to nothing; rows
are independent, so repeated rows and ties need no rule; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mnemora.llm.runtime import only, row_blocks
from mnemora.llm.words import PieceCache, slices

#: From this many bytes on, a piece is merged with a heap.
LONG_PIECE = 96


class ByteBPE:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.tokens[i] = token
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int | None] = {}
        self.cache = PieceCache(self._pieces)

    def _pair(self, a: int, b: int) -> int | None:
        """The id of two neighbours merged, which is also the merge's rank."""
        key = (a, b)
        try:
            return self.pairs[key]
        except KeyError:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            got = self.pairs[key] = self.ranks.get(self.tokens[a] + self.tokens[b])
            return got

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in piece]
        if len(ids) >= LONG_PIECE:
            return self._merge_long(ids)
        none = len(self.tokens)
        pair = self._pair
        after = [none if (r := pair(a, b)) is None else r for a, b in zip(ids, ids[1:], strict=False)]
        while after:
            best = min(after)
            if best == none:
                break
            i = after.index(best)
            ids[i] = best
            del ids[i + 1], after[i]
            if i < len(after):
                after[i] = none if (r := pair(best, ids[i + 1])) is None else r
            if i:
                after[i - 1] = none if (r := pair(ids[i - 1], best)) is None else r
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self._pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (q := self._pair(r, ids[k])) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            h = left[i]
            if h >= 0 and (q := self._pair(ids[h], r)) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        merge, pack = self.merge, struct.pack
        return [pack(f"<{len(x)}I", *x) for x in map(merge, pieces)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where in the text's bytes each token starts."""
        sizes = self.lengths.take(ids)
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decode_flat(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of each text, from all texts' ids one after another."""
        ends = np.cumsum(sizes)
        bytes_before = np.concatenate([[0], np.cumsum(self.lengths.take(ids))])
        at = bytes_before[np.concatenate([[0], ends])].tolist()
        raw = self.decode(ids)
        return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]

    def decode_range(self, ids: np.ndarray, offsets: np.ndarray, start: int, stop: int) -> bytes:
        """The bytes from start to stop, from the tokens that cover them."""
        i = max(0, int(np.searchsorted(offsets, start, "right")) - 1)
        j = int(np.searchsorted(offsets, stop, "left"))
        base = int(offsets[i]) if len(offsets) else 0
        return self.decode(ids[i:j])[max(0, start - base) : max(0, stop - base)]


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<int> (bytes before each token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for rows, texts in row_blocks(batches):
            ids, sizes = own.cache.encode_flat(texts)
            ends = np.cumsum(sizes)
            bytes_before = np.concatenate([[0], np.cumsum(own.lengths.take(ids))])
            offsets = bytes_before[:-1] - np.repeat(bytes_before[ends - sizes], sizes)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *lists], names=["doc_id", "ids", "offsets"])

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, content binary, from rows with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for rows in batches:
            out = [own.decode(np.asarray(x or [], np.int64)) for x in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def roundtrip_digests(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text and keeps digests of both: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for rows, texts in row_blocks(batches):
            flat, sizes = own.cache.encode_flat(texts)
            ids, back = slices(flat, sizes), own.decode_flat(flat, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
