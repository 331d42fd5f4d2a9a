"""Encoders that keep the ids of pieces they have met, in flat arrays.

Pieces of up to 16 bytes are two 64-bit numbers and a length, which is their exact
key in an open-addressing table that is probed for all pieces of a block at once;
longer ones are keys of a dictionary.  All ids lie in one array, so a block's ids
are gathered without a Python object for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from mnemora.llm.pretok import boundaries, segments
from mnemora.llm.runtime import BLOCK_CHARS

SHORT = 16
#: Longer pieces are encoded each time they come.
KEPT_BYTES = 256
_PRIME, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class PieceCache:
    """Piece -> ids.

    Holds at most `limit` pieces; when full it starts anew, which costs time but changes no result.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], list[bytes]], limit: int = 500_000):
        self.encode_pieces, self.limit = encode_pieces, limit
        self.slots = 1 << max(10, (2 * limit - 1).bit_length())
        self.shift = np.uint64(64 - self.slots.bit_length() + 1)
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64)
        self.info = np.zeros(self.slots, np.uint64)  # length in bytes | number of ids << 8 | place in flat << 16; 0 is free
        self.long: dict[bytes, tuple[int, int]] = {}
        self.flat, self.used, self.count = np.zeros(1 << 16, np.uint32), 0, 0

    def _append(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Puts ids behind those in flat: places and counts."""
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) >> 2
        total = int(counts.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + total] = np.frombuffer(b"".join(encoded), "<u4")
        places = self.used + np.cumsum(counts) - counts
        self.used += total
        return places, counts

    def _home(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h = (low ^ (high * _OTHER) ^ sizes.astype(np.uint64)) * _PRIME
        h ^= h >> np.uint64(29)
        h *= _OTHER
        return (h >> self.shift).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The info of each short piece, 0 where it isn't known."""
        slot = self._home(low, high, sizes)
        info = self.info.take(slot)
        tag = sizes.astype(np.uint64)
        open_ = np.flatnonzero(((info & np.uint64(255)) != tag) | (self.low.take(slot) != low) | (self.high.take(slot) != high))
        open_ = open_[info[open_] != 0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
            at = slot[open_]
            now = self.info[at]
            info[open_] = now
            open_ = open_[(now != 0) & (((now & np.uint64(255)) != tag[open_]) | (self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
        return info

    def _insert(self, low: np.ndarray, high: np.ndarray, sizes: np.ndarray, info: np.ndarray) -> None:
        """Distinct pieces that aren't in the table."""
        left, slot = np.arange(len(low)), self._home(low, high, sizes)
        while len(left):
            free = np.flatnonzero(self.info[slot[left]] == 0)
            _, first = np.unique(slot[left[free]], return_index=True)
            put = left[free[first]]
            at = slot[put]
            self.low[at], self.high[at], self.info[at] = low[put], high[put], info[put]
            done = np.zeros(len(low), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & (self.slots - 1)

    def ids_of(self, raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces between the edges, one after another, and how many each piece has."""
        starts, sizes = edges[:-1], np.diff(edges)
        n = len(starts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        window = np.ndarray((len(raw) + SHORT - 7,), "<u8", raw + bytes(SHORT), strides=(1,))
        place, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        short = np.flatnonzero(sizes <= SHORT)
        own, width = starts[short], sizes[short]
        low = window[own] & _MASKS.take(np.minimum(width, 8))
        high = np.zeros(len(own), np.uint64)
        wide = np.flatnonzero(width > 8)
        high[wide] = window[own[wide] + 8] & _MASKS.take(width[wide] - 8)
        info = self._find(low, high, width)
        missing = np.flatnonzero(info == 0)
        if len(missing):
            new = {raw[own[k] : own[k] + width[k]]: k for k in missing.tolist()}
            if self.count + len(new) > self.limit:
                self.clear()
                missing = np.arange(len(own))
                new = {raw[own[k] : own[k] + width[k]]: k for k in missing.tolist()}
            places, counts = self._append(self.encode_pieces(list(new)))
            at = np.fromiter(new.values(), np.int64, len(new))
            self._insert(low[at], high[at], width[at], width[at].astype(np.uint64) | (counts.astype(np.uint64) << np.uint64(8)) | (places.astype(np.uint64) << np.uint64(16)))
            self.count += len(new)
            info[missing] = self._find(low[missing], high[missing], width[missing])
        place[short] = (info >> np.uint64(16)).astype(np.int64)
        count[short] = ((info >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        kept = self._long(raw, starts, sizes, place, count)
        ends = np.cumsum(count)
        out = self.flat.take(np.repeat(place - ends + count, count) + np.arange(ends[-1]))
        self.used = kept
        return out, count

    def _long(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray, count: np.ndarray) -> int:
        """Fills in the long pieces; returns how much of flat is to be kept."""
        wide = np.flatnonzero(sizes > SHORT).tolist()
        pieces = [raw[starts[k] : starts[k] + sizes[k]] for k in wide]
        new = list({p for p in pieces if p not in self.long})
        if not new:
            found, kept = self.long, self.used
        else:
            if len(self.long) + len(new) > max(64, self.limit // 8):
                self.long = {}  # their ids stay in flat until it is cleared; then a few MB go
                new = list(set(pieces))
            new.sort(key=lambda p: len(p) > KEPT_BYTES)
            places, counts = self._append(self.encode_pieces(new))
            got = dict(zip(new, zip(places.tolist(), counts.tolist(), strict=True), strict=True))
            stay = {p: x for p, x in got.items() if len(p) <= KEPT_BYTES}
            kept = self.used - sum(n for p, (_, n) in got.items() if len(p) > KEPT_BYTES)
            self.long |= stay
            found = self.long | got if len(stay) < len(got) else self.long
        for k, p in zip(wide, pieces, strict=True):
            place[k], count[k] = found[p]
        if self.used > 16 * max(self.limit, 1 << 16):  # what cleared dictionaries left behind
            self.count = self.limit
        return kept

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and how many each text has."""
        sizes = np.zeros(len(texts), np.int64)
        done: list[np.ndarray] = []
        block: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal block, owner, size
            raw, edges, bounds = boundaries(block)
            ids, counts = self.ids_of(raw, edges)
            done.append(ids)
            before = np.concatenate([[0], np.cumsum(counts)])[bounds]
            np.add.at(sizes, owner, np.diff(before))
            block, owner, size = [], [], 0

        for k, text in enumerate(texts):
            for s in segments(text, BLOCK_CHARS):
                if block and size + len(s) > BLOCK_CHARS:
                    flush()
                block.append(s)
                owner.append(k)
                size += len(s)
        if block:
            flush()
        return (done[0] if len(done) == 1 else np.concatenate(done) if done else np.zeros(0, np.uint32)), sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return slices(*self.encode_flat(texts))


def slices(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [raw[4 * (e - n) : 4 * e].tobytes() for e, n in zip(ends, sizes.tolist(), strict=True)]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id behind each text."""
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
