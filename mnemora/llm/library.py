"""Whole texts encoded with the tokenizers library.

The library splits a text at its special tokens, then into pieces, and merges
within each piece alone.  So each distinct piece goes through the library's
model once, and a text's ids are its pieces' ids, one after another.
"""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

from mnemora.llm.words import PieceCache, slices


def _byte_letters() -> dict[int, int]:
    """The printable stand-ins of the 256 bytes: bytes that print stand for themselves, the rest come from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class LibraryEncoder:
    def __init__(self, path: str, pieces: int = 500_000):
        from tokenizers.models import BPE

        with open(path) as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        self.path = path
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = BPE(model["vocab"], merges, cache_capacity=0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the leftmost special token counts, and the longest of those at one place
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.letters = _byte_letters()
        self.cache = PieceCache(self._pieces, pieces)

    @cached_property
    def tokenizer(self):
        """The library's whole tokenizer, which workers don't need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        tokenize, letters, pack = self.model.tokenize, self.letters, struct.pack
        got = ([t.id for t in tokenize(p.decode("latin-1").translate(letters))] for p in pieces)
        return [pack(f"<{len(ids)}I", *ids) for ids in got]

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and how many each text has."""
        if not self.at_special or not any(map(self.at_special.search, texts)):
            return self.cache.encode_flat(texts)
        parts: list[str] = []
        owner: list[int] = []
        after: list[int] = []  # the special token behind each part, or -1
        for k, text in enumerate(texts):
            at = 0
            for m in self.at_special.finditer(text):
                parts.append(text[at : m.start()])
                after.append(self.special[m[0]])
                at = m.end()
                owner.append(k)
            parts.append(text[at:])
            after.append(-1)
            owner.append(k)
        ids, sizes = self.cache.encode_flat(parts)
        behind = np.array(after)
        put = np.flatnonzero(behind >= 0)
        ids = np.insert(ids, np.cumsum(sizes)[put], behind[put].astype(np.uint32))
        return ids, np.bincount(owner, sizes + (behind >= 0), len(texts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return slices(*self.encode_flat(texts))


@lru_cache(maxsize=2)
def encoder(path: str, pieces: int = 500_000) -> LibraryEncoder:
    """A worker's encoder, whose cache holds at most so many pieces."""
    return LibraryEncoder(path, pieces)
