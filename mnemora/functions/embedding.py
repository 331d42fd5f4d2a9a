"""Embedders, and columns that use them in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mnemora.errors import ConfigError, EmbeddingError, ValidationError


@dataclass(frozen=True)
class ProviderIdentity:
    provider: str
    model_id: str


class EmbeddingService(Protocol):
    def embed(self, text: str) -> list[float]: ...
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...
    def dimension(self) -> int: ...
    def identity(self) -> ProviderIdentity: ...


def validate_embedding(service: EmbeddingService, vector: list[float]) -> None:
    if len(vector) != service.dimension():
        raise ValidationError("DimensionMismatch", f"{len(vector)} instead of {service.dimension()}")


class ExternalEmbedder:
    """Vectors come from outside; asking for one is an error."""

    def __init__(self, dimension: int):
        self._dimension = dimension

    def embed(self, text: str) -> list[float]:
        raise EmbeddingError("vectors must be given")

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        raise EmbeddingError("vectors must be given")

    def dimension(self) -> int:
        return self._dimension

    def identity(self) -> ProviderIdentity:
        return ProviderIdentity("external", "external")


class HashEmbedder:
    """Deterministic: words vote for signed places by their hash; unit length."""

    def __init__(self, dimension: int = 64):
        self._dimension = dimension

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self._dimension)
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % self._dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def dimension(self) -> int:
        return self._dimension

    def identity(self) -> ProviderIdentity:
        return ProviderIdentity("hash", hashlib.sha256(f"hash-{self._dimension}".encode()).hexdigest()[:16])


class OnnxEmbedder:
    """A local ONNX model: tokens, attention-masked mean, unit length."""

    def __init__(self, model_path: str, tokenizer_path: str, dimension: int = 384):
        self.model_path, self.tokenizer_path, self._dimension, self._session = model_path, tokenizer_path, dimension, None
        self.length = 256 if dimension == 384 else 512

    def _open(self):
        if self._session is None:
            try:
                import onnxruntime
                from tokenizers import Tokenizer

                self._session = onnxruntime.InferenceSession(self.model_path)
                self._tokenizer = Tokenizer.from_file(self.tokenizer_path)
            except Exception as e:
                raise EmbeddingError(str(e)) from e
            self._tokenizer.enable_truncation(self.length)
            self._tokenizer.enable_padding()
        return self._session

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        session = self._open()
        enc = self._tokenizer.encode_batch(texts)
        ids, mask = np.array([e.ids for e in enc], np.int64), np.array([e.attention_mask for e in enc], np.int64)
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        out = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        return mean_pool(out, mask).tolist()

    def dimension(self) -> int:
        return self._dimension

    def identity(self) -> ProviderIdentity:
        with open(self.model_path, "rb") as f:
            return ProviderIdentity("onnx", hashlib.file_digest(f, "sha256").hexdigest()[:16])


def create_embedding_service(kind: str = "external", **options) -> EmbeddingService:
    """external (dimension), hash (dimension) or onnx (model_path, tokenizer_path, dimension)."""
    kinds = {"external": ExternalEmbedder, "hash": HashEmbedder, "onnx": OnnxEmbedder}
    if kind not in kinds:
        raise ConfigError(f"no embedding service {kind}")
    return kinds[kind](**options)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    m = mask[:, :, None].astype(float)
    v = (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n > 0, v / np.where(n > 0, n, 1), v)


def embed_column(service: EmbeddingService):
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:  # the service is loaded once a worker
            yield pd.Series(service.embed_batch(s.fillna("").tolist()))

    return run
