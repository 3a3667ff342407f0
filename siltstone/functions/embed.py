"""Vectors of texts.  The model is a parameter; without one, words are hashed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import embedding_document

Embedder = Callable[[list[str]], list[list[float]]]
DIMENSIONS, BATCH = 64, 100


def hashing_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Signed counts of hashed words and word pairs, of length one (a zero vector for no words)."""
    out = np.zeros((len(texts), dimensions))
    for row, text in zip(out, texts, strict=True):
        words = re.findall(r"\w+", (text or "").lower())
        for gram in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
            h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
            row[h % dimensions] += 1 if h >> 63 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norms > 0, norms, 1)).tolist()


@cache
def _opened(model: str, tokenizer: str, max_tokens: int) -> tuple[Any, Any]:
    """A session and a tokenizer, once a process."""
    import onnxruntime
    from tokenizers import Tokenizer

    words = Tokenizer.from_file(tokenizer)
    words.enable_truncation(max_tokens)
    words.enable_padding()
    return onnxruntime.InferenceSession(model), words


@dataclass(frozen=True)
class ModelEmbedder:
    """Vectors of an ONNX text model: token vectors averaged over each text and of length one.

    ``model`` and ``tokenizer`` are files that every executor can read; they are opened once in each of their processes."""

    model: str
    tokenizer: str
    max_tokens: int = 512

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        session, words = _opened(self.model, self.tokenizer, self.max_tokens)
        encoded = words.encode_batch([t or "" for t in texts])
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        given = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        tokens = session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0]
        mean = (tokens * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)[:, None]
        norms = np.linalg.norm(mean, axis=1, keepdims=True)
        return (mean / np.where(norms > 0, norms, 1)).tolist()


def embed(units: DataFrame, embedder: Embedder = hashing_embedder, batch: int = BATCH) -> DataFrame:
    """(id, embedding, framework, type, unit_seq, source_file) of each unit, texts given to the model in batches."""
    names = ("id", "embedding", "framework", "type", "unit_seq", "source_file")
    frame = units.select("id", embedding_document(F.col("heading_hierarchy"), F.col("content")).alias("text"), *names[2:])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts, vectors = b.column("text").to_pylist(), []
            for lo in range(0, len(texts), batch):
                vectors += embedder(texts[lo : lo + batch])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(vectors, pa.list_(pa.float32())), *(b.column(n) for n in names[2:])], names=list(names))

    return frame.mapInArrow(run, "id string, embedding array<float>, framework string, type string, unit_seq bigint, source_file string")
