"""The port for embedding models, a deterministic stand-in, and what is to be embedded again."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Unit vectors of a fixed length; queries may be embedded differently from documents."""

    name: str
    dim: int

    def documents(self, texts: list[str]) -> np.ndarray: ...

    def query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed to signed components, normalised. The same text has the same vector everywhere."""

    def __init__(self, dim: int = 64, query_prefix: str = ""):
        self.name, self.dim, self.prefix = f"hashing-{dim}", dim, query_prefix

    def documents(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    def query(self, text: str) -> np.ndarray:
        return self.documents([self.prefix + text])[0]


def embed(df: DataFrame, text: Column, make: Callable[[], Embedder], dim: int) -> DataFrame:
    """df with `embedding` and `embedding_model`; the model is made once per task. A model of another length stops it."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, embedding array<float>, embedding_model string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        if model.dim != dim:
            raise ValueError(f"{model.name} has {model.dim} components, the index {dim}")
        for pdf in batches:
            if len(pdf):
                v = model.documents(pdf.pop("__text").tolist())
                yield pdf.assign(embedding=list(v), embedding_model=model.name)

    return df.withColumn("__text", text).mapInPandas(run, schema)


def stale(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """Chunks without a usable vector of the model: none, of another model, of another length, all zero or with a gap."""
    bad = lambda e: e.isNull() | F.isnan(e)
    usable = (F.col("embedding_model") == model) & (F.size("embedding") == dim) & ~F.exists("embedding", bad) & F.exists("embedding", lambda e: e != 0)
    return chunks.where(~F.coalesce(usable, F.lit(False)))


def reembedded(chunks: DataFrame, make: Callable[[], Embedder], model: str, dim: int) -> DataFrame:
    """All chunks, the stale ones with new vectors; the others are not touched."""
    old = stale(chunks, model, dim)
    kept = chunks.join(old.select("chunk_id"), "chunk_id", "left_anti")
    new = embed(old.drop("embedding", "embedding_model"), F.concat_ws("\n", "section_path", "content"), make, dim)
    return kept.unionByName(new)
