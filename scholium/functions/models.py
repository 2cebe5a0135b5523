"""Models as plug-ins: embedding providers, pair scorers and language models, loaded once a task.

A provider is any object with these methods; it is sent to the tasks, so it should load its weights in
warmup(), which runs once a task before the first batch. No weights are shipped: the providers here are
deterministic ones for tests and for want of a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class EmbeddingProvider(Protocol):
    model_name: str
    dimensions: int

    def warmup(self) -> None: ...

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_queries(self, texts: Sequence[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def warmup(self) -> None: ...

    def score(self, queries: Sequence[str], texts: Sequence[str]) -> Sequence[float]: ...


@dataclass
class StableEmbeddings:
    """Unit vectors from SHA-256, equal to functions.text.stable_vector."""

    dimensions: int = 64
    model_name: str = "stable-sha256"
    query_prefix: str = "query: "

    def warmup(self) -> None:
        """Nothing to load."""

    def embed_documents(self, texts: Sequence[str]) -> np.ndarray:
        raw = np.array([np.resize(np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8), self.dimensions) for t in texts], float).reshape(len(texts), self.dimensions)
        return (raw - 127.5) / 127.5

    def embed_queries(self, texts: Sequence[str]) -> np.ndarray:
        return self.embed_documents([self.query_prefix + t for t in texts])


def get_provider(name: str = "stable", dimensions: int = 64) -> EmbeddingProvider:
    if name != "stable":
        raise ValueError(f"no provider {name}; give an object with the methods of EmbeddingProvider instead")
    return StableEmbeddings(dimensions)


def embed(df: DataFrame, text: str, provider: EmbeddingProvider, out: str = "vector", queries: bool = False, batch: int = 32) -> DataFrame:
    """df with unit vectors of a text column, in batches; null texts have null. Other lengths than promised raise."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider.warmup()
        make = provider.embed_queries if queries else provider.embed_documents
        for pdf in batches:
            at = np.flatnonzero(pdf[text].notna().to_numpy())
            found: list[object] = [None] * len(pdf)
            for a in range(0, len(at), batch):
                part = at[a : a + batch]
                got = np.asarray(make(pdf[text].iloc[part].tolist()), float)
                if got.shape != (len(part), provider.dimensions):
                    raise ValueError(f"{provider.model_name} gave {got.shape}, not {(len(part), provider.dimensions)}")
                norm = np.linalg.norm(got, axis=1, keepdims=True)
                for i, v in zip(part, got / np.where(norm == 0, 1, norm), strict=True):
                    found[i] = v
            yield pdf.assign(**{out: pd.Series(found, index=pdf.index, dtype="object")})

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out)
    return df.select(*[c for c in df.columns if c != out]).mapInPandas(run, f"{fields}, `{out}` array<double>")


def score_pairs(df: DataFrame, query: str, text: str, reranker: Reranker, out: str = "rerank_score", batch: int = 16) -> DataFrame:
    """df with the reranker's score of every (query, text); a batch that fails or is short has null scores, so its query keeps its order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reranker.warmup()
        for pdf in batches:
            scores: list[float] = []
            for a in range(0, len(pdf), batch):
                part = pdf.iloc[a : a + batch]
                try:
                    got = list(map(float, reranker.score(part[query].tolist(), part[text].fillna("").tolist())))
                except Exception:  # noqa: BLE001 - a model may fail in any way; the order is kept then
                    got = []
                scores += got if len(got) == len(part) else [np.nan] * len(part)
            yield pdf.assign(**{out: pd.Series(scores, index=pdf.index, dtype="float64").astype(object).where(lambda x: x.notna(), None)})

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out)
    return df.select(*[c for c in df.columns if c != out]).mapInPandas(run, f"{fields}, `{out}` double")


@dataclass
class ScriptedModel:
    """Answers in order, the last one again and again; for tests of the answer pipeline."""

    answers: Sequence[str]
    asked: list[object] = field(default_factory=list)

    def complete(self, messages: object) -> str:
        self.asked.append(messages)
        return self.answers[min(len(self.asked), len(self.answers)) - 1]

    def health(self) -> bool:
        return True
