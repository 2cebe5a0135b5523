"""Typed settings with ranges, from a mapping such as the environment: SCHOLIUM_<NAME>, lists as CSV or JSON."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import get_type_hints

from scholium.operators.chunking import Limits
from scholium.operators.retrieval import Search


def listed(value: str) -> tuple[str, ...]:
    """A list written as JSON or separated by commas; blanks around entries and empty entries go."""
    text = value.strip()
    parts = json.loads(text) if text.startswith("[") else text.split(",")
    return tuple(p for p in (str(x).strip() for x in parts) if p)


@dataclass(frozen=True)
class Settings:
    categories: tuple[str, ...] = ("cs.CL",)
    pdf_hosts: tuple[str, ...] = ("arxiv.org",)
    page_size: int = 100
    interval: float = 3.0
    max_attempts: int = 3
    quality_threshold: float = 0.5
    mode: str = "hybrid"
    top_k: int = 10
    pool: int = 50
    fusion: str = "rrf"
    rrf_k: int = 60
    per_paper: int = 3
    dedup_threshold: float = 0.9
    context_tokens: int = 3000
    chunk_tokens: int = 512
    chunk_least: int = 50
    chunk_overlap: int = 64

    def __post_init__(self) -> None:
        # name: least, most
        ranges = {
            "page_size": (1, 2000), "interval": (0, 60), "max_attempts": (1, 100), "quality_threshold": (0, 1), "top_k": (1, 1000), "pool": (1, 1000), "rrf_k": (1, 1000),
            "per_paper": (1, 1000), "dedup_threshold": (0, 1), "context_tokens": (1, 1_000_000), "chunk_tokens": (1, 100_000), "chunk_least": (0, 100_000), "chunk_overlap": (0, 100_000),
        }
        for name, (least, most) in ranges.items():
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be between {least} and {most}")
        if self.mode not in ("keyword", "vector", "hybrid") or self.fusion not in ("rrf", "weighted"):
            raise ValueError("unknown mode or fusion")

    @classmethod
    def read(cls, values: Mapping[str, str], prefix: str = "SCHOLIUM_") -> Settings:
        kinds, given = get_type_hints(cls), {}
        for f in dataclasses.fields(cls):
            if (v := values.get(prefix + f.name.upper())) is not None:
                given[f.name] = listed(v) if kinds[f.name] not in (int, float, str) else kinds[f.name](v)
        return cls(**given)

    def search(self) -> Search:
        return Search(mode=self.mode, k=self.top_k, pool=self.pool, fusion=self.fusion, rrf_k=self.rrf_k, per_paper=self.per_paper, threshold=self.dedup_threshold)

    def limits(self) -> Limits:
        return Limits(most=self.chunk_tokens, least=self.chunk_least, overlap=self.chunk_overlap)
