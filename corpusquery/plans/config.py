"""Settings, from arguments or the environment."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from .. import providers, remote

BACKENDS = ("multi", "single")


def flag(value: str) -> bool:
    return value.strip().lower() not in ("false", "0", "no")


def _number(name: str, default: int):
    return field(default_factory=lambda: int(os.environ.get(name) or default))


def _text(name: str, default: str):
    return field(default_factory=lambda: os.environ.get(name) or default)


@dataclass
class Config:
    """Numbers given as None or 0 fall back to these. Without a ``model_url`` the stand-ins answer, which need no network."""

    chunk_size: int = 400
    chunk_overlap: int = 60
    top_k: int = _number("TOP_K", 3)
    top_k_sparse: int = _number("TOP_K_SPARSE", 5)
    top_k_dense: int = _number("TOP_K_DENSE", 5)
    rrf_k: int = _number("RRF_K", 60)
    top_n_rerank: int = _number("TOP_N_RERANK", 3)
    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5
    #: Decimal places at which scores count as equal; None: none are rounded.
    score_digits: int | None = None
    backend: str = field(default_factory=lambda: os.environ.get("EMBEDDING_BACKEND", "multi").lower())
    evaluate: bool = field(default_factory=lambda: flag(os.environ.get("ENABLE_TRIAD_EVAL", "true")))
    model_url: str = _text("MODEL_URL", "")
    model_key: str = _text("MODEL_KEY", "")
    llm_model: str = _text("LLM_MODEL", "default")
    judge_model: str = _text("TRIAD_EVAL_MODEL", "")
    embedding_model: str = _text("EMBEDDING_MODEL", "default")
    embedding_dim: int = _number("EMBEDDING_DIM", 3072)
    max_tokens: int = _number("EMBEDDING_MAX_TOKENS", providers.MAX_TOKENS)
    multi_model: str = _text("MULTI_MODEL", "default")
    multi_device: str = _text("MULTI_DEVICE", "auto")
    #: load(name, device) of a local model of one vector for each token (``providers.LateInteraction``).
    multi_load: Callable | None = None
    #: Folder in which models' replies are kept, so that a prompt is asked about once; empty: none are kept.
    reply_dir: str = _text("REPLY_DIR", "")
    graph_dir: str = _text("GRAPH_WORKING_DIR", "./graph_storage")

    def __post_init__(self):
        if self.backend.lower() not in BACKENDS:
            raise ValueError(f"backend must be one of {', '.join(BACKENDS)}: {self.backend}")
        self.backend = self.backend.lower()

    def embedder(self):
        """A factory of embedders."""
        if not self.model_url:
            return providers.HashingEmbedder
        providers.require_key(self.model_key, "MODEL_KEY")
        url, key, name, dim, most = self.model_url, self.model_key, self.embedding_model, self.embedding_dim, self.max_tokens
        return lambda: remote.HttpEmbedder(url, key, name, dim, max_tokens=most)

    def multi_embedder(self, load=None):
        """A factory of embedders with a vector for each token; load(name, device) brings a local model.

        Without a loader the stand-in serves, unless a model is named: then it is an error."""
        load = load or self.multi_load
        if load is None:
            if self.multi_model != "default":
                raise ValueError(f"MULTI_MODEL is {self.multi_model}, but nothing loads it: give Config a multi_load")
            return providers.HashingEmbedder
        name, device = self.multi_model, self.multi_device
        return lambda: providers.LateInteraction(load, name, device)

    def model(self, judge: bool = False):
        """A factory of language models; the judge is the same one unless another is named."""
        if not self.model_url:
            return providers.ExtractiveModel
        providers.require_key(self.model_key, "MODEL_KEY")
        url, key, name = self.model_url, self.model_key, judge and self.judge_model or self.llm_model
        return lambda: remote.HttpModel(url, key, name)
