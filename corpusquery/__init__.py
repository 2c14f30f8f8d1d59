"""Retrieval and text analytics over DataFrames.

The names here are what most programs need; they are imported when they are first used, so that a worker that needs one
module doesn't load them all.
"""

import importlib

_WHERE = {
    "chunk": "operators.chunking", "SparseIndex": "operators.sparse", "bm25_index": "operators.sparse", "bm25_search": "operators.sparse",
    "cosine_search": "operators.dense", "maxsim_search": "operators.dense", "fuse": "operators.fusion", "rerank": "operators.rerank", "evaluate": "operators.triad",
    "Graph": "operators.graph", "extract_graph": "operators.graph", "graph_search": "operators.graph", "ModelExtractor": "operators.graph", "VectorStore": "sources.stores", "read_text": "sources.textfile",
    "GraphStore": "sources.graph_store", "graph_contexts": "operators.answers", "graph_answers": "operators.answers", "ModelSummariser": "operators.graph", "ModelKeywords": "operators.graph",
    "InvertedIndex": "operators.inverted", "Clusters": "operators.clustered", "Replies": "sources.replies", "conversations": "streaming.conversations", "OverlapModel": "providers",
    "HashingEmbedder": "providers", "LetterEmbedder": "providers", "ExtractiveModel": "providers", "LateInteraction": "providers", "HttpEmbedder": "remote", "HttpModel": "remote",
    "Config": "plans.config", "Basic": "plans.pipelines", "Hybrid": "plans.pipelines", "Results": "plans.pipelines", "register": "functions.scores",
}
_CALLED = {"bm25_index": "index", "bm25_search": "search", "extract_graph": "extract", "graph_search": "search", "graph_contexts": "contexts", "graph_answers": "answered", "conversations": "answered"}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), _CALLED.get(name, name))


def __dir__():
    return __all__
