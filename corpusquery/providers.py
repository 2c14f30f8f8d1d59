"""Models behind the engine: embedders and language models as functions over batches of texts.

A provider has embed(texts) -> list of vectors, embed_tokens(texts) -> list of lists of vectors (real tokens only),
embed_images(list of bytes) -> the same for images, or complete(prompts) -> list of replies (None for a failed call). It is
made on the executors, once for each worker process, by a factory that is sent there. The ones here need neither network nor
key; ``remote`` has those that do.

A model may answer differently each time, so what it said must be kept before it is used twice: the columns made here are
marked as not deterministic, and the pipelines write them to a table first.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a text that an embedder gets at most, unless it has a number of its own (``max_tokens``).
MAX_TOKENS = 8192
_MADE: dict = {}


def usable_key(key: str | None) -> bool:
    """Whether a key is set and isn't a sample file's placeholder."""
    return bool(key and key.strip()) and not key.strip().lower().startswith("your_")


def require_key(key: str | None, name: str) -> str:
    """The key for a remote provider's constructor; a missing one or a placeholder is an error."""
    if not usable_key(key):
        raise ValueError(f"{name} is not set")
    return key.strip()


def checked_dimension(vectors: list[list[float]], dimension: int) -> list[list[float]]:
    """The vectors, all of the declared dimension; any other is an error."""
    for v in vectors:
        if len(v) != dimension:
            raise ValueError(f"a vector of {len(v)} dimensions; {dimension} are declared")
    return vectors


def clipped(texts: list[str], most: int) -> list[str]:
    """The texts, each up to the end of its ``most``-th word."""
    out = []
    for text in texts:
        ends = [m.end() for m, _ in zip(re.finditer(r"\S+", text), range(most + 1))] if len(text) > most else []
        out.append(text[: ends[most - 1]] if len(ends) > most else text)
    return out


def maker(factory: Callable) -> Callable:
    """A function that gives the factory's model, made once for each worker process. Factories are the same if they pickle to the same bytes: their name alone would confuse two of one name."""
    key = hashlib.sha256(cloudpickle.dumps(factory)).digest()

    def made():
        if key not in _MADE:
            _MADE[key] = factory()
        return _MADE[key]

    return made


class HashingEmbedder:
    """A stand-in: a text is the sum of pseudo-random vectors of its words, a token is its word's vector."""

    dimension = 64

    def _vector(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).standard_normal(self.dimension).astype(np.float32)

    def embed_tokens(self, texts: list[str]) -> list[list[list[float]]]:
        return [[self._vector(w).tolist() for w in re.findall(r"\w+", t.lower())] for t in texts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [np.sum([np.zeros(self.dimension), *x], axis=0).astype(float).tolist() for x in self.embed_tokens(texts)]


class LetterEmbedder:
    """A stand-in that SQL can state too: how often each of the letters a to z stands in a text, in either case."""

    dimension = 26

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(low.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for low in (t.translate(_LOWER) for t in texts)]


_LOWER = {k: k + 32 for k in range(65, 91)}


class ExtractiveModel:
    """A stand-in: answers with the first block of the context, rates 0.5, and ranks nothing."""

    def complete(self, prompts: list[str]) -> list[str | None]:
        return ['{"score": 0.5}' if '"score": <' in p else "[]" if "JSON array" in p else (p.split("]\n", 1) + [""])[1].split("\n\n", 1)[0] for p in prompts]


class OverlapModel(ExtractiveModel):
    """A stand-in that reads: it answers as the other one, rates a text by the share of its words that the other text has, and
    ranks passages by the share of the query's words that stand in them. Words are runs of letters a to z and digits, in either case; a text without one has
    the share 0. Scores have two decimal places, those of passages are ten times the share."""

    @staticmethod
    def words(text: str) -> set[str]:
        return set(re.findall("[a-z0-9]+", text.translate(_LOWER)))

    @classmethod
    def share(cls, of: str, text: str) -> int:
        """Hundredths of the first text's words that the second has, rounded down."""
        own = cls.words(of)
        return 100 * len(own & cls.words(text)) // len(own) if own else 0

    def complete(self, prompts: list[str]) -> list[str | None]:
        return [self._rated(p) if '"score": <' in p else self._ranked(p) if "JSON array" in p else x for p, x in zip(prompts, super().complete(prompts), strict=True)]

    def _rated(self, prompt: str) -> str:
        body = prompt.rpartition("\n\nReply with nothing but JSON")[0]
        if "\n\nContext: " in body:  # how much of the answer the context bears out
            context, _, answer = body.partition("\n\nContext: ")[2].rpartition("\n\nAnswer: ")
            n = self.share(answer, context)
        else:
            question, _, text = body.partition("\n\nQuestion: ")[2].partition("\n\nPassage: " if "\n\nPassage: " in body else "\n\nAnswer: ")
            n = self.share(question, text)
        return f'{{"score": {n / 100:.2f}}}'

    def _ranked(self, prompt: str) -> str:
        query, _, rest = prompt.partition('Query: "')[2].rpartition('"\n\nPassages:\n')
        passages = re.findall(r"^\[(\d+)\] (.*)$", rest.rpartition("\n\nReply with")[0], re.MULTILINE)
        return json.dumps([{"index": int(i), "score": self.share(query, text) / 10} for i, text in passages])


def pick_device(wanted: str = "auto") -> str:
    """The device named, or for auto the first there is of cuda, mps and cpu."""
    if wanted != "auto":
        return wanted
    try:
        import torch
    except ImportError:
        return "cpu"
    return "cuda" if torch.cuda.is_available() else "mps" if torch.backends.mps.is_available() else "cpu"


class LateInteraction:
    """A local model of one vector for each token. ``load(name, device)`` is called at the first use, in the worker, and gives
    an object with encode(kind, inputs) -> list of (vectors, mask): kind is document, query or image, and the mask tells real
    tokens from padding, which is left out."""

    def __init__(self, load: Callable, name: str, device: str = "auto"):
        self.load, self.name, self.device, self._model = load, name, device, None

    @property
    def model(self):
        if self._model is None:
            self._model = self.load(self.name, pick_device(self.device))
        return self._model

    def _encoded(self, kind: str, inputs: list) -> list[list[list[float]]]:
        return [np.asarray(v, np.float32)[np.asarray(mask, bool)].tolist() for v, mask in self.model.encode(kind, inputs)] if inputs else []

    def embed_tokens(self, texts: list[str]) -> list[list[list[float]]]:
        return self._encoded("document", texts)

    def embed_queries(self, texts: list[str]) -> list[list[list[float]]]:
        return self._encoded("query", texts)

    def embed_images(self, images: list[bytes]) -> list[list[list[float]]]:
        return self._encoded("image", images)


def embedded(rows: DataFrame, factory: Callable, text: str = "text") -> DataFrame:
    """rows with a column embedding, by batches."""
    made = maker(factory)

    @F.pandas_udf("array<float>")
    def embed(batches: pd.Series) -> pd.Series:
        model = made()
        vectors = model.embed(clipped(batches.fillna("").tolist(), getattr(model, "max_tokens", MAX_TOKENS)))
        return pd.Series(checked_dimension(vectors, model.dimension) if hasattr(model, "dimension") else vectors)

    return rows.withColumn("embedding", embed.asNondeterministic()(text))


def token_embedded(rows: DataFrame, factory: Callable, text: str = "text", queries: bool = False) -> DataFrame:
    """rows with a column embeddings, a vector for each token; ``queries``: as the model embeds queries, if it makes a difference."""
    made = maker(factory)

    @F.pandas_udf("array<array<float>>")
    def embed(batches: pd.Series) -> pd.Series:
        model = made()
        own = getattr(model, "embed_queries", model.embed_tokens) if queries else model.embed_tokens
        return pd.Series(own(clipped(batches.fillna("").tolist(), getattr(model, "max_tokens", MAX_TOKENS))))

    return rows.withColumn("embeddings", embed.asNondeterministic()(text))


def image_embedded(rows: DataFrame, factory: Callable, image: str = "image") -> DataFrame:
    """rows with a column embeddings, the vectors of an image (bytes). A row without an image has none."""
    made = maker(factory)

    @F.pandas_udf("array<array<float>>")
    def embed(batches: pd.Series) -> pd.Series:
        out = pd.Series([[] for _ in range(len(batches))], index=batches.index, dtype=object)
        known = batches[batches.notna()]
        for i, v in zip(known.index, made().embed_images([bytes(x) for x in known]), strict=True):
            out[i] = v
        return out

    return rows.withColumn("embeddings", embed.asNondeterministic()(image))


def completed(prompt: Column, factory: Callable) -> Column:
    """The model's reply to each prompt; a null prompt isn't sent, and has no reply."""
    made = maker(factory)

    @F.pandas_udf("string")
    def complete(prompts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        asked = prompts[prompts.notna()]
        if len(asked):
            out[asked.index] = made().complete(asked.tolist())
        return out

    return complete.asNondeterministic()(prompt)
