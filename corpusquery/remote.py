"""Providers over HTTP, of the widespread interface with /embeddings and /chat/completions. Only the standard library is needed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from concurrent.futures import ThreadPoolExecutor

from .providers import MAX_TOKENS, checked_dimension, require_key

#: Replies after which a call is tried again.
BUSY = (408, 429, 500, 502, 503, 504)


class _Client:
    def __init__(self, url: str, key: str | None, model: str, timeout: float = 60.0, tries: int = 4, wait: float = 1.0):
        self.url, self.key, self.model = url.rstrip("/"), require_key(key, "the key of the model service"), model
        self.timeout, self.tries, self.wait = timeout, tries, wait

    def post(self, path: str, body: dict) -> dict:
        """The reply to a call, tried again (and waited for twice as long each time) while the service is busy."""
        data = json.dumps({"model": self.model, **body}).encode()
        for left in range(self.tries - 1, -1, -1):
            call = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            try:
                with urllib.request.urlopen(call, timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code not in BUSY or not left:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if not left:
                    raise
            time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise AssertionError


class HttpEmbedder(_Client):
    """One call for each ``batch`` texts; a vector of another dimension than declared is an error."""

    def __init__(self, url: str, key: str | None, model: str, dimension: int, batch: int = 64, max_tokens: int = MAX_TOKENS, **options):
        super().__init__(url, key, model, **options)
        self.dimension, self.batch, self.max_tokens = dimension, batch, max_tokens

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for a in range(0, len(texts), self.batch):
            some = texts[a : a + self.batch]
            rows = sorted(self.post("/embeddings", {"input": some})["data"], key=lambda r: r["index"])
            if len(rows) != len(some):
                raise ValueError(f"{len(some)} texts but {len(rows)} vectors")
            out += [r["embedding"] for r in rows]
        return checked_dimension(out, self.dimension)


class HttpModel(_Client):
    """One call for each prompt, ``parallel`` of them at once. A reply is the text of all its choices, stripped; a call that fails for good has none."""

    def __init__(self, url: str, key: str | None, model: str, parallel: int = 4, **options):
        super().__init__(url, key, model, **options)
        self.parallel = parallel

    def _one(self, prompt: str) -> str | None:
        try:
            reply = self.post("/chat/completions", {"messages": [{"role": "user", "content": prompt}]})
            return "".join(c["message"]["content"] or "" for c in reply["choices"]).strip()
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def complete(self, prompts: list[str]) -> list[str | None]:
        with ThreadPoolExecutor(self.parallel) as pool:
            return list(pool.map(self._one, prompts))
