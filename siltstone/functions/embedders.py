"""Embedding models behind one interface: HTTP services, and a hashing model that needs no network."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import math
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol
from urllib.parse import urlparse


class Embedder(Protocol):
    dimensions: int
    max_batch: int
    model_id: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class EmbeddingError(RuntimeError):
    pass


def model_id(endpoint: str, model: str, dimensions: int) -> str:
    return f'endpoint="{endpoint.strip().rstrip("/")}" model="{model}" dimensions={dimensions}'


def estimated_tokens(text: str) -> int:
    return math.ceil(len(text.encode()) / 3)


def batches(texts: list[str], most: int, most_tokens: int | None = None) -> list[list[str]]:
    """In order, each of at most ``most`` texts and ``most_tokens`` estimated tokens; a text beyond that is alone."""
    out: list[list[str]] = []
    total = 0
    for t in texts:
        n = estimated_tokens(t)
        if not out or len(out[-1]) >= most or (most_tokens is not None and total + n > most_tokens):
            out.append([])
            total = 0
        out[-1].append(t)
        total += n
    return out


def in_order(items: list[dict], count: int, dimensions: int) -> list[list[float]]:
    """Vectors by their index; every index once, every vector of the right length."""
    out: list[list[float] | None] = [None] * count
    if len(items) != count:
        raise EmbeddingError(f"{len(items)} vectors came back for {count} texts")
    for item in items:
        i, v = item["index"], item["embedding"]
        if not 0 <= i < count:
            raise EmbeddingError(f"there is no text {i} to give a vector to")
        if out[i] is not None:
            raise EmbeddingError(f"index {i} came twice")
        if len(v) != dimensions:
            raise EmbeddingError(f"an embedding has {len(v)} dimensions, not {dimensions}")
        out[i] = v
    return out  # type: ignore[return-value]


def check_endpoint(endpoint: str, key: str) -> None:
    """A key goes over https only, or to this machine."""
    url = urlparse(endpoint)
    if url.scheme not in ("http", "https") or not url.hostname:
        raise EmbeddingError(f"not an endpoint: {endpoint!r}")
    if key and url.scheme != "https" and not is_loopback(url.hostname):
        raise EmbeddingError("an API key needs an https endpoint")


def is_loopback(host: str) -> bool:
    if host.lower() == "localhost":
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


@dataclass
class Retry:
    """Rate limits and server errors are tried again; other errors, and a lost network, are not."""

    times: int = 5
    first: float = 1.0
    most: float = 30.0
    jitter: float = 0.5
    sleep: Callable[[float], None] = time.sleep

    def delay(self, attempt: int) -> float:
        return min(self.first * 2**attempt, self.most) + random.uniform(0, self.jitter)


@dataclass
class HttpEmbedder:
    """Services with the ``/embeddings`` request. input_types: what the service calls documents and queries, if it tells them apart."""

    endpoint: str
    model: str
    dimensions: int
    key: str = ""
    max_batch: int = 2048
    most_tokens: int | None = None
    input_types: tuple[str, str] | None = None
    send_dimensions: str | None = None
    retry: Retry = field(default_factory=Retry)
    timeout: float = 60.0

    def __post_init__(self) -> None:
        check_endpoint(self.endpoint, self.key)
        self.model_id = model_id(self.endpoint, self.model, self.dimensions)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for b in batches(texts, self.max_batch, self.most_tokens) for v in self._ask(b, 0)]

    def embed_query(self, text: str) -> list[float]:
        return self._ask([text], 1)[0]

    def _ask(self, texts: list[str], kind: int) -> list[list[float]]:
        body: dict[str, object] = {"input": texts, "model": self.model}
        if self.input_types:
            body["input_type"] = self.input_types[kind]
        if self.send_dimensions:
            body[self.send_dimensions] = self.dimensions
        return in_order(self._post(body)["data"], len(texts), self.dimensions)

    def _post(self, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.endpoint.rstrip("/") + "/embeddings", json.dumps(body).encode(), headers)
        for attempt in range(self.retry.times + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                said = e.read().decode("utf-8", "replace")
                if (e.code != 429 and e.code < 500) or attempt == self.retry.times:
                    raise EmbeddingError(f"HTTP {e.code}: {_message(said)}") from e
                self.retry.sleep(self.retry.delay(attempt))
            except urllib.error.URLError as e:
                raise EmbeddingError(f"the service can't be reached: {e.reason}") from e
        raise AssertionError


def _message(body: str) -> str:
    try:
        found = json.loads(body)
        error = found.get("error", found.get("detail", body))
        return error.get("message", body) if isinstance(error, dict) else str(error)
    except (ValueError, AttributeError):
        return body[:300]


@dataclass
class HashingEmbedder:
    """Signed hashes of words and their character trigrams, summed and scaled to length 1; an empty text is the first axis."""

    dimensions: int = 256
    max_batch: int = 1024

    def __post_init__(self) -> None:
        self.model_id = model_id("local", "hashing", self.dimensions)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.embed_query(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        v = [0.0] * self.dimensions
        for word in text.lower().split():
            for part in [word, *(f"^{word}$"[i : i + 3] for i in range(len(word)))]:
                h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += (1.0 if part is word else 0.5) * (1 if h >> 63 else -1)
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else [1.0] + v[1:]


@dataclass
class OneHotEmbedder:
    """For tests: the i-th document is axis i, a query the axis of its length."""

    dimensions: int = 8
    max_batch: int = 1024
    seen: int = 0

    def __post_init__(self) -> None:
        self.model_id = model_id("local", "one-hot", self.dimensions)

    def _axis(self, i: int) -> list[float]:
        return [float(j == i % self.dimensions) for j in range(self.dimensions)]

    def embed(self, texts: list[str]) -> list[list[float]]:
        self.seen += len(texts)
        return [self._axis(self.seen - len(texts) + i) for i in range(len(texts))]

    def embed_query(self, text: str) -> list[float]:
        return self._axis(len(text))


#: provider: endpoint, environment variable of the key.
_PROVIDERS = {
    "voyage": ("https://api.voyageai.com/v1", "VOYAGE_API_KEY"),
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "ollama": ("http://localhost:11434/v1", ""),
    "custom": ("", ""),
    "hashing": ("", ""),
}


def key_variable(provider: str, configured: str = "") -> str:
    return configured or _PROVIDERS.get(provider.lower(), ("", ""))[1]


def make_embedder(config) -> Embedder:
    """config: the embedding part of a configuration."""
    provider = config.provider.strip().lower()
    if provider not in _PROVIDERS:
        raise EmbeddingError(f"unknown provider {config.provider!r}")
    if config.dimensions <= 0:
        raise EmbeddingError("dimensions must be positive")
    if provider == "hashing":
        return HashingEmbedder(config.dimensions)
    if not config.model:
        raise EmbeddingError("a model is needed")
    endpoint = config.endpoint or _PROVIDERS[provider][0]
    if not endpoint:
        raise EmbeddingError("a custom provider needs an endpoint")
    variable = key_variable(provider, config.api_key_env)
    key = os.environ.get(variable, "") if variable else ""
    if variable and not key:
        raise EmbeddingError(f"environment variable {variable} is not set")
    if provider == "voyage":
        return HttpEmbedder(endpoint, config.model, config.dimensions, key, 128, 100_000, ("document", "query"), "output_dimension")
    return HttpEmbedder(endpoint, config.model, config.dimensions, key, 2048)
