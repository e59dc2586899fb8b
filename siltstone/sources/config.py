"""Configuration: defaults, over which a TOML file lays what it has."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Where a repository keeps its configuration and index.
HOME = ".siltstone"


@dataclass
class Embedding:
    provider: str = "voyage"
    model: str = "voyage-code-3"
    endpoint: str = ""
    api_key_env: str = ""
    dimensions: int = 1024
    concurrency: int = 1


@dataclass
class Search:
    top_k: int = 10
    mode: str = "hybrid"
    rrf_k: int = 60


@dataclass
class Chunking:
    max_chunk_tokens: int = 1500
    min_chunk_tokens: int = 20


@dataclass
class Repos:
    paths: list[str] = field(default_factory=list)


@dataclass
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    search: Search = field(default_factory=Search)
    chunking: Chunking = field(default_factory=Chunking)
    repos: Repos = field(default_factory=Repos)


def load(repo: str | Path) -> Config:
    return load_file(Path(repo) / HOME / "config.toml")


def load_file(path: str | Path) -> Config:
    """A file that isn't there: the defaults. Unknown keys are passed over, wrong types raise."""
    config = Config()
    if not Path(path).exists():
        return config
    with Path(path).open("rb") as f:
        found = tomllib.load(f)
    for part in fields(config):
        section = getattr(config, part.name)
        for key in fields(section):
            if key.name in found.get(part.name, {}):
                value, now = found[part.name][key.name], getattr(section, key.name)
                if type(value) is not type(now):
                    raise ValueError(f"{path}: {part.name}.{key.name} must be {type(now).__name__}")
                setattr(section, key.name, value)
    return config


def to_toml(config: Config) -> str:
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else str(v)
    parts = []
    for part in fields(config):
        section = getattr(config, part.name)
        parts.append(f"[{part.name}]\n" + "".join(f"{k.name} = {show(getattr(section, k.name))}\n" for k in fields(section)))
    return "\n".join(parts)
