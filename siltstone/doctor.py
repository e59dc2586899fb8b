"""Checks of an installation: configuration, key, embedding service, parsers, and how much of the index is dead."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from siltstone.functions.chunker import chunk_file
from siltstone.functions.embedders import EmbeddingError, key_variable, make_embedder
from siltstone.functions.languages import CANONICAL
from siltstone.sources import config as settings

#: A declaration in each language.
SAMPLES = {
    "c": "int add(int a, int b) {\n  return a + b;\n}\n", "cpp": "int add(int a, int b) {\n  return a + b;\n}\n", "go": "package p\n\nfunc Add(a int) int { return a }\n",
    "java": "class A {\n  int add(int a) { return a; }\n}\n", "javascript": "function add(a) { return a }\n", "kotlin": "fun add(a: Int): Int { return a }\n", "python": "def add(a):\n    return a\n",
    "ruby": "def add(a)\n  a\nend\n", "rust": "fn add(a: i32) -> i32 { a }\n", "swift": "func add(a: Int) -> Int { return a }\n", "typescript": "function add(a: number): number { return a }\n",
}
#: Above this share of superseded vectors gc is worth while.
DEAD = 0.5


def checks(root: str, path: Path, store=None) -> Iterator[tuple[str, bool, str]]:
    """label, passed, message."""
    config, skipped = None, "skipped: the configuration is missing or invalid"
    if not path.exists():
        yield "config", False, f"missing file {str(path)!r}"
    else:
        try:
            config = settings.load_file(path)
            yield "config", True, f"{str(path)!r} parses"
        except ValueError as e:
            yield "config", False, f"parse error: {e}"
    if config is None:
        yield "api key", False, skipped
        yield "embedding api", False, skipped
    else:
        name = key_variable(config.embedding.provider, config.embedding.api_key_env)
        if not name:
            yield "api key", True, "none is needed"
        else:
            there = bool(os.environ.get(name, "").strip())
            yield "api key", there, f"{name!r} is set" if there else f"environment variable {name!r} is empty or unset"
        try:
            make_embedder(config.embedding).embed(["a test of the connection"])
            yield "embedding api", True, "reachable"
        except (EmbeddingError, OSError, ValueError) as e:
            yield "embedding api", False, str(e)
    for language, sample in sorted(SAMPLES.items()):
        found = [c for c in chunk_file(f"a{CANONICAL[language]}", root, sample, 200, 1) if c.signature]
        yield f"parser {language}", bool(found), "finds a declaration" if found else "finds none"
    if config is None:
        yield "dead vectors", False, skipped
    elif store is None and not (Path(root) / settings.HOME / "index").exists():
        yield "dead vectors", True, "no index yet"
    else:
        from siltstone.cli import open_store

        share = (store or open_store(root, config)).dead_ratio()
        yield "dead vectors", share <= DEAD, f"{share:.1%}" + ("; run gc" if share > DEAD else "")


def run(root: str, path: Path, out: TextIO, store=None) -> bool:
    good = True
    for label, passed, message in checks(root, path, store):
        out.write(f"{'[ok]' if passed else '[FAIL]'} {label}: {message}\n")
        good &= passed
    return good
