"""Indexing: a whole repository, what changed in it, and what can go."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.embedders import Embedder
from siltstone.operators.chunking import chunk_files, embed_rows, extract_references, signature_names, with_hash
from siltstone.operators.graph import build_edges
from siltstone.session import materialize
from siltstone.sources import repository
from siltstone.sources.config import HOME, Config, to_toml
from siltstone.store import IndexStore, head_key

#: Changed files up to which a search updates the index by itself, and up to which it only says so mildly.
AUTO_UPDATE, MILD = 10, 50


class NotIndexed(RuntimeError):
    pass


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_path, change (added, modified or deleted) between two tables of file_path, file_hash; a rename is both."""
    both = old.select("file_path", F.col("file_hash").alias("_old")).join(new.select("file_path", F.col("file_hash").alias("_new")), "file_path", "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified")
    return both.select("file_path", change.alias("change")).where("change is not null")


def split_new(chunks: DataFrame, held: DataFrame) -> DataFrame:
    """Chunks (with content_hash) and ``is_new``: whether the row is the first of a hash that ``held`` doesn't have, so its text must be embedded."""
    first = chunks.groupBy("content_hash").agg(F.min(F.struct("file_path", "chunk_index")).alias("_first"))
    new = first.join(held.select("content_hash").distinct(), "content_hash", "left_anti")
    marked = chunks.join(new, "content_hash", "left")
    return marked.withColumn("is_new", F.coalesce(F.col("_first") == F.struct("file_path", "chunk_index"), F.lit(False))).drop("_first")


def _embed_and_map(store: IndexStore, chunks: DataFrame, embedder: Embedder | None) -> None:
    if chunks.isEmpty():
        return
    if embedder is None:
        store.upsert_text_only(chunks)
        return
    held = store.read("embeddings").where(F.col("model_id") == embedder.model_id)
    hashed = materialize(split_new(with_hash(chunks), held), "chunks")
    new = hashed.where("is_new").drop("is_new", "content_hash")
    if not new.isEmpty():
        text = T.embed_text(F.col("annotation"), F.col("content")).alias("_text")
        made = materialize(embed_rows(new.select("*", text), embedder, "_text"), "vectors")  # the model is asked once
        store.upsert_chunks(made.drop("_text"), embedder.model_id)
    store.upsert_mappings(hashed.drop("is_new", "content_hash"), embedder.model_id)


def rebuild_edges(store: IndexStore, root: str, branch: str) -> None:
    chunks = store.all_chunks(root, branch)
    store.replace_edges(root, branch, build_edges(extract_references(chunks), signature_names(chunks)))


def counts_of(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, n of every file; 0 where it has no chunks."""
    n = chunks.groupBy("file_path").agg(F.count("*").alias("n"))
    return files.select("file_path").join(n, "file_path", "left").select("file_path", F.coalesce("n", F.lit(0)).alias("n"))


def index_repo(store: IndexStore, root: str, config: Config, embedder: Embedder | None, branch: str | None = None, paths: list[str] | None = None) -> dict[str, int]:
    """Indexes all files of the working tree. Run again after a failure it does what is left."""
    branch = branch or repository.current_branch(root)
    head = repository.head_commit(root)
    paths = repository.walk_files(root) if paths is None else paths
    files = repository.read_listed(store.spark, root, paths)
    chunks = materialize(chunk_files(files, root, branch, config.chunking.max_chunk_tokens, config.chunking.min_chunk_tokens), "chunks")
    _embed_and_map(store, chunks, embedder)
    store.prune_tails(root, branch, counts_of(files, chunks), unseen_go=True)
    rebuild_edges(store, root, branch)
    store.rebuild_keyword_index()
    store.set_state(head_key(root, branch), head)
    store.set_file_hashes(root, branch, files)
    return {"files": len(paths), "chunks": store.count_chunks(root, branch)}


def update_repo(store: IndexStore, root: str, config: Config, embedder: Embedder | None, branch: str | None = None) -> dict[str, int]:
    """Brings a branch up to date: files whose bytes changed, came, went, or are ignored now."""
    branch = branch or repository.current_branch(root)
    if not store.state(head_key(root, branch)):
        raise NotIndexed(f"branch {branch!r} is not indexed")
    if embedder is None and store.model_ids():
        raise ValueError("the index has vectors: an embedding model is needed")
    head = repository.head_commit(root)
    files = repository.read_listed(store.spark, root, repository.walk_files(root))
    hashes = materialize(files.select("file_path", "file_hash"), "hashes")
    changes = classify_changes(store.file_hashes(root, branch), hashes).collect()  # names of what changed
    by = {kind: sorted(r["file_path"] for r in changes if r["change"] == kind) for kind in ("added", "modified", "deleted")}
    if changes:
        if by["deleted"]:
            store.delete_files(root, branch, by["deleted"])
        if changed := by["added"] + by["modified"]:
            own = repository.read_listed(store.spark, root, changed)
            chunks = materialize(chunk_files(own, root, branch, config.chunking.max_chunk_tokens, config.chunking.min_chunk_tokens), "chunks")
            _embed_and_map(store, chunks, embedder)
            store.prune_tails(root, branch, counts_of(own, chunks))
        rebuild_edges(store, root, branch)
        store.rebuild_keyword_index()
        store.set_file_hashes(root, branch, hashes)
    store.set_state(head_key(root, branch), head)
    return {k: len(v) for k, v in by.items()}


def collect_garbage(store: IndexStore, root: str, branches: list[str] | None = None, dry_run: bool = False) -> dict[str, int]:
    """Branches that the repository doesn't have any more go, then vectors that no chunk uses, then old folders."""
    known = set(repository.list_branches(root) if branches is None else branches)
    stale = [b for b in store.list_branches(root) if b not in known]
    if dry_run:
        return {"branches": len(stale), "orphans": 0, "bytes": 0}
    before = store.bytes()
    for b in stale:
        store.delete_branch(root, b)
        store.delete_state(head_key(root, b))
        store.set_file_hashes(root, b, None)
    orphans = store.delete_orphans()
    store.compact_vectors()
    store.rebuild_keyword_index()
    store.vacuum()
    return {"branches": len(stale), "orphans": orphans, "bytes": max(0, before - store.bytes())}


def staleness(mode: str, changed: int) -> tuple[str, bool]:
    """What to say of so many changed files, and whether to update first."""
    if changed <= 0:
        return "", False
    if changed <= AUTO_UPDATE and mode != "keyword":
        return f"index is stale ({changed} files changed), updating it first", True
    if changed <= MILD:
        return f"index is stale: {changed} files changed", False
    return f"index is significantly stale: {changed} files changed; run update", False


def branch_status(store: IndexStore, root: str, branch: str, head: str) -> str:
    held = store.state(head_key(root, branch))
    if not held:
        return "not indexed"
    if held == head:
        return "up to date"
    changed = sum(map(len, repository.diff_files(root, held, head)))
    return f"stale ({changed} files changed)"


def scaffold(root: str, config: Config | None = None) -> list[str]:
    """The index's folder in .gitignore, and a configuration file; what was written. Files that are there stay."""
    wrote = []
    ignore = Path(root) / ".gitignore"
    lines = ignore.read_text().splitlines() if ignore.exists() else []
    if not any(line.strip().strip("/") == HOME for line in lines):
        ignore.write_text("\n".join([*lines, f"{HOME}/"]) + "\n")
        wrote.append(".gitignore")
    target = Path(root) / HOME / "config.toml"
    if not target.exists():
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(to_toml(config or Config()))
        wrote.append(f"{HOME}/config.toml")
    return wrote


Progress = Callable[[str], None]
