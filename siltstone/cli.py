"""The command line: init, search, update, gc, status, doctor, mcp, version. Anything else is a search.

Exit codes of a search: 0 found, 1 nothing found, 2 not indexed, 3 an error; of the others 0 or 1 (update: 2 where nothing is indexed).
"""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

import siltstone
from siltstone import doctor
from siltstone.functions.embedders import EmbeddingError, make_embedder
from siltstone.plans import indexing, searching
from siltstone.sources import config as settings
from siltstone.sources import repository
from siltstone.store import IndexStore, head_key

COMMANDS = ("init", "search", "update", "gc", "status", "doctor", "mcp", "version", "help", "completion")


class Exit(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("siltstone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_store(root: str, config: settings.Config) -> IndexStore:
    return IndexStore(session(), f"{root}/{settings.HOME}/index", config.embedding.dimensions)


def rewrite(args: list[str]) -> list[str]:
    """``words here`` means ``search words here``; flags may stand before."""
    takes_value = ("--top-k", "--related", "-k")
    i = 0
    while i < len(args):
        a = args[i]
        if a in ("-h", "--help", "--version"):
            return args
        if a == "--":
            return ["search", *args]
        if a.startswith("-"):
            i += 2 if a in takes_value else 1
            continue
        return args if a in COMMANDS else ["search", *args]
    return args


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description="Search the code of a repository.")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("init", help="index the current branch")
    one.add_argument("--reuse-from", default="", metavar="BRANCH", help="copy another branch's index first")
    one = sub.add_parser("search", help="search the index")
    one.add_argument("query", nargs="+")
    for flag in ("keyword", "semantic", "json", "compact", "no-related"):
        one.add_argument(f"--{flag}", action="store_true")
    one.add_argument("--top-k", "-k", type=int, default=0)
    one.add_argument("--related", type=int, default=0)
    sub.add_parser("update", help="index what changed")
    one = sub.add_parser("gc", help="remove what no branch needs")
    one.add_argument("--dry-run", action="store_true")
    for name in ("status", "doctor", "mcp", "version"):
        sub.add_parser(name)
    return p


def _embedder(config: settings.Config):
    """None where no key is set: the index is of texts only."""
    try:
        return make_embedder(config.embedding)
    except EmbeddingError as e:
        if "is not set" in str(e):
            return None
        raise


def _init(args, root: str, config: settings.Config) -> int:
    wrote = indexing.scaffold(root, config)
    store, branch = open_store(root, config), repository.current_branch(root)
    embedder = _embedder(config)
    if embedder is None:
        print("no API key: indexing texts only, for keyword search", file=sys.stderr)
    if args.reuse_from:
        if not store.state(head_key(root, args.reuse_from)):
            raise Exit(1, f"branch {args.reuse_from!r} is not indexed")
        if args.reuse_from != branch:
            store.copy_branch(root, args.reuse_from, branch)
            store.set_state(head_key(root, branch), store.state(head_key(root, args.reuse_from)))
    done = indexing.update_repo(store, root, config, embedder, branch) if args.reuse_from else indexing.index_repo(store, root, config, embedder, branch)
    print(f"indexed {branch}: " + ", ".join(f"{n} {k}" for k, n in done.items()) + "".join(f"; wrote {w}" for w in wrote))
    return 0


def _search(args, root: str, config: settings.Config) -> int:
    if args.keyword and args.semantic:
        raise Exit(3, "choose one of --keyword and --semantic")
    if args.json and args.compact:
        raise Exit(3, "choose one of --json and --compact")
    mode = searching.resolve_mode("keyword" if args.keyword else "semantic" if args.semantic else "", config.search.mode)
    store, branch = open_store(root, config), repository.current_branch(root)
    held = store.state(head_key(root, branch))
    if not held.strip():
        raise Exit(2, f"branch {branch!r} is not indexed")
    embedder = None if mode == "keyword" else _embedder(config)
    if held != (head := repository.head_commit(root)):
        try:
            said, update = indexing.staleness(mode, sum(map(len, repository.diff_files(root, held, head))))
        except repository.NotARepository as e:
            said, update = f"warning: the index is stale, by how much can't be told: {e}", False
        if said:
            print(said, file=sys.stderr)
        if update:
            try:
                indexing.update_repo(store, root, config, embedder, branch)
            except Exception as e:  # noqa: BLE001
                print(f"warning: the update failed ({e}); searching the stale index", file=sys.stderr)
    query = " ".join(args.query)
    got = searching.Searcher(store, embedder, config.search).search(root, branch, query, mode, args.top_k, not args.no_related, args.related)
    if not got.results:
        raise Exit(1, "nothing matches")
    print(searching.as_json(query, got) if args.json else searching.compact(got) if args.compact else searching.human(got), end="\n" if args.json else "")
    return 0


def _update(args, root: str, config: settings.Config) -> int:
    store = open_store(root, config)
    try:
        done = indexing.update_repo(store, root, config, _embedder(config) if store.model_ids() else None)
    except indexing.NotIndexed as e:
        raise Exit(2, str(e)) from e
    print("updated: " + ", ".join(f"{n} {k}" for k, n in done.items()))
    return 0


def _gc(args, root: str, config: settings.Config) -> int:
    done = indexing.collect_garbage(open_store(root, config), root, dry_run=args.dry_run)
    if args.dry_run:
        print(f"GC dry-run: {done['branches']} branches would be pruned")
    else:
        print(f"GC complete: {done['branches']} branches pruned, {done['orphans']} orphaned embeddings deleted, {done['bytes']} bytes reclaimed")
    return 0


def _status(args, root: str, config: settings.Config) -> int:
    store, branch, head = open_store(root, config), repository.current_branch(root), repository.head_commit(root)
    now = indexing.branch_status(store, root, branch, head)
    print(f"Repository: {root}\nCurrent branch: {branch}\nCurrent HEAD: {head[:12]}\nCurrent branch index: {now}\n\nIndexed branches:")
    for b in store.list_branches(root):
        print(f"  {b}: {store.count_chunks(root, b)} chunks" + (f" [{now}]" if b == branch else ""))
    return 0


def _mcp(args, root: str, config: settings.Config) -> int:
    from siltstone.server import Server

    Server(open_store(root, config), _embedder(config), config, root).serve(sys.stdin, sys.stdout)
    return 0


def run(argv: list[str]) -> int:
    args = parser().parse_args(rewrite(argv))
    if args.command == "version":
        print(siltstone.__version__)
        return 0
    failed = 3 if args.command == "search" else 1
    try:
        root = repository.repo_root(os.getcwd())
        if args.command == "doctor":
            return 0 if doctor.run(root, Path(root) / settings.HOME / "config.toml", sys.stdout) else 1
        config = settings.load(root)
        return {"init": _init, "search": _search, "update": _update, "gc": _gc, "status": _status, "mcp": _mcp}[args.command](args, root, config)
    except Exit as e:
        print(f"error: {e}", file=sys.stderr)
        return e.code
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return failed


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
