"""Model Context Protocol over standard input and output: search_codebase, index_status and reindex."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import TextIO

from siltstone.functions.embedders import Embedder
from siltstone.plans import indexing, searching
from siltstone.sources import repository
from siltstone.sources.config import Config
from siltstone.store import IndexStore, head_key

PROTOCOL, RELATED = "2024-11-05", 5
TOOLS = [
    {
        "name": "search_codebase", "description": "Search the indexed code by meaning and by keyword. Returns ranked chunks.",
        "inputSchema": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "mode": {"type": "string", "enum": [*searching.MODES, "vector"]}, "limit": {"type": "integer"}}},
    },
    {"name": "index_status", "description": "Chunks, edges, last indexed commit and embedding model of the current branch.", "inputSchema": {"type": "object", "properties": {}}},
    {"name": "reindex", "description": "Index the repository: what changed, or all of it the first time.", "inputSchema": {"type": "object", "properties": {}}},
]


class ToolError(Exception):
    pass


@dataclass
class Server:
    store: IndexStore
    embedder: Embedder | None
    config: Config
    root: str

    def search_codebase(self, query: str = "", mode: str = "", limit: int = 0) -> str:
        query = query.strip()
        if not query:
            raise ToolError("a search needs words")
        resolved = searching.resolve_mode(mode, self.config.search.mode)
        searcher = searching.Searcher(self.store, None if resolved == "keyword" else self.embedder, self.config.search, warn=lambda s: None)
        got = searcher.search(self.root, repository.current_branch(self.root), query, resolved, searching.clamp_limit(limit), True, RELATED)
        return searching.as_json(query, got)

    def index_status(self) -> str:
        branch = repository.current_branch(self.root)
        return json.dumps({
            "repo_root": self.root, "branch": branch, "chunk_count": self.store.count_chunks(self.root, branch), "edge_count": self.store.count_edges(self.root, branch),
            "last_commit": self.store.state(head_key(self.root, branch)).strip(), "embedding_model": self.config.embedding.model,
        })

    def reindex(self) -> str:
        branch = repository.current_branch(self.root)
        work = indexing.update_repo if self.store.state(head_key(self.root, branch)).strip() else indexing.index_repo
        work(self.store, self.root, self.config, self.embedder, branch)
        return json.dumps({"status": "ok", "reindexed": True})

    def call(self, name: str, arguments: dict) -> dict:
        """Failures of a tool are results that say so."""
        tools = {"search_codebase": self.search_codebase, "index_status": self.index_status, "reindex": self.reindex}
        if name not in tools:
            raise KeyError(name)
        try:
            return {"content": [{"type": "text", "text": tools[name](**arguments)}]}
        except Exception as e:  # noqa: BLE001
            return {"content": [{"type": "text", "text": str(e)}], "isError": True}

    def answer(self, message: dict) -> dict | None:
        """None for what needs no answer."""
        method, ident, params = message.get("method", ""), message.get("id"), message.get("params") or {}
        if ident is None:
            return None
        reply = {"jsonrpc": "2.0", "id": ident}
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "siltstone", "version": "1.0.0"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": TOOLS}}
        if method == "tools/call":
            try:
                return reply | {"result": self.call(params.get("name", ""), params.get("arguments") or {})}
            except KeyError:
                return reply | {"error": {"code": -32602, "message": f"no such tool: {params.get('name')}"}}
        return reply | {"error": {"code": -32601, "message": f"no such method: {method}"}}

    def serve(self, source: TextIO, sink: TextIO) -> None:
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.answer(json.loads(line))
            except ValueError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
