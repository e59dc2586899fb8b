"""Search in a store: modes, fusion, related results, and how results are written."""

from __future__ import annotations

import json
import sys
import threading
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltstone.functions.embedders import Embedder
from siltstone.operators.fusion import rrf
from siltstone.sources.config import Search
from siltstone.store import IndexStore

MODES = ("hybrid", "semantic", "keyword")
DEFAULT_TOP_K, DEFAULT_RRF_K, DEFAULT_RELATED = 10, 60.0, 5
PREVIEW = 120
#: What a result has as JSON.
FIELDS = ("file_path", "start_line", "end_line", "language", "score", "content", "chunk_index")


def resolve_mode(override: str, default: str) -> str:
    """The first that is given, else hybrid; ``vector`` is semantic. Others raise."""
    for given in (override, default):
        if name := given.strip().lower():
            name = "semantic" if name == "vector" else name
            if name not in MODES:
                raise ValueError(f"unknown search mode {given!r}")
            return name
    return "hybrid"


def resolve_top_k(override: int, configured: int) -> int:
    return next((k for k in (override, configured) if k > 0), DEFAULT_TOP_K)


def resolve_rrf_k(configured: float) -> float:
    return configured if configured > 0 else DEFAULT_RRF_K


def clamp_limit(limit: int) -> int:
    """What a remote caller may ask for: 1 to 100, 10 if it doesn't say."""
    return DEFAULT_TOP_K if limit <= 0 else min(limit, 100)


class QueryCache:
    """The vectors of the latest queries; the least lately used one goes first."""

    def __init__(self, size: int = 100):
        self.size, self._held, self._lock = size, OrderedDict(), threading.Lock()

    def get(self, query: str) -> list[float] | None:
        with self._lock:
            if query not in self._held:
                return None
            self._held.move_to_end(query)
            return list(self._held[query])

    def put(self, query: str, vector: list[float]) -> None:
        with self._lock:
            self._held[query] = list(vector)
            self._held.move_to_end(query)
            while len(self._held) > self.size:
                self._held.popitem(last=False)


@dataclass
class Response:
    mode: str
    results: list[Row]
    related: list[Row] = field(default_factory=list)


@dataclass
class Searcher:
    store: IndexStore
    embedder: Embedder | None
    config: Search = field(default_factory=Search)
    warn: Callable[[str], None] = lambda s: print(f"warning: {s}", file=sys.stderr)
    cache: QueryCache = field(default_factory=QueryCache)

    def _vector(self, query: str) -> list[float]:
        if (held := self.cache.get(query)) is not None:
            return held
        if self.embedder is None:
            raise RuntimeError("no embedding model")
        got = self.embedder.embed_query(query)
        self.cache.put(query, got)
        return got

    def search(self, repo_root: str, branch: str, query: str, mode: str = "", top_k: int = 0, include_related: bool = True, n_related: int = 0) -> Response:
        """Hybrid search goes on as keyword search where the query can't be embedded."""
        query = query.strip()
        if not query:
            raise ValueError("an empty query")
        mode, k = resolve_mode(mode, self.config.mode), resolve_top_k(top_k, self.config.top_k)
        vector = None
        if mode != "keyword":
            try:
                vector = self._vector(query)
            except Exception as e:
                if mode == "semantic":
                    raise
                self.warn(f"the query can't be embedded ({e}); searching by keyword")
                mode = "keyword"
        lists: list[DataFrame] = []
        if vector is not None:
            lists.append(self.store.search_vector(repo_root, branch, vector, k))
        if mode != "semantic":
            lists.append(self.store.search_keyword(repo_root, branch, query, k))
        found = lists[0] if len(lists) == 1 else rrf([x.drop("score") for x in lists], resolve_rrf_k(self.config.rrf_k), k)
        results = sorted(found.collect(), key=lambda r: r["rank"])  # k rows
        related: list[Row] = []
        if include_related and results:
            try:
                related = self._related(repo_root, branch, results, n_related or DEFAULT_RELATED)
            except Exception as e:  # noqa: BLE001
                self.warn(f"no related results: {e}")
        return Response(mode, results, related)

    def _related(self, repo_root: str, branch: str, results: list[Row], n: int) -> list[Row]:
        hashes = sorted({r["content_hash"] for r in results if r["content_hash"]})
        if not hashes or n <= 0:
            return []
        main = self.store.spark.createDataFrame([(h,) for h in hashes], "content_hash string")
        return sorted(self.store.find_related(repo_root, branch, main, n).collect(), key=lambda r: r["rank"])


# Output -------------------------------------------------------------------------------------------------


def _place(r: Row) -> str:
    return f"{r['file_path']}:{r['start_line']}-{r['end_line']}"


def human(response: Response) -> str:
    def block(label: str, r: Row) -> str:
        return f"{label} {r['score']:.2f}  {_place(r)} ({r['language']})\n" + "".join(f"    {line}\n" for line in r["content"].split("\n"))

    out = "\n".join(block(f"[{i}]", r) for i, r in enumerate(response.results, 1))
    if response.related:
        out += "\n--- Related ---\n" + "\n".join(block(f"[R{i}]", r) for i, r in enumerate(response.related, 1))
    return out


def as_json(query: str, response: Response) -> str:
    rows = lambda found: [{k: r[k] for k in FIELDS} for r in found]
    return json.dumps({"query": query, "mode": response.mode, "results": rows(response.results), "related": rows(response.related)}, ensure_ascii=False)


def preview(content: str, most: int = PREVIEW) -> str:
    """The first line, cut to ``most`` bytes with three dots, never within a character."""
    line = content.split("\n", 1)[0].strip()
    raw = line.encode()
    return line if most <= 0 or len(raw) <= most else raw[:most].decode(errors="ignore") if most <= 3 else raw[: most - 3].decode(errors="ignore") + "..."


def compact(response: Response) -> str:
    line = lambda r, mark="": f"{mark}{r['score']:.2f}\t{_place(r)}\t{preview(r['content'])}\n"
    out = "".join(line(r) for r in response.results)
    return out + ("\n" + "".join(line(r, "R ") for r in response.related) if response.related else "")


def compact_lines(rows: DataFrame) -> DataFrame:
    """The same of a table, as a column ``line``."""
    from siltstone.functions.text import preview as cut

    place = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return rows.withColumn("line", F.concat_ws("\t", F.format_string("%.2f", F.col("score")), place, cut(F.col("content"))))


def json_lines(rows: DataFrame) -> DataFrame:
    """The results of ``as_json`` of a table, as a column ``json``: what each row has of the fields, in their order."""
    shown = [c for c in FIELDS if c in rows.columns]
    return rows.withColumn("json", F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}))
