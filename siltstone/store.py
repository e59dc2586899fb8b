"""The index: chunks, vectors, call edges and file hashes of repositories and their branches.

A store is a folder on any file system that Spark writes to. Tables are immutable Parquet folders; a
manifest names those that are current, for each table by scope (repository and branch). A change writes
new folders for the scopes it touches, then the next manifest, whose name nobody else may have taken: a
reader sees all of a change or nothing, a second writer fails, and a lost executor costs a retry. Vectors
are shared by all scopes and only appended to; the first writer of a hash wins. ``vacuum`` removes folders
that no manifest names any more.

A store has one embedding model. Text-only rows have none: they are replaced when vectors come.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import graph, keyword, vector
from siltstone.operators.chunking import CHUNKS
from siltstone.session import materialize

TEXT_ONLY = "text-only"
KEYS = ("repo_root", "branch", "file_path", "chunk_index")
SCHEMAS = {
    "chunks": CHUNKS.replace("content string", "content_hash string"),
    "embeddings": "content_hash string, model_id string, chunk_text string, embedding array<float>, created_at timestamp, seq long",
    "edges": "source_hash string, target_hash string, repo_root string, branch string",
    "files": "repo_root string, branch string, file_path string, file_hash string",
    "postings": "term string, id string, size long, places array<long>",
}
#: Columns that keyword search reads.
SEARCHED = ("annotation", "signature", "chunk_text")
RESULT = ("repo_root", "branch", "file_path", "chunk_index", "content", "language", "start_line", "end_line", "content_hash")


class StoreError(RuntimeError):
    pass


def scope_of(repo_root: str, branch: str) -> str:
    return json.dumps([repo_root, branch])


def _binary(df: DataFrame) -> DataFrame:
    """Hashes as bytes while rows are shuffled: half of the hexadecimal digits, which don't compress."""
    return df.withColumn("content_hash", F.unhex("content_hash"))


def _hexadecimal(df: DataFrame) -> DataFrame:
    return df.withColumn("content_hash", F.lower(F.hex("content_hash")))


def head_key(repo_root: str, branch: str) -> str:
    return f"head_commit:{repo_root}:{branch}"


def _columns(df: DataFrame, name: str, *more: Column) -> DataFrame:
    return df.select(*(c.split()[0] for c in SCHEMAS[name].split(", ")), *more)


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, dimensions: int):
        self.spark, self.path, self.dimensions = spark, path.rstrip("/"), dimensions
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._read_manifest()

    # Manifests ------------------------------------------------------------------------------------------

    def _read_manifest(self) -> None:
        folder = self._fs_path(f"{self.path}/manifests")
        self._fs.mkdirs(folder)
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder))
        self.version = int(names[-1].split(".")[0]) if names else 0
        self.manifest: dict = {"parts": {t: {} for t in SCHEMAS}, "state": {}, "sizes": {}}
        if names:
            stream = self._fs.open(self._fs_path(f"{self.path}/manifests/{names[-1]}"))
            self.manifest = json.loads(bytes(stream.readAllBytes()))
            stream.close()

    def _commit(self, change: Callable[[dict], None]) -> None:
        new = json.loads(json.dumps(self.manifest))
        change(new)
        target = self._fs_path(f"{self.path}/manifests/{self.version + 1:012d}.json")
        draft = self._fs_path(f"{self.path}/manifests-drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        stream.write(json.dumps(new).encode())
        stream.close()
        # a rename that fails where the target is there takes a name once; on object stores without one, writers must take turns by themselves
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise StoreError("another writer was faster; open the store again")
        self.manifest, self.version = new, self.version + 1

    def _write(self, df: DataFrame, name: str) -> str:
        """Writes a folder of a table; its name, to be put in the manifest."""
        part = f"{name}/{self.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        _columns(df, name).write.option("compression", "zstd").parquet(f"{self.path}/{part}")
        return part

    def _write_by(self, df: DataFrame, name: str, key: str) -> str:
        """The same with a folder ``scope=`` for each value of ``key``, in one job; df is sorted by it first, or will be."""
        part = f"{name}/{self.version + 1:012d}-{uuid.uuid4().hex[:12]}"
        _columns(df, name, F.col(key).alias("scope")).write.option("compression", "zstd").partitionBy("scope").parquet(f"{self.path}/{part}")
        return part

    def _parts(self, name: str, scopes: Iterable[str] | None = None) -> list[str]:
        by = self.manifest["parts"][name]
        return [f"{self.path}/{p}" for s in (by if scopes is None else scopes) for p in by.get(s, [])]

    def read(self, name: str, repo_root: str | None = None, branch: str | None = None) -> DataFrame:
        """A table, or what it has of one scope: other scopes' folders aren't opened."""
        parts = self._parts(name, None if repo_root is None else [scope_of(repo_root, branch)])
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*parts)

    def _replace(self, name: str, scope: str, df: DataFrame | None, *more: str) -> Callable[[dict], None]:
        """Rows of a scope, and folders that are written already."""
        parts = ([] if df is None else [self._write(df, name)]) + [*more]

        def change(m: dict) -> None:
            m["parts"][name].pop(scope, None)
            if parts:
                m["parts"][name][scope] = parts
            if name == "chunks":  # its index is of other rows now
                m["parts"]["postings"].pop(scope, None)
                m["sizes"].pop(scope, None)

        return change

    # Writes ---------------------------------------------------------------------------------------------

    def model_ids(self) -> list[str]:
        """Two at most: a store has one."""
        return sorted(r[0] for r in self.read("embeddings").where(F.col("model_id") != TEXT_ONLY).select("model_id").distinct().limit(2).collect())

    def _check_model(self, model_id: str) -> None:
        if model_id != TEXT_ONLY and (held := self.model_ids()) and held != [model_id]:
            raise StoreError(f"the store has vectors of {held[0]!r}: refusing to mix them with those of {model_id!r}")

    def _hashed(self, chunks: DataFrame) -> DataFrame:
        """With ``_at``, the place of a row in its batch; chunks that have one keep it, so that nobody needs to sort them."""
        at = F.col("_at") if "_at" in chunks.columns else F.monotonically_increasing_id()
        return chunks.withColumns({"content_hash": T.content_hash(F.col("content")), "chunk_text": T.normalize_for_hash(F.col("content")), "_at": at})

    def _append_vectors(self, rows: DataFrame, model_id: str) -> Callable[[dict], None]:
        """rows: content_hash, chunk_text, embedding, _at. Hashes that the model has already stay as they are, and of rows with one hash the first counts; text-only ones give way to vectors."""
        there = self.read("embeddings").where(F.col("model_id") == model_id).select("content_hash")
        once = _hexadecimal(_binary(rows).groupBy("content_hash").agg(F.min_by(F.struct("chunk_text", "embedding"), "_at").alias("r")).select("content_hash", "r.*"))
        new = once.join(there, "content_hash", "left_anti")
        part = self._write(new.select("*", F.lit(model_id).alias("model_id"), F.current_timestamp().alias("created_at"), F.lit(self.version + 1).cast("long").alias("seq")), "embeddings")
        return lambda m: m["parts"]["embeddings"].setdefault("", []).append(part)

    def _mapped(self, hashed: DataFrame) -> list[Callable[[dict], None]]:
        """Upserts by file and index; of rows with one key in a batch the last one wins. All scopes of the batch are written by one job, rows that stay by one for each scope."""
        own = _binary(_columns(hashed, "chunks", "_at")).withColumn("_scope", F.xxhash64("repo_root", "branch"))  # texts stay where they are
        keyed = own.withColumn("_n", F.row_number().over(Window.partitionBy("_scope", *KEYS).orderBy(F.desc("_at"))))
        part = self._write_by(_hexadecimal(keyed.where("_n = 1")), "chunks", "_scope")
        new = self.spark.read.schema(f"{SCHEMAS['chunks']}, scope long").parquet(f"{self.path}/{part}")
        scopes = new.select("scope", "repo_root", "branch").distinct().collect()  # the scopes of a batch
        if len({r["scope"] for r in scopes}) < len(scopes):
            raise StoreError("two scopes of a batch have one hash")
        changes = []
        for n, root, branch in scopes:
            rest = None
            if self._parts("chunks", [scope_of(root, branch)]):
                rest = self.read("chunks", root, branch).join(new.where(F.col("scope") == n).select(*KEYS), [*KEYS], "left_anti")
            changes.append(self._replace("chunks", scope_of(root, branch), rest, f"{part}/scope={n}"))
        return changes

    def _all(self, changes: list[Callable[[dict], None]]) -> None:
        self._commit(lambda m: [c(m) for c in changes] and None)

    def upsert_chunks(self, chunks: DataFrame, model_id: str, vector_col: str = "embedding") -> None:
        """chunks with a vector each. Model and vector lengths are checked before anything is written."""
        self._check_model(model_id)
        wrong = chunks.where(F.coalesce(F.size(vector_col), F.lit(-1)) != self.dimensions).select(F.size(vector_col)).first()
        if wrong is not None:
            raise StoreError(f"a vector has {wrong[0]} dimensions, the store {self.dimensions}")
        hashed = self._hashed(chunks)
        vectors = self._append_vectors(hashed.select("content_hash", "chunk_text", F.col(vector_col).cast("array<float>").alias("embedding"), "_at"), model_id)
        self._all([vectors, *self._mapped(hashed)])

    def upsert_text_only(self, chunks: DataFrame) -> None:
        hashed = self._hashed(chunks)
        known = hashed.join(self.read("embeddings").select("content_hash"), "content_hash", "left_anti")
        texts = self._append_vectors(known.select("content_hash", "chunk_text", F.lit(None).cast("array<float>").alias("embedding"), "_at"), TEXT_ONLY)
        self._all([texts, *self._mapped(hashed)])

    def upsert_mappings(self, chunks: DataFrame, model_id: str) -> None:
        """Chunks whose vectors are there already."""
        self._check_model(model_id)
        hashed = self._hashed(chunks)
        there = self.read("embeddings").where(F.col("model_id") == model_id).select("content_hash")
        missing = hashed.join(there, "content_hash", "left_anti").select("content_hash").first()
        if missing is not None:
            raise StoreError(f"no embedding of {missing[0]}")
        self._all(self._mapped(hashed))

    def delete_files(self, repo_root: str, branch: str, paths: list[str]) -> None:
        """Their chunks; vectors stay."""
        gone = self.spark.createDataFrame([(p,) for p in paths], "file_path string")
        self._all([self._replace("chunks", scope_of(repo_root, branch), self.read("chunks", repo_root, branch).join(gone, "file_path", "left_anti"))])

    def trim_file(self, repo_root: str, branch: str, path: str, first: int) -> None:
        """Removes the chunks of a file from ``first`` on."""
        if first < 0:
            raise StoreError(f"a chunk index can't be negative: {first}")
        self._all([self._replace("chunks", scope_of(repo_root, branch), self.read("chunks", repo_root, branch).where((F.col("file_path") != path) | (F.col("chunk_index") < first)))])

    def prune_tails(self, repo_root: str, branch: str, counts: DataFrame, unseen_go: bool = False) -> None:
        """counts: file_path, n: a file keeps its first n chunks. unseen_go: files that aren't counted lose all."""
        joined = _hexadecimal(_binary(self.read("chunks", repo_root, branch)).join(counts.select("file_path", "n"), "file_path", "left"))
        self._all([self._replace("chunks", scope_of(repo_root, branch), joined.where(F.col("chunk_index") < F.coalesce("n", F.lit(0 if unseen_go else 1 << 31))))])

    def delete_branch(self, repo_root: str, branch: str) -> None:
        scope = scope_of(repo_root, branch)
        self._all([self._replace("edges", scope, None), self._replace("chunks", scope, None)])

    def copy_branch(self, repo_root: str, source: str, to: str) -> None:
        """Chunks, edges and file hashes, into a branch that has none of either."""
        scope = scope_of(repo_root, to)
        for name in ("chunks", "edges", "files"):
            if self.manifest["parts"][name].get(scope) and not self.read(name, repo_root, to).isEmpty():
                raise StoreError(f"branch {to!r} has {name} already")
        self._all([self._replace(n, scope, self.read(n, repo_root, source).withColumn("branch", F.lit(to))) for n in ("chunks", "edges", "files")])

    def upsert_edges(self, edges: DataFrame) -> None:
        changes = []
        for r in edges.select("repo_root", "branch").distinct().collect():
            own = edges.where((F.col("repo_root") == r[0]) & (F.col("branch") == r[1])).select("source_hash", "target_hash", "repo_root", "branch")
            changes.append(self._replace("edges", scope_of(r[0], r[1]), self.read("edges", r[0], r[1]).unionByName(own).distinct()))
        if changes:
            self._all(changes)

    def replace_edges(self, repo_root: str, branch: str, edges: DataFrame | None) -> None:
        self._all([self._replace("edges", scope_of(repo_root, branch), edges)])

    def delete_edges_by_file(self, repo_root: str, branch: str, path: str) -> None:
        """Edges from chunks of a file."""
        own = self.read("chunks", repo_root, branch).where(F.col("file_path") == path).select(F.col("content_hash").alias("source_hash"))
        self.replace_edges(repo_root, branch, self.read("edges", repo_root, branch).join(own, "source_hash", "left_anti"))

    def set_file_hashes(self, repo_root: str, branch: str, files: DataFrame | None) -> None:
        """Replaces those of the scope. files: file_path, file_hash."""
        rows = None if files is None else files.select(F.lit(repo_root).alias("repo_root"), F.lit(branch).alias("branch"), "file_path", "file_hash")
        self._all([self._replace("files", scope_of(repo_root, branch), rows)])

    def set_state(self, key: str, value: str) -> None:
        self._commit(lambda m: m["state"].__setitem__(key, value))

    def delete_state(self, key: str) -> None:
        self._commit(lambda m: m["state"].pop(key, None) and None)

    # Upkeep ---------------------------------------------------------------------------------------------

    def delete_orphans(self) -> int:
        """Vectors whose hash no chunk has; how many went."""
        held, used = self.read("embeddings"), self.read("chunks").select("content_hash")
        gone = held.join(used, "content_hash", "left_anti").count()
        if gone:
            part = self._write(held.join(used, "content_hash", "left_semi"), "embeddings")
            self._commit(lambda m: m["parts"]["embeddings"].__setitem__("", [part]))
        return gone

    def compact_vectors(self) -> None:
        """One row for each hash, the newest; in one folder."""
        part = self._write(self.latest(), "embeddings")
        self._commit(lambda m: m["parts"]["embeddings"].__setitem__("", [part]))

    def latest(self, hashes: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
        """The newest row of each hash (of ``hashes``, where they are given: others aren't grouped); one with a vector before one without. columns: those to bring along, else all."""
        rows = self.read("embeddings")
        if hashes is not None:
            rows = rows.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi")
        newest = F.struct((F.col("model_id") != TEXT_ONLY).alias("v"), "seq")
        kept = [c for c in rows.columns if c != "content_hash"] if columns is None else columns
        picked = _binary(rows).groupBy("content_hash").agg(F.max_by(F.struct(*kept), newest).alias("r"))
        return _hexadecimal(picked.select("content_hash", "r.*"))

    def dead_ratio(self) -> float:
        """The share of vector rows that newer ones have superseded; 0 of an empty store."""
        total, live = self.read("embeddings").agg(F.count("*"), F.count_distinct("content_hash")).first()
        return max(0.0, (total - live) / total) if total else 0.0

    def vacuum(self) -> int:
        """Removes folders that the current manifest doesn't name, and older manifests; how many folders went."""
        named, gone = {"/".join(p.split("/")[:2]) for by in self.manifest["parts"].values() for ps in by.values() for p in ps}, 0
        for name in SCHEMAS:
            folder = self._fs_path(f"{self.path}/{name}")
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if f"{name}/{f.getPath().getName()}" not in named:
                    self._fs.delete(f.getPath(), True)
                    gone += 1
        for f in self._fs.listStatus(self._fs_path(f"{self.path}/manifests")):
            if int(f.getPath().getName().split(".")[0]) < self.version:
                self._fs.delete(f.getPath(), False)
        self._fs.delete(self._fs_path(f"{self.path}/manifests-drafts"), True)
        return gone

    def bytes(self) -> int:
        return self._fs.getContentSummary(self._fs_path(self.path)).getLength()

    def rebuild_keyword_index(self) -> None:
        """Postings of every scope that has none, sorted by term: a query's terms are found by the files' statistics."""
        scopes = [s for s, parts in self.manifest["parts"]["chunks"].items() if parts and s not in self.manifest["sizes"]]
        if not scopes:
            return
        own = reduce(DataFrame.unionByName, (self.read("chunks", *json.loads(s)).withColumn("_scope", F.lit(i)) for i, s in enumerate(scopes)))
        made = materialize(keyword.postings(self._with_texts(own), "_id", SEARCHED, ("_scope",)), "postings")  # so that ranges are cut without making them twice
        part = self._write_by(made.repartitionByRange("_scope", "term", "id").sortWithinPartitions("_scope", "term"), "postings", "_scope")
        rows = {r["_scope"]: r["count"] for r in own.groupBy("_scope").count().collect()}  # a row for each scope
        terms = {r["_scope"]: r["n"] for r in made.groupBy("_scope").agg(F.sum(F.size("places")).alias("n")).collect()}  # a term's places are all there are of it

        def change(m: dict) -> None:
            for i, s in enumerate(scopes):
                m["parts"]["postings"][s] = [f"{part}/scope={i}"] if i in terms else []
                m["sizes"][s] = [rows.get(i, 0), terms.get(i, 0)]

        self._commit(change)

    # Reads ----------------------------------------------------------------------------------------------

    def texts(self, hashes: DataFrame | None = None) -> DataFrame:
        return self.latest(hashes, ["chunk_text"])

    def all_chunks(self, repo_root: str | None = None, branch: str | None = None) -> DataFrame:
        """Chunks with ``content``, the newest text of their hash or an empty one; ordered by file and index."""
        own = self.read("chunks", repo_root, branch)
        joined = own.join(self.texts(None if repo_root is None else own), "content_hash", "left").withColumn("content", F.coalesce("chunk_text", F.lit(""))).drop("chunk_text")
        return joined.orderBy("file_path", "chunk_index")

    def _searched(self, repo_root: str | None = None, branch: str | None = None) -> DataFrame:
        return self._with_texts(self.read("chunks", repo_root, branch))

    def _with_texts(self, chunks: DataFrame) -> DataFrame:
        return _keyed(chunks).join(self.texts(chunks), "content_hash", "left").withColumn("chunk_text", F.coalesce("chunk_text", F.lit("")))

    def has_hashes(self, hashes: DataFrame, model_id: str) -> DataFrame:
        """content_hash, there: of each distinct hash asked for."""
        held = self.read("embeddings").where(F.col("model_id") == model_id).select("content_hash", F.lit(True).alias("there")).distinct()
        return hashes.select("content_hash").distinct().join(held, "content_hash", "left").select("content_hash", F.coalesce("there", F.lit(False)).alias("there"))

    def file_hashes(self, repo_root: str, branch: str) -> DataFrame:
        return self.read("files", repo_root, branch).select("file_path", "file_hash")

    def list_files(self, repo_root: str, branch: str) -> DataFrame:
        return self.read("chunks", repo_root, branch).select("file_path").distinct().orderBy("file_path")

    def list_branches(self, repo_root: str) -> list[str]:
        """Those with chunks, and those that were indexed without any; sorted."""
        prefix = head_key(repo_root, "")
        held = [json.loads(s) for s, parts in self.manifest["parts"]["chunks"].items() if parts]
        with_rows = {b for r, b in held if r == repo_root and not self.read("chunks", r, b).isEmpty()}
        return sorted(with_rows | {k.removeprefix(prefix) for k in self.state_keys(prefix)})

    def state(self, key: str) -> str:
        return self.manifest["state"].get(key, "")

    def state_keys(self, prefix: str) -> list[str]:
        return sorted(k for k in self.manifest["state"] if k.startswith(prefix))

    def count_chunks(self, repo_root: str, branch: str) -> int:
        return self.read("chunks", repo_root, branch).count()

    def count_edges(self, repo_root: str, branch: str) -> int:
        return self.read("edges", repo_root, branch).count()

    def search_vector(self, repo_root: str, branch: str, query: list[float], k: int) -> DataFrame:
        """Chunks of the scope nearest to a vector, with ``score`` (cosine distance, lower is better) and ``rank``. The scope is cut first, so it never comes short."""
        if k > 0 and len(query) != self.dimensions:
            raise StoreError(f"the query has {len(query)} dimensions, the store {self.dimensions}")
        own = self.read("chunks", repo_root, branch)
        held = self.latest(own, ["embedding"]).where(F.col("embedding").isNotNull())
        best = vector.nearest(held, query, k, ties=("content_hash",), into="score")  # k hashes
        return self._best(own.join(F.broadcast(best), "content_hash"), k)

    def _best(self, hits: DataFrame, k: int) -> DataFrame:
        """The ``k`` best of chunks with ``score``; only these are given their texts."""
        best = materialize(_ranked(hits.withColumn("content", F.lit("")), k), "best")
        texts = self.texts(F.broadcast(best.select("content_hash").distinct()))
        return best.drop("content").join(F.broadcast(texts), "content_hash", "left").withColumn("content", F.coalesce("chunk_text", F.lit(""))).select(*RESULT, "score", "rank")

    def search_keyword(self, repo_root: str, branch: str, query: str, k: int) -> DataFrame:
        """Chunks of the scope that hold all phrases, with ``score`` (negative BM25, lower is better) and ``rank``. Statistics are of all scopes."""
        sizes = self.manifest["sizes"]
        if set(sizes) == {s for s, p in self.manifest["parts"]["chunks"].items() if p} and sizes:
            n, total = (sum(x[i] for x in sizes.values()) for i in (0, 1))
            found = keyword.search_postings(self.read("postings"), n, total / max(n, 1), query)
            return self._best(_keyed(self.read("chunks", repo_root, branch)).join(found.withColumnRenamed("id", "_id"), "_id"), k)
        hits = keyword.scan(self._searched(), query, SEARCHED).where((F.col("repo_root") == repo_root) & (F.col("branch") == branch))
        return _ranked(hits.withColumn("content", F.col("chunk_text")), k)

    def neighbours(self, repo_root: str, branch: str, hashes: DataFrame) -> DataFrame:
        """Chunks one call away from ``hashes``, with score 0."""
        near = graph.neighbours(self.read("edges", repo_root, branch), hashes)
        return self.all_chunks(repo_root, branch).join(near, "content_hash", "left_semi").withColumn("score", F.lit(0.0))

    def find_related(self, repo_root: str, branch: str, hashes: DataFrame, n: int) -> DataFrame:
        """The ``n`` best of them, with score and rank."""
        scored = graph.related(self.read("edges", repo_root, branch), hashes)
        return _ranked(self.all_chunks(repo_root, branch).join(scored, "content_hash"), n, best_first=True)


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("_id", F.to_json(F.struct(*(F.col(k).alias(k) for k in KEYS))))


def _ranked(hits: DataFrame, k: int, best_first: bool = False) -> DataFrame:
    order = (F.desc("score") if best_first else F.asc("score"), "content_hash", "file_path", "chunk_index")
    best = hits.select(*RESULT, "score").orderBy(*order).limit(max(k, 0))
    return best.withColumn("rank", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1).cast("long"))  # k rows
