"""Files that keep arriving, indexed as they come: an addition to batch updates, with Structured Streaming.

A folder on any file system is the source; each micro-batch is chunked and upserted, so a batch that is run again after a
failure gives the same rows. A file that comes anew replaces its chunks, the newest of a batch counts; call edges, file hashes and the
branch's state follow, so that a batch update can go on from there. Files with a zero byte at the beginning aren't text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.embedders import Embedder
from siltstone.operators.chunking import chunk_files
from siltstone.plans.indexing import _embed_and_map, counts_of, rebuild_edges
from siltstone.session import materialize
from siltstone.sources.config import Chunking
from siltstone.sources.repository import MOST_BYTES, PROBE
from siltstone.store import IndexStore, head_key

_SOURCE = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """file_path, modificationTime, content of text files as they arrive."""
    got = spark.readStream.format("binaryFile").schema(_SOURCE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    text = got.where(F.col("length") <= MOST_BYTES).where(F.instr(F.decode(F.substring("content", 1, PROBE), "ISO-8859-1"), "\0") == 0)
    return text.select(F.col("path").alias("file_path"), "modificationTime", "content")


def ingest(files: DataFrame, store: IndexStore, repo_root: str, branch: str, checkpoint: str, embedder: Embedder | None = None, chunking: Chunking | None = None, **trigger) -> StreamingQuery:
    """Starts the query. trigger: as ``DataStreamWriter.trigger`` takes it; all that is there, then stop, if none is given."""
    limits = chunking or Chunking()

    def index(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("file_path").agg(F.max_by("content", F.struct("modificationTime", "content")).alias("content"))
        own = materialize(newest.withColumn("file_hash", F.sha2("content", 256)), "files")
        chunks = materialize(chunk_files(own, repo_root, branch, limits.max_chunk_tokens, limits.min_chunk_tokens), "chunks")
        if chunks.isEmpty() and own.isEmpty():
            return
        _embed_and_map(store, chunks, embedder)
        store.prune_tails(repo_root, branch, counts_of(own, chunks))
        rebuild_edges(store, repo_root, branch)
        store.rebuild_keyword_index()
        hashes = store.file_hashes(repo_root, branch).join(own.select("file_path"), "file_path", "left_anti").unionByName(own.select("file_path", "file_hash"))
        store.set_file_hashes(repo_root, branch, hashes)
        if not store.state(head_key(repo_root, branch)):
            store.set_state(head_key(repo_root, branch), f"stream-{number}")

    return files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
