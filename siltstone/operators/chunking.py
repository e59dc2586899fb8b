"""Files to chunks, chunks to references and vectors: Arrow batches in, Arrow batches out, no shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.chunker import chunk_file, count_tokens, line_windows
from siltstone.functions.references import first_name, references, without_own
from siltstone.session import ship

CHUNKS = "repo_root string, branch string, file_path string, chunk_index int, content string, language string, start_line int, end_line int, annotation string, signature string"
_CHUNKS = pa.schema([(n, pa.int32() if k == "int" else pa.string()) for n, k in (c.split() for c in CHUNKS.split(", "))])


def chunk_files(files: DataFrame, repo_root: str, branch: str, most: int, least: int) -> DataFrame:
    """Chunks of files (file_path, content: string or binary); the first bad limit raises."""
    ship(files.sparkSession)
    if most <= 0 or least < 0:
        raise ValueError(f"bad limits of a chunk: {most}, {least}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = chunk_file(path, repo_root, content or "", most, least)
                if got:
                    cols = [[getattr(c, f.name) if f.name != "branch" else branch for c in got] for f in _CHUNKS]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _CHUNKS, strict=True)], schema=_CHUNKS)

    return files.where("file_path is not null").select("file_path", "content").mapInArrow(run, CHUNKS)


def windows(rows: DataFrame, most: int, least: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, start_line, end_line, content: texts in windows of whole lines that overlap by a tenth."""
    ship(rows.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("chunk_index", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = [w for w in line_windows(t or "", most, 0) if count_tokens(w[3]) >= least]
                if got:
                    cols = [[i] * len(got), range(len(got)), [w[0] for w in got], [w[1] for w in got], [w[3] for w in got]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, chunk_index int, start_line int, end_line int, content string")


def with_hash(chunks: DataFrame) -> DataFrame:
    """Adds content_hash."""
    return chunks.withColumn("content_hash", T.content_hash(F.col("content")))


def extract_references(chunks: DataFrame) -> DataFrame:
    """repo_root, branch, content_hash, name, kind of chunks with content_hash; a chunk doesn't refer to its own name. Equal contents are parsed once for each scope."""
    ship(chunks.sparkSession)
    schema = pa.schema([(n, pa.string()) for n in ("repo_root", "branch", "content_hash", "name", "kind")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for repo, branch, h, content, language, signature in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(repo, branch, h, name, kind) for name, kind in without_own(references(content or "", language or ""), signature or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    once = chunks.groupBy("repo_root", "branch", "content_hash").agg(F.max_by(F.struct("content", "language", "signature"), F.struct("file_path", "chunk_index")).alias("c"))
    return once.select("repo_root", "branch", "content_hash", "c.content", "c.language", "c.signature").mapInArrow(run, "repo_root string, branch string, content_hash string, name string, kind string")


def signature_names(chunks: DataFrame) -> DataFrame:
    """repo_root, branch, content_hash, name of what chunks declare."""
    ship(chunks.sparkSession)
    named = F.regexp_replace("signature", r"^\s*impl(?:<[^>]*>)?\s+(?:[^{]*\bfor\s+)?", "")
    return chunks.select("repo_root", "branch", "content_hash", T.first_name(named).alias("name")).where("name <> ''")


def uncovered_runs(lines: DataFrame, by: tuple[str, ...], line_col: str = "line_no", covered_col: str = "covered") -> DataFrame:
    """Runs of lines that nothing covers: first_line, last_line of each. Lines of one ``by`` meet in one task; a file has few."""
    order = Window.partitionBy(*by).orderBy(line_col)
    loose = lines.where(~F.col(covered_col)).withColumn("_run", F.col(line_col) - F.row_number().over(order))
    return loose.groupBy(*by, "_run").agg(F.min(line_col).alias("first_line"), F.max(line_col).alias("last_line")).drop("_run")


def embed_rows(rows: DataFrame, embedder, text_col: str = "text", into: str = "embedding") -> DataFrame:
    """``rows`` with a vector each. An embedder batches by itself; partitions are what runs at once."""
    ship(rows.sparkSession)
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    out = StructType([*rows.schema.fields, StructField(into, ArrayType(FloatType()))])
    at = rows.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, embedder.max_batch):
                part = b.slice(i, embedder.max_batch)
                vectors = embedder.embed([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=out.names)

    return rows.mapInArrow(run, out)


__all__ = ["CHUNKS", "chunk_files", "embed_rows", "extract_references", "first_name", "signature_names", "uncovered_runs", "windows", "with_hash"]
