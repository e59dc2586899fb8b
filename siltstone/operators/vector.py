"""Exact nearest neighbours by cosine distance.

Distances are computed in numpy over Arrow batches, in double precision. Queries go to the executors in
blocks of ``BLOCK`` and meet a few rows at once (``TILE``); each task keeps its own best ``k`` for each query
before anything is shuffled, so what is shuffled is ``k`` rows for each query and task, whatever the table's size.

A vector of length zero, or of another length than the query's, is at distance 1. Null vectors are none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import ship

#: Queries sent to the executors at once.
BLOCK = 1024
#: Distances that a task holds at once: 2 MB of doubles, and the like for a few steps of them.
TILE = 1 << 18
#: Distances are rounded to so many digits: equal vectors tie, wherever in a batch they stand.
DIGITS = 9


def _matrix(vectors: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``dimensions`` doubles, and whether each row had that many."""
    out = np.zeros((len(vectors), dimensions))
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    right = (size == dimensions) & ~np.asarray(vectors.is_null())
    if right.all():
        out[:] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    else:
        for i in np.flatnonzero(right):
            out[i] = vectors[int(i)].as_py()
    return out, right


def cosine_distances(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Rows by queries, between 0 and 2."""
    norm = np.sqrt((rows**2).sum(1))[:, None] * np.sqrt((queries**2).sum(1))[None, :]
    d = rows @ queries.T  # what follows is done in place
    with np.errstate(divide="ignore", invalid="ignore"):
        d /= norm
    np.clip(d, -1.0, 1.0, out=d)
    np.subtract(1.0, d, out=d)
    d[~(norm > 0)] = 1.0
    np.round(d, DIGITS, out=d)
    d += 0.0
    return d


def distance_to(vector: Column, query: list[float]) -> Column:
    """The cosine distance of a column of vectors to one vector."""
    q = np.asarray(query, np.float64)

    @F.pandas_udf("double")
    def distance(parts: pd.Series) -> pd.Series:
        rows, right = _matrix(pa.array(parts, pa.list_(pa.float64()), from_pandas=True), len(q))
        return pd.Series(np.where(right, cosine_distances(rows, q[None, :])[:, 0], 1.0))

    return distance(vector)


def nearest(vectors: DataFrame, query: list[float], k: int, vector_col: str = "embedding", ties: tuple[str, ...] = (), into: str = "distance") -> DataFrame:
    """The ``k`` rows nearest to one vector, of rows that are filtered before: a scope never comes short. ``k`` of 0 or less: none."""
    ship(vectors.sparkSession)
    far = vectors.where(F.col(vector_col).isNotNull()).withColumn(into, distance_to(F.col(vector_col), query)).drop(vector_col)
    return far.orderBy(into, *ties).limit(max(k, 0))


def best_of_batches(batches: Iterable[pa.RecordBatch], names: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """query_id, id, distance: for each query (its id and its vector) the ``k`` nearest of all rows (id, vector) of the batches; ties by id."""
    step = max(TILE // len(names), 1)
    none = np.zeros(0, np.int64)
    whose, own, far = none, none, np.zeros(0)  # the best so far: at most k of each query
    for b in batches:
        for a in range(0, b.num_rows, step):
            part = b.slice(a, step)
            ids, (m, right) = part.column(0).to_numpy(), _matrix(part.column(1), wanted.shape[1])
            d = cosine_distances(m, wanted)
            d[~right] = 1.0
            if len(d) > k:
                at, q = np.nonzero(d <= np.partition(d, k - 1, axis=0)[k - 1])
            else:
                at, q = (x.ravel() for x in np.indices(d.shape))
            whose, own, far = np.r_[whose, q], np.r_[own, ids[at]], np.r_[far, d[at, q]]
            order = np.lexsort((own, far, whose))
            whose, own, far = whose[order], own[order], far[order]
            nth = np.arange(len(whose)) - np.searchsorted(whose, whose)
            whose, own, far = whose[nth < k], own[nth < k], far[nth < k]
    if len(whose):
        yield pa.RecordBatch.from_arrays([pa.array(names[whose]), pa.array(own), pa.array(far)], names=["query_id", "id", "distance"])


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, id, distance, rank (from 1): for each query its ``k`` nearest rows; ties by id. queries: the same two columns, read by the driver block by block."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>"))

    def search(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, matrix))  # a block at most

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return best_of_batches(batches, *sent.value, k)

        return rows.mapInArrow(best, "query_id long, id long, distance double")

    found: list[DataFrame] = []
    held: dict[int, list[tuple[int, list[float]]]] = {}  # by length: less than a block of each

    def flush(n: int) -> None:
        ids, queries_of = zip(*held.pop(n), strict=True)
        found.append(search(np.array(ids, np.int64), np.array(queries_of).reshape(len(ids), n)))

    for r in asked.toLocalIterator() if k > 0 else ():
        held.setdefault(len(r[1]), []).append((r[0], [np.nan if x is None else x for x in r[1]]))
        if len(held[len(r[1])]) == block:
            flush(len(r[1]))
    for n in sorted(held):
        flush(n)
    if not found:
        return spark.createDataFrame([], "query_id long, id long, distance double, rank long")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
