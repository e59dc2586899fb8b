"""Reciprocal rank fusion of two ranked lists, for one query or many side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_K = 60.0


def dedup_key() -> Column:
    """The content hash; for a row without one, where it stands."""
    place = F.concat_ws(":", F.lit("fallback"), F.col("repo_root"), F.col("branch"), F.col("chunk_index").cast("string"), F.col("file_path"))
    return F.when(F.coalesce(F.col("content_hash"), F.lit("")) != "", F.col("content_hash")).otherwise(place)


def first_of_each(ranked: DataFrame, key: Column | None = None, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with one key the first by rank; what is left is ranked anew from 0. by: columns that name the query."""
    keyed = ranked.withColumn("_key", dedup_key() if key is None else key)
    first = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*by, "_key").orderBy(rank))).where("_nth = 1").drop("_nth")
    # a list has as many rows as its top k
    return first.withColumn(rank, (F.row_number().over(Window.partitionBy(*by).orderBy(rank)) - 1).cast("long"))


def rrf(lists: list[DataFrame], k: float = DEFAULT_K, top_n: int = 10, key: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The lists' rows with ``score``, and ``rank`` from 0. Each list has ``rank`` and like columns.

    A row scores 1 / (k + rank + 1) in each list. Its columns are those of its best rank; of equal ranks the
    earlier list's. Ordered by score, then content hash, then path. ``k`` of 0 or less is 60; ``top_n`` of 0 or less gives no row.
    """
    k = k if k > 0 else DEFAULT_K
    ranked = [first_of_each(x, key, by=by).withColumn("_list", F.lit(i)) for i, x in enumerate(lists)]
    every = reduce(DataFrame.unionByName, ranked)
    whole = F.struct(*(c for c in every.columns if c not in ("_key", "_list", *by)))
    fused = every.groupBy(*by, "_key").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank") + 1.0)).alias("score"), F.min_by(whole, F.struct("rank", "_list")).alias("_row")
    )
    ties = [c for c in ("content_hash", "file_path") if c in every.columns] or ["_key"]
    out = fused.select(*by, "_key", "score", *(F.col(f"_row.{f}").alias(f) for f in every.columns if f not in ("_key", "_list", "rank", "score", *by)))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), *ties, "_key")
    return out.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < top_n).drop("_key")
