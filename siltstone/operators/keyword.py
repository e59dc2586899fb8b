"""Keyword search: phrases that must all occur, ranked by BM25.

A query is words between white space; each is a phrase of the terms in it (``tree-sitter``: ``tree``, then
``sitter``) which must stand side by side in one column. All phrases of a query must occur in a row, in
whichever columns. The score is negative, lower is better, as in embedded full-text engines.

``scan`` counts phrases in a table as it is: one pass, no shuffle, all in the JVM; its hits are written. ``postings`` makes an
index for many queries: a row for each term and document with its places, to be kept sorted by term so that
a query reads its own terms only. Statistics are of all rows given, whatever scope is asked afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.functions.text import phrases, search_terms, spaced_terms
from siltstone.session import column, materialize, ship, unused

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Places of a column begin at a multiple of this, so that no phrase reaches into the next.
GAP = 1 << 32


def query_phrases(spark, query: str) -> list[list[str]]:
    """The terms of each phrase, by the same expression that reads the rows; phrases without a term fall away."""
    words = phrases(query)
    if not words:
        return []
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", search_terms(F.col("w")).alias("t")).collect()
    return [r["t"] for r in sorted(got, key=lambda r: r["i"]) if r["t"]]


@dataclass
class Corpus:
    """Of all rows: how many, their mean length in terms, how many have each phrase."""

    rows: int
    mean: float
    having: list[int]

    def idf(self, i: int) -> float:
        return max(math.log((self.rows - self.having[i] + 0.5) / (self.having[i] + 0.5)), LEAST_IDF)


def occurrences(spaced: Column, phrase: list[str]) -> Column:
    """How often a phrase stands in terms with spaces around them; terms are letters and digits. Occurrences may overlap."""
    head, *rest = phrase
    return F.regexp_count(spaced, F.lit(f" {head}(?={''.join(f' {w}' for w in rest)} )")).cast("long")


def _score(size: Column, counts: list[Column], corpus: Corpus) -> Column:
    parts = [F.lit(corpus.idf(i)) * (n * (K1 + 1)) / (n + K1 * (1 - B + B * size / F.lit(corpus.mean or 1.0))) for i, n in enumerate(counts)]
    return -reduce(lambda x, y: x + y, parts)


def scan(rows: DataFrame, query: str, columns: tuple[str, ...] = ("text",), into: str = "score", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that match, with their score, unordered. A blank query, or one without terms, matches none.

    One pass: the hits (their columns ``keep``, or all) are written while the corpus is counted.
    """
    keep = tuple(rows.columns) if keep is None else keep
    asked = query_phrases(rows.sparkSession, query)
    if not asked:
        return rows.select(*(column(rows, c) for c in keep), F.lit(0.0).alias(into)).limit(0)
    own = lambda kind: unused(rows, f"_{kind}_")
    terms = {own(f"terms{i}"): spaced_terms(F.coalesce(column(rows, c).cast("string"), F.lit(""))) for i, c in enumerate(columns)}
    names = [own("size"), *(own(f"n{i}") for i in range(len(asked)))]
    total = lambda f: reduce(lambda x, y: x + y, (f(F.col(t)) for t in terms))
    split = rows.select(*(column(rows, c) for c in rows.columns), *(t.alias(n) for n, t in terms.items()))
    counted = split.withColumns({names[0]: total(lambda t: F.regexp_count(t, F.lit("[^ ]+"))).cast("long")} | {n: total(lambda t, p=p: occurrences(t, p)) for n, p in zip(names[1:], asked, strict=True)})
    seen = Observation()
    said = [F.count(F.lit(1)).alias("rows"), F.sum(names[0]).alias("size"), *(F.sum((F.col(n) > 0).cast("long")).alias(f"h{i}") for i, n in enumerate(names[1:]))]
    hits = counted.select(*(column(counted, c) for c in keep), *names).observe(seen, *said).where(reduce(lambda x, y: x & y, (F.col(n) > 0 for n in names[1:])))
    held, got = materialize(hits, "hits"), seen.get
    corpus = Corpus(got["rows"], (got["size"] or 0) / max(got["rows"], 1), [got[f"h{i}"] or 0 for i in range(len(asked))])
    return held.withColumn(into, _score(F.col(names[0]), [F.col(n) for n in names[1:]], corpus)).drop(*names)


def postings(rows: DataFrame, id_col: str, columns: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """term, id, size (of the row, in terms), places, and the integer columns ``keep``: no shuffle, a row's terms are grouped where it is."""
    ship(rows.sparkSession)
    n_kept = len(keep)

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a batch at a time: all terms as numbers, sorted by row, then term, then place
            row, place, words = [], [], []
            for c in range(1 + n_kept, b.num_columns):
                col = b.column(c)
                n = np.diff(col.offsets.to_numpy())
                row.append(np.repeat(np.arange(b.num_rows), n))
                place.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + GAP * (c - n_kept))
                words.append(col.flatten())
            coded = pa.concat_arrays(words).dictionary_encode()
            row, place, code = np.concatenate(row), np.concatenate(place), coded.indices.to_numpy()
            if not len(row):
                continue
            order = np.lexsort((place, code, row))
            row, place, code = row[order], place[order], code[order]
            first = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(code) != 0)])
            whose = row[first]
            at = pa.array(whose)
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(code[first])), b.column(0).take(at), pa.array(np.bincount(row, minlength=b.num_rows)[whose], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.r_[first, len(place)], pa.int32()), pa.array(place, pa.int64())), *(b.column(1 + i).take(at) for i in range(n_kept)),
                ],
                names=["term", "id", "size", "places", *keep],
            )

    terms = [search_terms(F.coalesce(F.col(c), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns)]
    kept = "".join(f", {c} int" for c in keep)
    return rows.select(F.col(id_col).cast("string").alias("id"), *keep, *terms).mapInArrow(group, f"term string, id string, size long, places array<long>{kept}")


def _back(places: str, k: int) -> Column:
    return F.transform(places, lambda p: p - k)


def search_postings(index: DataFrame, rows: int, mean: float, query: str) -> DataFrame:
    """id, score from an index of ``postings``; rows, mean: of all indexed rows. Reads the query's terms only."""
    spark = index.sparkSession
    asked = query_phrases(spark, query)
    if not asked:
        return spark.createDataFrame([], "id string, score double")
    found = []
    for i, phrase in enumerate(asked):
        part = index.where(F.col("term").isin(*set(phrase)))
        if len(phrase) == 1:
            hits = part.select("id", "size", F.size("places").cast("long").alias("n"))
        else:
            # each place of the phrase's k-th term is moved back by k; where all terms meet it begins
            moved = [part.where(F.col("term") == w).select("id", "size", _back("places", k).alias(f"p{k}")) for k, w in enumerate(phrase)]
            both = reduce(lambda x, y: x.join(y.drop("size"), "id"), moved)
            begins = reduce(F.array_intersect, (F.col(f"p{k}") for k in range(len(phrase))))
            hits = both.select("id", "size", F.size(begins).cast("long").alias("n")).where("n > 0")
        found.append(hits.withColumn("i", F.lit(i)))
    every = reduce(DataFrame.unionByName, found)
    having = {r["i"]: r["count"] for r in every.groupBy("i").count().collect()}  # a row for each phrase
    if len(having) < len(asked):
        return spark.createDataFrame([], "id string, score double")
    corpus = Corpus(rows, mean, [having[i] for i in range(len(asked))])
    idf = F.element_at(F.array(*(F.lit(corpus.idf(i)) for i in range(len(asked)))), F.col("i") + 1)
    part = idf * (F.col("n") * (K1 + 1)) / (F.col("n") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    summed = every.groupBy("id").agg((-F.sum(part)).alias("score"), F.count("*").alias("_found"))
    return summed.where(F.col("_found") == len(asked)).select("id", "score")
