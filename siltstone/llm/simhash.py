"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits at most 3 apart meet at a third one that is within half of that of either: two bits from
one, one bit from the other. Every fingerprint emits variants of all its 64 bits: itself, each one bit off, and each with
two of its set bits cleared (561 rows on average). Of three differing bits one of the two fingerprints has two set, so it
clears these and the other one flips the third; two bits are cleared by one, or one by each. Other
variants two bits off aren't needed.

Variants are shuffled, and no collision is a chance one: of fingerprints that meet at a key, one that is one bit off or none is at most
3 from all others, which are two bits off at most. So a key needs no pairs: all that meet there are linked to the least of
those that are near, as a star, and every two fingerprints within 3 bits are in one component. A key is met by the 2,081
fingerprints around it at most, however many documents there are.

Copies share a fingerprint and are one node; links are found and components made between distinct
fingerprints only, so a group of copies costs no pairs.

Nulls and empty texts, or texts without words, have fingerprint zero, which links like any other. A null
id gets its group's component; a group without any id has component null. Repeated rows are copies. Fewer
than ``shingle`` words: the whole sequence is the only shingle. Columns besides the two that are named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.graph import components
from siltstone.llm.texts import blocks_of
from siltstone.session import column, columns, materialize, ship, unused

SHINGLE, RADIUS, SEED = 3, 3, 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles_of(text: str, shingle: int) -> Iterable[bytes]:
    words = text.encode().translate(_LOWER).split()  # on the six ASCII blanks
    if not words:
        return []
    return [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned; a bit is set if it is set in over half of the shingles' hashes."""
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, SEED) for s in shingles_of(text, shingle)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Unsigned; a bit is set if it is set in over half of ``hashes``."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # of very long texts not all bits at once
        ones += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _fp (the fingerprint as a signed long) of each row. One pass, no shuffle."""
    ship(docs.sparkSession)
    schema = pa.schema([("_id", pa.int64()), ("_fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in blocks_of(b.column(1)):
                fps = np.array([simhash(t or "", shingle) for t in b.column(1).slice(i, j - i).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fps)], schema=schema)

    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col)).mapInArrow(run, "_id long, _fp long")


#: What a variant differs in from its fingerprint: nothing, one bit, two bits; its number is its place here.
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
MASKS = np.concatenate([np.zeros(1, np.uint64), _BITS, *(_BITS[i] | _BITS[i + 1 :] for i in range(64))])
#: Variants of lower numbers are one bit off at most.
NEAR = 65


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``prints``, number) of all variants, ascending. prints: unsigned."""
    emitted = (prints[:, None] & MASKS) == MASKS
    emitted[:, :NEAR] = True
    return np.nonzero(emitted)


#: Fingerprints whose variants are in memory at once, and variants for each task of the shuffle.
AT_ONCE, TASK_ROWS = 4096, 3_000_000
_DEALT = pa.schema([("_task", pa.int32()), ("_fp", pa.list_(pa.int64())), ("_n", pa.list_(pa.int16())), ("_variant", pa.list_(pa.int16()))])
_DEALT_SQL = "_task int, _fp array<long>, _n array<smallint>, _variant array<smallint>"
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def dealt(prints: np.ndarray, tasks: int) -> pa.RecordBatch:
    """A row for each task that gets variants: the fingerprints, how many variants of each, and their numbers. A variant takes two bytes, and
    its share of eight and two of its fingerprint."""
    at, number = variants(prints)
    keys = prints[at] ^ MASKS[number]
    keys ^= keys >> np.uint64(32)
    task = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(tasks)
    order = np.argsort(task.astype(np.uint16 if tasks <= 1 << 16 else np.uint32), kind="stable")  # so of one task by fingerprint
    task, at, number = task[order], at[order], number[order]
    begins = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (at[1:] != at[:-1])]))
    tops = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
    n = np.diff(np.append(begins, len(at)))
    of_prints = pa.array(np.append(np.searchsorted(begins, tops), len(begins)).astype(np.int32))
    of_variants = pa.array(np.append(tops, len(at)).astype(np.int32))
    return pa.RecordBatch.from_arrays([
        pa.array(task[tops].astype(np.int32)), pa.ListArray.from_arrays(of_prints, pa.array(prints[at[begins]].view(np.int64))),
        pa.ListArray.from_arrays(of_prints, pa.array(n.astype(np.int16))), pa.ListArray.from_arrays(of_variants, pa.array(number.astype(np.int16))),
    ], schema=_DEALT)


def stars(prints: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints that meet at a key to its centre: the least of those that are one bit off or none, where there is one."""
    keys = prints ^ MASKS[number]
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    met = np.concatenate([same, [False]]) | np.concatenate([[False], same])  # most keys are one fingerprint's only
    keys, order = keys[met], order[met]
    if not len(keys):
        return prints[:0], prints[:0]
    prints, near = prints[order].view(np.int64), number[order] < NEAR
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    none = np.iinfo(np.int64).max
    centre = np.minimum.reduceat(np.where(near, prints, none), np.flatnonzero(first))[np.cumsum(first) - 1]
    # a fingerprint of that value is a centre like any other
    has = np.maximum.reduceat(near, np.flatnonzero(first))[np.cumsum(first) - 1]
    hit = has & (centre != prints)
    return np.minimum(centre, prints)[hit], np.maximum(centre, prints)[hit]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: distinct fingerprints of ``nodes`` (_fp) which differ in 1 to 3 bits; enough of them to connect all such pairs."""
    if radius != 3:
        raise ValueError("variants of one and of two bits meet a radius of 3")
    ship(nodes.sparkSession)
    held = materialize(nodes.select("_fp"), "nodes")
    tasks = max(held.sparkSession.sparkContext.defaultParallelism, held.count() * 561 // TASK_ROWS)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), AT_ONCE):
                yield dealt(every[i : i + AT_ONCE], tasks)

    def star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of all variants of a task, which are TASK_ROWS or so, as keys are dealt by their hash."""
        prints, numbers = [], []
        for b in batches:
            fp, n, variant = (b.column(i).flatten().to_numpy() for i in (1, 2, 3))
            prints.append(np.repeat(fp, n).view(np.uint64))
            numbers.append(variant)
        if prints:
            u, v = stars(np.concatenate(prints), np.concatenate(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=_LINK)

    rows = held.repartition(tasks).mapInArrow(emit, _DEALT_SQL).repartitionById(tasks, F.col("_task"))
    return rows.mapInArrow(star, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("_fp").agg(F.min("_id").alias("_least"))
    linked = materialize(components(links(nodes.select("_fp"), radius)).withColumnRenamed("node", "_fp"), "components")
    least = materialize(linked.join(nodes, "_fp").groupBy("root").agg(F.min("_least").alias("_component")), "least")  # written for the same reason
    placed = nodes.join(linked.join(least, "root").select("_fp", "_component"), "_fp", "left")
    # written: where both sides of the last join are dealt for it alone, Spark can split a fingerprint that many rows share
    of = materialize(placed.select("_fp", F.coalesce("_component", "_least").alias("component_id")), "placed")
    return prints.join(of, "_fp").select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``: the one of the least id (nulls last), then text hash.

    Whole rows are shuffled once, to the row that stays.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = pa.schema([("_id", pa.int64()), ("_tie", pa.int64()), ("_fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in blocks_of(b.column(2)):
                fps = np.array([simhash(t or "", shingle) for t in b.column(2).slice(i, j - i).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(fps)], schema=schema)

    prints = materialize(docs.select(column(docs, id_col).cast("long"), text_hash(docs, text_col), column(docs, text_col)).mapInArrow(run, "_id long, _tie long, _fp long"), "fingerprints")
    # nulls last: their flag is the first of the order
    order = F.struct(F.col("_id").isNull().alias("n"), "_id", "_tie")
    nodes = prints.groupBy("_fp").agg(F.min(order).alias("_least"))
    linked = materialize(components(links(nodes.select("_fp"), radius)).withColumnRenamed("node", "_fp"), "components")
    return keep_least(docs, nodes, linked, id_col, text_col)


def text_hash(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(column(docs, text_col).cast("string"), F.lit("")))


def keep_least(docs: DataFrame, nodes: DataFrame, linked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The least row (``_least`` of ``nodes``) of each component (``root`` of ``linked``); nodes without links are their own."""
    key, tie = unused(docs, "_key"), unused(docs, "_tie")
    placed = nodes.join(linked, "_fp", "left")
    stay = placed.groupBy(F.coalesce("root", "_fp").alias("_root")).agg(F.min("_least").alias("r")).select(F.col("r._id").alias("_id"), F.col("r._tie").alias("_tie"))
    stay = stay.select(F.xxhash64("_id", "_tie").alias(key), F.col("_tie").alias(tie))
    own = text_hash(docs, text_col)
    whole = docs.select(*columns(docs), F.xxhash64(column(docs, id_col).cast("long"), own).alias(key), own.alias(tie))
    kept = whole.join(stay, [key, tie], "left_semi").dropDuplicates([key, tie])
    return kept.select(*(column(kept, c) for c in docs.columns))
