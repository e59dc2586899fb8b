"""Document fingerprints: Merkle trees over sections, paragraphs and sentences.

A text splits into paragraphs (lines); a section ends after a blank line, or after a paragraph whose hash says so,
one in eight: an edit moves no border but its own. A paragraph splits into
sentences, and a long sentence into runs of words with borders set by hashes as well. These leaves keep all
characters but the line ends, which the tree stands for; every node is the hash of its children's 128-bit hashes and of its level, so
roots are equal where the texts are, and only there. The fingerprint writes the tree down,
``<root>/<section>,<section>,...`` with a section ``<node>.<paragraph>.<paragraph>...`` and a paragraph its node (as long as
a section's, 12 hex digits) and its leaves' of 8.

``differing`` walks two trees from the root, passes over branches of equal nodes and opens those that differ, and so names the
ranges of leaves that were edited. ``likeness`` is the share of leaves that stand in equal branches in the same order: 1 for equal
roots, below 1 otherwise.

Nulls and empty texts have one and the same fingerprint. Ids that are null come first; rows with equal
ids follow each other by their texts' hash, then the text; repeated rows are documents of their own.
Columns besides the two that are named are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import column, ship, size_of

#: One paragraph in so many ends a section, one word in so many a run of a long sentence.
SECTION, RUN = 8, 8
#: Sentences of more words are cut into runs.
LONG = 16
#: Hex digits of a node and of a leaf in a fingerprint.
NODE, LEAF = 12, 8

_END = re.compile(r"[.!?][\x20\t]+(?=[^\x20\t])")
_WORD = re.compile(r"\S+\s*|\s+")
_hash = xxhash.xxh32_intdigest
_leaf = xxhash.xxh3_128_digest


def _leaves(line: str) -> list[str]:
    """Parts of a line, which together are the line."""
    out = []
    cuts = [0, *(m.end() for m in _END.finditer(line)), len(line)]
    for sentence in (line[a:b] for a, b in pairwise(cuts)):
        if sentence.count(" ") < LONG:
            out.append(sentence)
            continue
        run: list[str] = []
        for w in _WORD.findall(sentence):
            run.append(w)
            if _hash(w) % RUN == 0 and len(run) > 2 or len(run) >= 2 * LONG:
                out.append("".join(run))
                run = []
        if run:
            out.append("".join(run))
    return out


def _node(level: bytes, children: Iterable[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16, person=level).digest()


@dataclass(frozen=True)
class Node:
    """A section or a paragraph: its hash, what it holds (paragraphs, or leaves' hashes), and how many leaves."""

    key: str
    children: tuple
    leaves: int


@dataclass(frozen=True)
class Tree:
    root: str
    children: tuple[Node, ...]
    leaves: int

    @classmethod
    def of(cls, text: str | None) -> Tree:
        sections: list[Node] = []
        digests: list[bytes] = []
        now: list[Node] = []
        inner: list[bytes] = []

        def close() -> None:
            digests.append(_node(b"section", inner))
            sections.append(Node(digests[-1].hex()[:NODE], tuple(now), sum(p.leaves for p in now)))
            now.clear()
            inner.clear()

        for line in (text or "").split("\n"):
            leaves = [_leaf(s) for s in _leaves(line)]
            inner.append(_node(b"paragraph", leaves))
            now.append(Node(inner[-1].hex()[:NODE], tuple(x.hex()[:LEAF] for x in leaves), len(leaves)))
            if not line.strip() or _hash(line, 1) % SECTION == 0:
                close()
        if now:
            close()
        return cls(_node(b"root", digests).hex(), tuple(sections), sum(s.leaves for s in sections))

    @classmethod
    def parse(cls, fingerprint: str) -> Tree:
        root, _, rest = fingerprint.partition("/")
        sections = []
        for s in rest.split(","):
            key, *parts = s.split(".")
            paragraphs = tuple(Node(p[:NODE], tuple(p[i : i + LEAF] for i in range(NODE, len(p), LEAF)), (len(p) - NODE) // LEAF) for p in parts)
            sections.append(Node(key, paragraphs, sum(p.leaves for p in paragraphs)))
        return cls(root, tuple(sections), sum(s.leaves for s in sections))

    def __str__(self) -> str:
        return self.root + "/" + ",".join(".".join([s.key, *(p.key + "".join(p.children) for p in s.children)]) for s in self.children)


def fingerprint(text: str | None) -> str:
    return str(Tree.of(text))


def _matches(x: Sequence, y: Sequence, key) -> list[tuple[int, int]]:
    """Places (i, j) of equal items, ascending in both: a common beginning and end, then items found once in both, those of the
    longest ascending run, and what goes on from them. Not always the most that match; in time proportional to n log n."""
    a, b = [key(n) for n in x], [key(n) for n in y]
    lo, most = 0, min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        lo += 1
    ends = 0
    while ends < most - lo and a[-1 - ends] == b[-1 - ends]:
        ends += 1
    out = [(i, i) for i in range(lo)]
    m, n = len(a) - ends, len(b) - ends
    if lo < m and lo < n:
        once = Counter(a[lo:m])
        there = Counter(b[lo:n])
        place = {k: j for j, k in enumerate(b[lo:n], lo) if there[k] == 1 and once[k] == 1}
        anchors = [(i, place[k]) for i, k in enumerate(a[lo:m], lo) if k in place]
        tops: list[int] = []  # least last place of a run of each length
        last: list[int] = []  # anchor of it
        before = []
        for at, (_, j) in enumerate(anchors):
            k = bisect_left(tops, j)
            before.append(last[k - 1] if k else -1)
            tops[k : k + 1], last[k : k + 1] = [j], [at]
        run, at = [], last[-1] if last else -1
        while at >= 0:
            run.append(anchors[at])
            at = before[at]
        p, q = lo, lo
        for i, j in [*reversed(run), (m, n)]:
            back = 0
            while i - back > p and j - back > q and back < len(a) and a[i - back - 1] == b[j - back - 1]:
                back += 1
            out += [(i - k, j - k) for k in range(back, 0, -1)]
            if (i, j) == (m, n):
                break
            p, q = i, j
            while p < m and q < n and a[p] == b[q]:
                out.append((p, q))
                p, q = p + 1, q + 1
    return sorted({*out, *((len(a) - k, len(b) - k) for k in range(ends, 0, -1))})


def differing(a: Tree | str, b: Tree | str) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Where two documents differ: ranges of leaves of either, ends exclusive, counted from 0; one of the two may be empty."""
    a, b = (Tree.parse(t) if isinstance(t, str) else t for t in (a, b))
    out: list[tuple[tuple[int, int], tuple[int, int]]] = []

    def size(nodes: Sequence, depth: int) -> int:
        return len(nodes) if depth == 2 else sum(n.leaves for n in nodes)

    def walk(x: Sequence, y: Sequence, depth: int, i: int, j: int) -> None:
        p = q = 0
        for s, t in [*_matches(x, y, (lambda n: n) if depth == 2 else lambda n: n.key), (len(x), len(y))]:
            apart = x[p:s], y[q:t]
            m, n = size(apart[0], depth), size(apart[1], depth)
            if depth < 2 and m and n:
                walk([c for k in apart[0] for c in k.children], [c for k in apart[1] for c in k.children], depth + 1, i, j)
            elif m or n:
                out.append(((i, i + m), (j, j + n)))
            i, j = i + m, j + n
            if s < len(x):
                same = 1 if depth == 2 else x[s].leaves
                i, j = i + same, j + same
            p, q = s + 1, t + 1

    if a.root != b.root:
        walk(a.children, b.children, 0, 0, 0)
    return out


def likeness(a: Tree | str, b: Tree | str, apart: list | None = None) -> float:
    """0 to 1, from two fingerprints alone. apart: their ``differing``, where it is known."""
    a, b = (Tree.parse(t) if isinstance(t, str) else t for t in (a, b))
    if a.root == b.root:
        return 1.0
    lost = sum(i2 - i1 + j2 - j1 for (i1, i2), (j1, j2) in (differing(a, b) if apart is None else apart))
    # texts that differ are never wholly alike, whatever 32 bits of their leaves say
    return min(1 - lost / (a.leaves + b.leaves), 1 - 1e-6)


def listed(ranges: list[tuple[tuple[int, int], tuple[int, int]]]) -> str:
    """As text: first:end>first:end, comma-joined."""
    return ",".join(f"{a}:{b}>{c}:{d}" for (a, b), (c, d) in ranges)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each row. One pass, no shuffle."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(fingerprint, texts)), pa.string())], schema=schema)

    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col)).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edited_leaves", pa.string()),
])
_EDITED_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_leaves string"


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, id, guest, text) in order; guests are first rows of the bucket after, there to be the next one only."""
    held = None
    for b in batches:
        bucket, ids, guest = (b.column(i).to_pylist() for i in range(3))
        rows: list[tuple] = []
        for i in range(b.num_rows):
            text = b.column(3)[i].as_py() or ""
            tree = Tree.of(text)
            if held is not None and held[0] == bucket[i]:
                _, doc, mine, own = held
                half = len(mine) // 2
                edited = mine[: len(mine) - half] + text[:half]
                changed = Tree.of(edited)
                apart = differing(own, changed)
                rows.append((doc, len(mine), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(changed), likeness(own, changed, apart), likeness(own, tree), listed(apart)))
            held = None if guest[i] else (bucket[i], ids[i], text, tree)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EDITED, strict=True)], schema=_EDITED)


#: Where null ids stand in the order.
_NULL = -(1 << 63)
#: Bytes of texts for each task, ranges of the order for each task, and sampled ids for each range.
TASK_BYTES, RANGES, SAMPLED = 16 << 20, 4, 20
_PART = 24


def bucket_of(ids: np.ndarray, ties: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ranges of the order by (id, tie), ascending. cuts: ids at which ranges begin, ascending; one that is there m times, m > 1, is a range by
    itself, cut by tie into m."""
    bounds, times = np.unique(cuts, return_counts=True)
    left = np.searchsorted(bounds, ids, "left")
    at = np.minimum(left, max(len(bounds) - 1, 0))
    hot = (bounds[at] == ids) & (times[at] > 1) if len(bounds) else np.zeros(len(ids), bool)
    right = np.searchsorted(bounds, ids, "right").astype(np.int64)
    part = ((ties.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    parts = times[at] if len(bounds) else np.ones(len(ids), np.int64)
    return np.where(hot, ((2 * left.astype(np.int64) + 1) << _PART) + np.minimum((part * parts).astype(np.int64), parts - 1), (2 * right) << _PART)


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """Adds _bucket: about ``n`` ranges of the order by (_id, _tie). ``SAMPLED`` ids for each range reach the driver, longs as they are."""
    spark = rows.sparkSession
    known = F.coalesce(F.col("_id"), F.lit(_NULL)).alias("k")
    total = rows.count()
    share = min(1.0, SAMPLED * n / max(total, 1))
    ids = np.sort(rows.select(known).sample(share, seed=1).toArrow()["k"].to_numpy()) if n > 1 and total else np.zeros(0, np.int64)
    cuts = ids[(np.arange(1, n) * len(ids)) // n] if len(ids) else ids
    sent = spark.sparkContext.broadcast(cuts)  # n longs

    @F.pandas_udf("long")
    def bucket(k: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(k.to_numpy(np.int64), tie.to_numpy(np.int64), sent.value))

    # nulls stand before the least id there is, with which they share a place
    tie, half = F.shiftright("_tie", 1), F.lit(1 << 62)
    return rows.withColumn("_bucket", bucket(known, F.when(F.col("_id").isNull(), tie - half).when(F.col("_id") == _NULL, tie + half).otherwise(F.col("_tie"))))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside that of an edited text, whose second half is the next document's beginning.

    The order is cut into ranges (``buckets``, or some for each task, of which there are as many as the input's size asks for);
    a range also gets a guest, the first row of the range after it, so every row meets its next one with a single shuffle.
    The last row's next one is the first. ``edited_leaves`` tells which leaves were edited.
    """
    spark = docs.sparkSession
    ship(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size_of(docs) or 0) // TASK_BYTES)
    rows = docs.select(column(docs, id_col).cast("long").alias("_id"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("_text"))
    tied = _ranged(rows.withColumn("_tie", F.xxhash64("_text")), buckets or RANGES * tasks)
    known = F.coalesce(F.col("_id"), F.lit(_NULL))
    firsts = tied.groupBy("_bucket").agg(F.min(known).alias("_first")).collect()  # a row for each range
    if not firsts:
        return spark.createDataFrame([], _EDITED_SQL)
    order = sorted((r["_bucket"], r["_first"]) for r in firsts)
    lead = [(*order[i], order[i - 1][0]) for i in range(len(order))]
    to = F.broadcast(spark.createDataFrame(lead, "_of long, _first long, _to long"))  # as many rows as ranges
    heads = tied.join(to, (F.col("_bucket") == F.col("_of")) & (known == F.col("_first")))
    # a null id and the least one stand at one place: nulls first
    head = heads.groupBy("_to").agg(F.min(F.struct(F.col("_id").isNotNull().alias("n"), "_tie", "_text", "_id")).alias("h"))
    guest = head.select(F.col("_to").alias("_bucket"), F.col("h._id").alias("_id"), F.lit(True).alias("_guest"), F.col("h._text").alias("_text"), F.col("h._tie").alias("_tie"))
    every = tied.select("_bucket", "_id", F.lit(False).alias("_guest"), "_text", "_tie").unionByName(guest)
    dealt = every.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", "_guest", F.col("_id").asc_nulls_first(), "_tie", "_text")
    return dealt.select("_bucket", "_id", "_guest", "_text").mapInArrow(_edited, _EDITED_SQL)
