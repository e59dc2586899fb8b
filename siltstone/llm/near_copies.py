"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Candidates come from two sides. Sets whose SimHash fingerprints are 3 bits apart at most meet in balls, as in ``simhash``, and are linked
to the centre of their ball. That alone doesn't reach far enough: at 0.8 two fingerprints of 64 bits are 10 bits apart on average. So
candidates are also those that share a band: the hash of ``ROWS`` minima of the set under as many hash functions. Of 40 bands two
texts at 0.8 share none with a probability of 5e-6, and less above.

Links are candidates whose parities and sketches (four bits of each minimum) don't rule 0.8 out, and whose sets are
then compared whole, made anew from the two texts. In each of ``ROUNDS`` rounds a band has one pivot, a node of its largest component so far, and
every node outside of that component is compared with the likest of its bands' pivots: a group of copies costs a pair for each node, whatever
its size. The first pivots are the nodes that meet most others, so those that were edited least. What is left then is compared in full: the nodes
outside of a band's largest component with those of all its other components whose sizes allow 0.8. So a large group of near copies meets those
of its bands that are in no way like it, never itself; and of these meetings parities leave hardly more than those that are links.

A set's parity has a bit for each of ``PARITY`` classes of hashes, set if the set has an odd number of the class. Where two parities differ the sets do, so
sets differ in as many shingles as parities in bits, or in more: a pair that is ruled out by them isn't alike, with certainty.

Texts of one shingle set are one node, and so are texts without words. Letters are compared without ASCII case.
Null texts count as empty. Of rows with a null id, or rows that repeat one another, one stays as of any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm import simhash
from siltstone.llm.graph import stars
from siltstone.llm.simhash import SEED, keep_least, majority, shingles_of, text_hash
from siltstone.llm.texts import blocks_of
from siltstone.session import column, materialize, ship

SHINGLE = 5
#: Similarity from which texts are near copies, as a fraction.
LIKE, OF = 4, 5
BANDS, ROWS = 40, 6
#: Minima, each with four bits of the sketch. At 0.8 these differ in 45 of them on average, with a deviation of 6.
MINIMA, MOST_APART = BANDS * ROWS, 75
#: Bits of a parity.
PARITY = 1024
#: Rounds with one pivot for each band.
ROUNDS = 2
_A = np.array([xxhash.xxh32_intdigest(b"a%d" % i, SEED) | 1 for i in range(MINIMA)], np.uint32)[:, None]
_B = np.array([xxhash.xxh32_intdigest(b"b%d" % i, SEED) for i in range(MINIMA)], np.uint32)[:, None]


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(text, shingle)), np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(hashes), 1 << 12):  # of very long texts not all at once
        part = (hashes[a : a + (1 << 12)] >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, (_A * part + _B).min(axis=1))
    return low


def bands_of(low: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(low[ROWS * i : ROWS * (i + 1)].tobytes(), i) for i in range(BANDS)]


def sketch_of(low: np.ndarray) -> np.ndarray:
    """Words of 64 bits, four bits of a minimum each."""
    four = ((low * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return (four[::2] << 4 | four[1::2]).view(np.int64)


def parity_of(hashes: np.ndarray) -> np.ndarray:
    """Words of 64 bits: of each class of hashes, whether the set has an odd number."""
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_COLS = ("_id", "_tie", "_fp", "_size", "_sim", "_sketch", "_parity", "_bands")
_LONGS = pa.list_(pa.int64())
_PRINTS = pa.schema([*((c, pa.int64()) for c in _COLS[:5]), *((c, _LONGS) for c in _COLS[5:])])
_PRINTS_SQL = ", ".join([*(f"{c} long" for c in _COLS[:5]), *(f"{c} array<long>" for c in _COLS[5:])])


def prints_of(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """_id, _tie (hash of the text), _fp (of the set), _sim (SimHash of the set) and the signatures of each row. One pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in blocks_of(b.column(2)):
                rows = []
                for t in b.column(2).slice(i, j - i).to_pylist():
                    s = shingle_set(t or "", shingle)
                    low = minima(s)
                    bands = np.array(bands_of(low) if len(s) else [], np.uint64).view(np.int64)
                    rows.append((xxhash.xxh64_intdigest(s.tobytes(), SEED), len(s), majority(s), sketch_of(low), parity_of(s), bands))
                fps, sizes, sims, *lists = zip(*rows, strict=True)
                longs = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in (fps, sizes, sims))
                cols = [*longs, *(pa.array(c, _LONGS) for c in lists)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *cols], schema=_PRINTS)

    return docs.select(column(docs, id_col).cast("long"), text_hash(docs, text_col), column(docs, text_col)).mapInArrow(run, _PRINTS_SQL)


def _apart(a: str, b: str) -> Column:
    """In how many minima two sketches differ."""
    four = "(x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & 1229782938247303441L"
    each = (four.replace("x", f"({a}._sketch[{i}] ^ {b}._sketch[{i}])") for i in range(MINIMA // 16))
    return F.expr(" + ".join(f"bit_count({e})" for e in each))


def _may_be_like(a: str, b: str) -> Column:
    sizes = F.expr(f"{OF} * least({a}._size, {b}._size) >= {LIKE} * greatest({a}._size, {b}._size)")
    # at a similarity of 0.8 sets differ in a ninth of their sizes' sum
    differ = " + ".join(f"bit_count({a}._parity[{i}] ^ {b}._parity[{i}])" for i in range(PARITY // 64))
    return sizes & F.expr(f"{OF + LIKE} * ({differ}) <= {OF - LIKE} * ({a}._size + {b}._size)") & (_apart(a, b) <= MOST_APART)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Of two sets, whether their similarity is 0.8 or more."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return (LIKE + OF) * common >= LIKE * (len(a) + len(b))


_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def verified(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose texts (_fp, _text) have sets that are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            us, vs = b.column(0).to_pylist(), b.column(1).to_pylist()
            good = []
            for i in range(b.num_rows):
                if us[i] != last:
                    last, held = us[i], shingle_set(b.column(2)[i].as_py(), shingle)
                if alike(held, shingle_set(b.column(3)[i].as_py(), shingle)):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], schema=_LINK)

    both = pairs.join(texts.select(F.col("_fp").alias("v"), F.col("_text").alias("_s")), "v").join(texts.select(F.col("_fp").alias("u"), F.col("_text").alias("_t")), "u")
    return both.select("u", "v", "_t", "_s").mapInArrow(run, "u long, v long")


def _rooted(nodes: DataFrame, linked: DataFrame | None) -> DataFrame:
    """nodes with the root of each's component so far (the v of its u in ``linked``), itself if it has no other."""
    if linked is None:
        return nodes.withColumn("root", F.col("_fp"))
    return nodes.join(linked.select(F.col("u").alias("_fp"), F.col("v").alias("root")), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))


def _mixed(placed: DataFrame, seed: int) -> DataFrame:
    """_band, _big, _pivot of bands (of rows _band, _fp, _meets, root) that hold several components: the root of the largest one, and a node of it:
    with seed 0 the one that meets most others, else any."""
    first = F.col("_meets") if seed == 0 else F.lit(0).cast("long")
    held = placed.groupBy("_band", "root").agg(F.count("*").alias("n"), F.max(F.struct(first.alias("first"), F.xxhash64("_fp", F.lit(seed)).alias("h"), "_fp")).alias("p"))
    most = F.max(F.struct("n", "p.first", F.xxhash64("root", F.lit(seed)).alias("h"), "root", F.col("p._fp").alias("pivot"))).alias("m")
    return held.groupBy("_band").agg(most, F.count("*").alias("k")).where("k > 1").select("_band", F.col("m.root").alias("_big"), F.col("m.pivot").alias("_pivot"))


def in_balls(nodes: DataFrame) -> DataFrame:
    """u, v: pairs of ``nodes`` (_fp, _sim) with fingerprints 3 bits apart at most; enough of them to connect all such. Nodes of one fingerprint are
    a star around their least, and that stands for them in the balls."""
    least = materialize(nodes.groupBy("_sim").agg(F.min("_fp").alias("_least")), "least")
    met = simhash.links(least.select(F.col("_sim").alias("_fp")))
    of = {c: least.select(F.col("_sim").alias(c), F.col("_least").alias(f"{c}_fp")) for c in ("u", "v")}
    across = met.join(of["u"], "u").join(of["v"], "v").select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))
    same = nodes.select("_fp", "_sim").join(least, "_sim").where("_fp <> _least").select(F.col("_least").alias("u"), F.col("_fp").alias("v"))
    return materialize(across.unionByName(same), "balls")


def _near(pairs: DataFrame, attributes: DataFrame) -> DataFrame:
    """u, v, n (in how many minima they differ) of ``pairs`` (u, v) that may be alike."""
    a, b = (attributes.select(F.col("_fp").alias(c), "_size", "_sketch", "_parity").alias(c) for c in ("u", "v"))
    both = pairs.alias("p").join(a, F.col("p.u") == F.col("u.u")).join(b, F.col("p.v") == F.col("v.v"))
    return both.where(_may_be_like("u", "v")).select("p.u", "p.v", _apart("u", "v").alias("n"))


def links(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shingle: int) -> DataFrame:
    """u, v: links of ``nodes`` that connect all pairs which are alike and share a band or a ball: those of the last comparison, and of each component
    before that its nodes to its least one. texts_of: _fp, _text of the nodes (_fp) it is given."""
    balls = in_balls(nodes)
    entries = nodes.select("_fp", F.explode("_bands").alias("_band"))
    shared = entries.groupBy("_band").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(entries.join(shared, "_band"), "met")
    meets = met.groupBy("_fp").agg(F.sum("n").alias("_meets"))
    some = meets.select("_fp").unionByName(balls.select(F.col("u").alias("_fp"))).unionByName(balls.select(F.col("v").alias("_fp"))).distinct()
    attributes = materialize(nodes.select("_fp", "_size", "_sketch", "_parity").join(some, "_fp", "left_semi").join(meets, "_fp", "left"), "attributes")
    texts = materialize(texts_of(attributes.select("_fp")), "texts")
    met, banded = met.drop("n"), attributes.where("_meets is not null").select("_fp", "_meets")
    linked: DataFrame | None = None
    for i in range(ROUNDS):
        placed = materialize(met.join(_rooted(banded, linked), "_fp"), "placed")
        outside = placed.join(_mixed(placed, i), "_band").where("root <> _big").select(F.col("_pivot").alias("u"), F.col("_fp").alias("v")).distinct()
        likest = _near(outside, attributes).groupBy("v").agg(F.min(F.struct("n", "u")).alias("p")).select("p.u", "v")
        if linked is None:
            likest = likest.unionByName(_near(balls, attributes).select("u", "v")).distinct()
        new = verified(materialize(likest, "pairs"), texts, shingle)
        linked = stars(new if linked is None else linked.unionByName(new))
    placed = materialize(met.join(_rooted(banded, linked), "_fp"), "placed")
    # sizes of sets that are alike are a factor of 1.25 apart at most, and so are in one class or in neighbouring ones
    size_class = F.floor(F.log(F.col("_size").cast("double")) / F.log(F.lit(1.001 * OF / LIKE)))
    several = placed.join(_mixed(placed, 0), "_band").select("_band", "_fp", "root", "_big")
    mixed = materialize(several.join(attributes.drop("_meets"), "_fp").withColumn("_class", size_class), "mixed")
    small = mixed.where("root <> _big").withColumn("_class", F.explode(F.expr("array(_class - 1, _class, _class + 1)")))
    a, b = small.alias("a"), mixed.alias("b")
    meet = (F.col("a._band") == F.col("b._band")) & (F.col("a._class") == F.col("b._class")) & (F.col("a.root") != F.col("b.root"))
    rest = a.join(b, meet & ((F.col("b.root") == F.col("b._big")) | (F.col("a._fp") < F.col("b._fp"))) & _may_be_like("a", "b"))
    rest = rest.select(F.least("a._fp", "b._fp").alias("u"), F.greatest("a._fp", "b._fp").alias("v")).distinct()
    return linked.unionByName(verified(materialize(rest, "pairs"), texts, shingle))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all columns of ``docs``: the one of the least id (nulls last), then text hash."""
    prints = materialize(prints_of(docs, shingle, id_col, text_col), "prints")
    # nulls last: their flag is the first of the order
    order = F.struct(F.col("_id").isNull().alias("n"), "_id", "_tie")
    nodes = materialize(prints.groupBy("_fp").agg(F.min(order).alias("_least"), *(F.first(c).alias(c) for c in ("_size", "_sim", "_sketch", "_parity", "_bands"))), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """Each node's text is that of its least row. Texts are dealt by row, so that a node of many rows is none of many texts."""
        rows = nodes.select("_fp", "_least").join(wanted, "_fp", "left_semi").select("_fp", F.xxhash64("_least._id", "_least._tie").alias("_row"), F.col("_least._tie").alias("_tie"))
        whole = docs.select(F.xxhash64(column(docs, id_col).cast("long"), text_hash(docs, text_col)).alias("_row"), text_hash(docs, text_col).alias("_tie"), F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("_text"))
        found = materialize(whole.join(rows, ["_row", "_tie"]).select("_fp", "_text"), "found")  # written: else Spark can't split a row that is repeated often
        return found.dropDuplicates(["_fp"])

    linked = stars(links(nodes, texts_of, shingle)).select(F.col("u").alias("_fp"), F.col("v").alias("root"))
    return keep_least(docs, nodes.select("_fp", "_least"), linked, id_col, text_col)
