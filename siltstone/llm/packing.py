"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits one sequence. Pieces of one length are alike, so
the program has one row for each length (``capacity`` at most) however many documents there are: least
total weight of configurations that cover the length histogram. A knapsack dynamic program finds the
configurations of highest price; multiplicative weights set the prices. They begin as the lengths
themselves and fall where configurations of high price cover more than there is, rise where they cover less,
class of lengths by class. Any prices over those of their best configuration are a lower bound of the program; the
weights are changed until plan and bound are within ``GAP``, or neither moves any more.

Rounding is by whole plays: a configuration of nearly the highest price is played as often as its rarest length allows,
then that length is closed and the next prices are made. Of what has been played, sequences
under some fill are opened again and their pieces packed best fit; the fill that takes the least sequences
is chosen, of equal ones that which keeps most of the program. ``Plan`` tells the bound and that share.

Only the histogram reaches the driver. Pieces find their place by their rank among those of their length,
which is a running number within the task that made them plus the sum over tasks before; no window and no
group holds all pieces of a length.

Nulls and empty texts are a document of the separator alone. A null id stays null; repeated rows are packed
each; an empty table gives no pieces. Columns besides the two that are named are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.byte_bpe import byte_bpe
from siltstone.llm.texts import blocks_of
from siltstone.session import column, materialize, ship

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
SEPARATOR = 0
#: Configurations within NEAR of the highest price are played; a length's price falls by exp(-FALL) until it is covered.
NEAR, FALL = 0.05, 0.5
#: Plan over bound, less 1, at which prices are good enough.
GAP = 0.01
#: Classes of lengths with a weight each, rounds between two plans, and after how many plans it ends in which neither bound nor plan moves by that share.
CLASSES, ROUNDS, STILL, MOVES = 16, 50, 4, 0.0005
#: Sequences filled less than this are opened again, one threshold after another.
FILLS = (0.0, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 1.0)
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("_task", pa.int64()), ("_rank", pa.int64())])
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, _task long, _rank long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_RESULT = pa.schema([*list(_PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full ones, but for the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to ``capacity`` the highest price of a configuration, and the index into ``lengths`` of a piece in it (-1: less room does as well). Lengths ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := fits[c]:
            gain = best[c - lengths[:k]] + prices[:k]
            if gain[i := int(gain.argmax())] > best[c]:
                best[c], choice[c] = gain[i], i
    return best, choice


def configuration(lengths: np.ndarray, choice: np.ndarray, first: int, capacity: int) -> dict[int, int]:
    """The best one that holds a piece of the ``first`` length, by index into ``lengths``."""
    chosen, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        k = int(choice[room])
        if k < 0:
            room -= 1
        else:
            chosen[k] = chosen.get(k, 0) + 1
            room -= int(lengths[k])
    return chosen


def played(lengths: np.ndarray, counts: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole plays that cover each length exactly: configurations, by length, and how often each is played."""
    left = counts.astype(np.int64)
    out: dict[tuple, int] = {}
    while (at := np.flatnonzero(left)).size:
        open_ = lengths[at]
        weights = (prices * np.exp(-FALL * (1 - left / counts)))[at]
        best, choice = knapsack(open_, weights, capacity)
        value = weights + best[capacity - open_]  # of the best configuration with each length
        some = False
        for i in np.argsort(-value, kind="stable").tolist():
            if value[i] < (1 - NEAR) * best[capacity] - 1e-12:
                break
            if not left[at[i]]:
                continue
            chosen = configuration(open_, choice, i, capacity)
            times = min(int(left[at[k]]) // n for k, n in chosen.items())
            if not times:
                if some:
                    continue
                chosen, times = {k: m for k, n in chosen.items() if (m := min(n, int(left[at[k]])))}, 1  # each round covers something
            some = True
            for k, n in chosen.items():
                left[at[k]] -= n * times
            key = tuple(sorted((int(open_[k]), n) for k, n in chosen.items()))
            out[key] = out.get(key, 0) + times
    return [(dict(k), n) for k, n in out.items()]


class Prices:
    """Dual prices of the lengths, by multiplicative weights over classes of lengths. ``bound``: the best lower bound so far, of ``best``."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.counts, self.capacity = lengths, counts.astype(float), capacity
        mass = np.cumsum(self.counts)
        self.of = np.unique(np.minimum((mass - self.counts / 2) / mass[-1] * CLASSES, CLASSES - 1).astype(int), return_inverse=True)[1]
        self.size = np.bincount(self.of, self.counts)
        self.weights, self.total, self.rounds = np.zeros(len(self.size)), np.zeros(len(lengths)), 0
        self.best, self.mean, self.bound = lengths / capacity, lengths / capacity, 0.0
        self._bound(self.best)

    def _bound(self, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prices over their best configuration's are feasible in the dual."""
        best, choice = knapsack(self.lengths, prices, self.capacity)
        prices = prices / best[self.capacity]
        if (bound := float(prices @ self.counts)) > self.bound:
            self.bound, self.best = bound, prices
        return prices, best / best[self.capacity], choice

    def improve(self, rounds: int) -> None:
        for _ in range(rounds):
            self.rounds += 1
            prices, best, choice = self._bound(self.lengths / self.capacity * np.exp(self.weights[self.of]))
            self.total += prices
            value = prices + best[self.capacity - self.lengths]
            covered, plays = np.zeros(len(self.size)), 0.0
            for i in np.flatnonzero(value >= 1 - NEAR).tolist():
                play = self.counts[i] * np.exp(-10 / NEAR * (1 - value[i]))  # those of the highest price most
                plays += play
                for k, n in configuration(self.lengths, choice, i, self.capacity).items():
                    covered[self.of[k]] += n * play
            ratio = covered / plays * float(prices @ self.counts) / self.size
            self.weights -= 0.3 / np.sqrt(self.rounds) * np.clip(ratio - 1, -1, 1)
        self.mean = self._bound(self.total / self.rounds)[0]  # of all prices so far: steadier than each


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole configurations for what is left of a histogram: the longest piece opens a sequence, whose room is filled as far as the
    pieces there are can fill it, the longest of them first; repeated while counts last."""
    left = {k: n for k, n in left.items() if n}
    order = sorted(left, reverse=True)
    out = []
    while order:
        first = order[0]
        room = capacity - first
        chosen = {first: 1}
        sums, wanted, steps = 1, 1 << room, []  # bit s: some of the pieces so far have the sum s
        within = (wanted << 1) - 1
        for k in order:
            if sums & wanted:
                break
            for _ in range(min(room // k, left[k] - (k == first))):
                new = (sums | sums << k) & within
                if new == sums:
                    break
                steps.append((k, sums))
                sums = new
        rest = sums.bit_length() - 1
        for k, before in reversed(steps):
            if not before >> rest & 1:
                chosen[k] = chosen.get(k, 0) + 1
                rest -= k
        times = min(left[k] // n for k, n in chosen.items())
        for k, n in chosen.items():
            left[k] -= n * times
            if not left[k]:
                order.remove(k)
        out.append((chosen, times))
    return out


@dataclass
class Plan:
    """configurations: (lengths and how many of each, how often), which hold the histogram exactly. bound: no packing has fewer
    sequences. program: of the sequences those that the program has played, the others are packed best fit."""

    configurations: list[tuple[dict[int, int], int]]
    bound: float
    program: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def rounded(program: list[tuple[dict[int, int], int]], capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """The least of what the thresholds give, and how many sequences of it the program has played."""
    best: list | None = None
    least = kept = 0
    for fill in FILLS:
        whole, left = [], {}
        for chosen, n in program:
            if sum(k * m for k, m in chosen.items()) >= fill * capacity:
                whole.append((chosen, n))
            else:
                for k, m in chosen.items():
                    left[k] = left.get(k, 0) + m * n
        way = whole + best_fit(left, capacity)
        if best is None or sum(n for _, n in way) < least:
            best, least, kept = way, sum(n for _, n in way), sum(n for _, n in whole)
    return best, kept


def plan(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP) -> Plan:
    """Full pieces are a sequence each; the others are packed by the program."""
    full = histogram.get(capacity, 0)
    whole = [({capacity: 1}, full)] if full else []
    pieces = {int(k): n for k, n in sorted(histogram.items()) if n and k < capacity}
    if not pieces:
        return Plan(whole, float(full), full)
    lengths, counts = (np.array(list(x), dtype=np.int64) for x in (pieces, pieces.values()))
    prices = Prices(lengths, counts, capacity)
    best, kept = rounded(played(lengths, counts, prices.best, capacity), capacity)
    used, still = sum(n for _, n in best), 0
    while used > max(math.ceil(prices.bound - 1e-6), (1 + gap) * prices.bound) and still < STILL:
        before = used, prices.bound
        prices.improve(ROUNDS)
        way, n_kept = rounded(played(lengths, counts, prices.mean, capacity), capacity)
        if (n := sum(n for _, n in way)) < used:
            best, kept, used = way, n_kept, n
        still = still + 1 if used > before[0] * (1 - MOVES) and prices.bound < before[1] * (1 + MOVES) else 0
    return Plan(whole + best, full + prices.bound, full + kept)


@dataclass
class Slots:
    """Where the piece of a length with a rank goes. Its arrays have a row for each length of each
    configuration: at most sqrt(2 * capacity) times as many as there are configurations, of which each round
    of the program plays one for each length at most."""

    key: np.ndarray  # length * SPAN + first rank
    first: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    SPAN = 1 << 44

    @classmethod
    def of(cls, configurations: list[tuple[dict[int, int], int]]) -> Slots:
        ranks: dict[int, int] = {}
        rows, sequence = [], 0
        for chosen, times in configurations:
            offset = 0
            for k, n in sorted(chosen.items(), reverse=True):
                r = ranks.get(k, 0)
                rows.append((k * cls.SPAN + r, r, sequence, n, offset))
                ranks[k] = r + n * times
                offset += k * n
            sequence += times
        cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T
        return cls(*cols)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * self.SPAN + rank, side="right") - 1
        copy, within = np.divmod(rank - self.first[at], self.times[at])
        return self.sequence[at] + copy, self.offset[at] + within * length


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = byte_bpe(path), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in blocks_of(texts):
                rows = []
                for doc, text in zip(ids[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    coded = np.append(bpe.ids(text or ""), np.uint32(SEPARATOR)).astype("<u4", copy=False)
                    view = memoryview(coded).cast("B")
                    for i, (start, n) in enumerate(pieces_of(len(coded), capacity)):
                        rows.append((doc, i, start, n, zlib.crc32(view[4 * start : 4 * (start + n)]), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col)).mapInArrow(run, _PIECES_SQL)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, gap: float = GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every row of ``docs`` with its place."""
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    ship(spark)
    pieces = materialize(tokenized_pieces(docs, path, capacity, id_col, text_col), "pieces")
    by_task = pieces.groupBy("_task", "length").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if not histogram:
        return spark.createDataFrame([], RESULT)
    slots = spark.sparkContext.broadcast(Slots.of(plan(histogram, capacity, gap).configurations))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    base = by_task.select("_task", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["_task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_rank")).alias("_at"))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = slots.value.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], schema=_RESULT)

    return ranked.mapInArrow(place, RESULT)
