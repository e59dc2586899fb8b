"""Toxicity: a support vector machine with a subsequence string kernel on Nyström landmarks.

The kernel compares two words by their common subsequences of four characters, gaps included: one that
spans more of the word weighs less, so an insult with inserted or dropped characters stays close to it.
Words are cut from sentences at anything but letters; a word with marks inside it (``i-d-i-o-t``) and a
row of single letters (``i d i o t``) are also read as one.

Only documents are labelled, so training looks for witnesses: the sentences of a clean document hold no
toxic word; those of a toxic one may: at first the words that are too common in toxic
documents for chance, or have a part of five characters that is, then those the machine finds like them.
Words of clean documents that come near are its next negatives. Landmarks are drawn
from both kinds of words. As subsequences are explicit features, the landmarks' kernel expansion folds
into one weight for each hashed subsequence: scoring a word reads ten weights for each character.
A document's score is a logistic function of its words' highest margins.

Training reads at most ``SAMPLE`` labelled documents of each class, chosen by the hash of their ids, of
``SAMPLE_CHARS`` code points together; of several texts with one id, the least. Of their words it takes ``LANDMARKS`` as
landmarks (half of them the commonest witnesses), ``NEGATIVES`` as negatives at first and half as many that come near in each of
``ROUNDS`` rounds, and the ``BENT`` commonest witnesses with characters inserted. The logistic function is learnt from a
fourth of the sample that the machine hasn't seen, or with under 100 distinct documents of a class from all of it. Every text is scored whole.

Nulls and empty texts have no words: the score of a document in which nothing is found. Without labels of
both classes all scores are 0. A null id is not held out. Repeated rows get repeated scores; of repeated
labels the highest counts. Columns besides those that are named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.texts import blocks_of
from siltstone.session import column, ship

SAMPLE, SAMPLE_CHARS = 2500, 8_000_000
LANDMARKS, NEGATIVES, ROUNDS = 320, 10_000, 3
#: Characters of a subsequence, the widest span, the weight of each skipped character.
SPAN, DECAY = 6, 0.5
HASHED = 20
#: Commonest witnesses that are also learnt with characters inserted.
BENT = 100
#: Words that a worker remembers, and words whose subsequences are in memory at once.
REMEMBERED, AT_ONCE = 1 << 18, 8_000
_OFFSETS = [(j, k, m) for j in range(1, SPAN) for k in range(j + 1, SPAN) for m in range(k + 1, SPAN)]
_WORD = re.compile(r"[^\W\d_]+")
_INNER = re.compile(r"[^\w\s](?=[^\W\d_])")
_MARKED = re.compile(r"[^\W\d_]+(?:[^\w\s]+[^\W\d_]+)+")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def words_of(text: str) -> list[str]:
    low = text.lower()
    out = _WORD.findall(low)
    single = np.fromiter(map(len, out), np.int64, len(out)) == 1
    if (single[2:] & single[1:-1] & single[:-2]).any():  # three single letters in a row, whatever is between
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        out += ["".join(out[i:j]) for i, j in edge.reshape(-1, 2).tolist() if j - i > 2]
    if _INNER.search(low):
        out += [_NOT_LETTERS.sub("", w) for w in _MARKED.findall(low)]
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed subsequence, weight) of each occurrence; a word's squared weights sum to 1."""
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    at = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), size)
    rows, codes, weights = [], [], []
    a, b, c, d = (at * np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))
    for j, k, m in _OFFSETS:
        if len(at) <= m:
            continue
        inside = np.flatnonzero(word[m:] == word[:-m])
        h = a[inside] + b[inside + j] + c[inside + k] + d[inside + m]
        h ^= h >> np.uint32(15)
        rows.append(word[inside])
        codes.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASHED))
        weights.append(np.full(len(inside), DECAY ** (m - 3), np.float32))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.float32)
    row, code, weight = np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)
    norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
    return row, code, (weight / norm[row]).astype(np.float32)


@dataclass
class Model:
    """weights: of hashed subsequences; bias: a word's margin without any; logistic: of a document's features."""

    weights: np.ndarray
    bias: float
    logistic: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE]
            row, code, weight = subsequences(part)
            out[i : i + len(part)] += np.bincount(row, weight * self.weights[code], len(part))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.logistic[:-1] + self.logistic[-1], -50, 50)))


def document_features(margins: list[float]) -> tuple[float, float]:
    """Of the distinct words' margins: the highest, cut to -1.5 to 1.5, and how many are over 0.3."""
    return min(max(max(margins, default=-1.5), -1.5), 1.5), math.log1p(sum(m > 0.3 for m in margins))


class Scorer:
    """Scores texts; remembers words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        split = [set(words_of(t)) for t in texts]
        if new := set().union(*split).difference(self.known):
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {}, set().union(*split)
            listed = sorted(new)
            self.known.update(zip(listed, self.model.margins(listed).tolist(), strict=True))
        return self.model.score(np.array([document_features(list(map(self.known.__getitem__, w))) for w in split], float).reshape(-1, 2))


def _kernel(words: list[str], codes: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Words by landmarks. landmarks: codes by landmarks."""
    out = np.zeros((len(words), landmarks.shape[1]), np.float32)
    for i in range(0, len(words), 250):  # a row of landmarks for each subsequence: some 25 MB
        part = words[i : i + 250]
        row, code, weight = subsequences(part)
        col = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        hit = codes[col] == code
        row, col, weight = row[hit], col[hit], weight[hit]
        order = np.argsort(row, kind="stable")
        row, col, weight = row[order], col[order], weight[order]
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[i + row[first]] = np.add.reduceat(landmarks[col] * weight[:, None], first, axis=0)
    return out


def nystrom(marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes; landmarks as codes by landmarks; landmarks by features, such that kernel values times these have the kernel as their dot product."""
    row, code, weight = subsequences(marks)
    codes = np.unique(code)
    phi = np.zeros((len(codes), len(marks)), np.float32)
    np.add.at(phi, (np.searchsorted(codes, code), row), weight)
    values, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    good = values > 1e-4 * values[-1]
    return codes, phi, vectors[:, good] / np.sqrt(values[good])


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Squared hinge loss with an L2 penalty, by Newton steps; the last weight is the bias."""
    k = z.shape[1] + 1
    w, ridge = np.zeros(k), np.eye(k)
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(k)
        for i in range(0, len(z), 2000):
            x = np.hstack([z[i : i + 2000], np.ones((len(z[i : i + 2000]), 1))])
            on = y[i : i + 2000] * (x @ w) < 1
            costly = x[on] * cost[i : i + 2000][on][:, None]
            left += costly.T @ x[on]
            right += costly.T @ y[i : i + 2000][on]
        new = np.linalg.solve(left, right)
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1]) * 0.01
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _apart(bags: list[list[str]]) -> list[list[str]]:
    """Without bags that share most of their words with an earlier one: copies say nothing about words."""
    seen: dict[int, set[int]] = {}
    out = []
    for bag in bags:
        marks = sorted(map(hash_of, bag))[:8]
        near = Counter(k for m in marks for k in seen.get(m, ()))
        if marks and max(near.values(), default=0) * 2 >= len(marks):
            continue
        for m in marks:
            seen.setdefault(m, set()).add(len(out))
        out.append(bag)
    return out


def _bent(word: str) -> list[str]:
    """The word with a character inserted or doubled, as those write it who mean to pass a filter."""
    if len(word) < 4:
        return []
    k = hash_of(word)
    inner = [1 + (k + i * (len(word) // 3 or 1)) % (len(word) - 1) for i in range(3)]
    return [*(word[:i] + "xzkq"[(k >> i) & 3] + word[i:] for i in inner), *(word[:i] + word[i] + word[i:] for i in inner[:2])]


def _grams(word: str) -> list[str]:
    """Parts of five characters, borders included."""
    w = f"^{word}$"
    return [w[i : i + 5] for i in range(len(w) - 4)] if len(w) > 5 else [w]


def _telling(pos: Counter, neg: Counter, share: float) -> set[str]:
    """Units that toxic documents hold too often for chance, tested for all units that are as frequent."""
    tested = Counter(n + neg[u] for u, n in pos.items())
    at_least: dict[int, int] = {}
    total = 0
    for n in sorted(tested, reverse=True):
        total += tested[n]
        at_least[n] = total
    out = set()
    for u, k in pos.items():
        n = k + neg[u]
        if neg[u] * 20 <= k and math.log(math.comb(n, k)) + k * math.log(share) + math.log(at_least[n]) < math.log(0.02):
            out.add(u)
    return out


def fit(toxic: list[list[str]], clean: list[list[str]]) -> Model | None:
    """toxic, clean: the distinct words of each labelled document."""
    if not toxic or not clean:
        return None
    bags, calm = _apart(toxic), _apart(clean)
    if len(bags) < 100 or len(calm) < 100:
        model = _machine(bags, calm)
        model.logistic = _calibrated(model, bags, calm)
        return model
    # the documents' logistic function is learnt from a fourth that the machine hasn't seen; then it sees all
    seen = ([b for i, b in enumerate(x) if i % 4] for x in (bags, calm))
    logistic = _calibrated(_machine(*seen), bags[::4], calm[::4])
    model = _machine(bags, calm)
    model.logistic = logistic
    return model


def _calibrated(model: Model, bags: list[list[str]], calm: list[list[str]]) -> np.ndarray:
    words = sorted({w for d in bags + calm for w in d})
    margin = dict(zip(words, model.margins(words).tolist(), strict=True))
    x = np.array([document_features([margin[w] for w in d]) for d in bags + calm])
    return _logistic(x, np.concatenate([np.ones(len(bags)), np.zeros(len(calm))]))


def _machine(bags: list[list[str]], calm: list[list[str]]) -> Model:
    pos, neg = Counter(w for d in bags for w in d), Counter(w for d in calm for w in d)
    parts = [Counter(g for d in b for g in {g for w in d if len(w) > 2 for g in _grams(w)}) for b in (bags, calm)]
    share = len(bags) / (len(bags) + len(calm))
    telling = _telling(*parts, share)
    witnesses = _telling(pos, neg, share) | {w for w in pos if not neg[w] and len(w) > 2 and any(g in telling for g in _grams(w))}
    if not witnesses:  # too few labels to tell: the words with the best odds
        witnesses = set(sorted((w for w in pos if len(w) > 2), key=lambda w: (-(pos[w] + 0.5) / (neg[w] + 0.5), w))[:20])
    calm_words = sorted(neg, key=hash_of)
    negatives = [w for w in calm_words if w not in witnesses][:NEGATIVES]
    model = None
    for _ in range(ROUNDS):
        marks = sorted(witnesses, key=lambda w: (-pos[w], w))[: LANDMARKS // 2]
        marks += [w for w in negatives if len(w) > 3][: LANDMARKS - len(marks)]
        codes, phi, root = nystrom(marks)
        ones = sorted(witnesses)
        bent = [v for w in sorted(witnesses, key=lambda w: (-pos[w], w))[:BENT] for v in _bent(w) if v not in neg]
        z = _kernel(ones + bent + negatives, codes, phi) @ root
        y = np.concatenate([np.ones(len(ones) + len(bent)), -np.ones(len(negatives))])
        count = np.log1p(np.array([pos[w] for w in ones] + [1] * len(bent) + [neg[w] for w in negatives], float))
        w = _svm(z, y, count * np.where(y > 0, 50.0 * max(1.0, min(10.0, len(negatives) / len(ones) / 20)), 50.0))
        weights = np.zeros(1 << HASHED, np.float32)
        weights[codes] = phi @ (root @ w[:-1])
        model = Model(weights, float(w[-1]), np.zeros(3))
        words = sorted(set(pos) | set(neg))
        margin = dict(zip(words, model.margins(words).tolist(), strict=True))
        found = {x for x in pos if not neg[x] and margin[x] > 0.3 and len(x) > 2} - witnesses
        held = set(negatives)
        hard = [x for x in calm_words if x not in witnesses and margin[x] > -0.6]
        hard = [x for x in sorted(hard, key=lambda x: -margin[x])[: NEGATIVES // 2] if x not in held]
        if not found and not hard:
            break
        witnesses |= found
        negatives = [x for x in negatives if x not in witnesses] + hard
    return model


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def held_out(doc_id):
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_MODEL = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("logistic", pa.list_(pa.float64()))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fits on at most ``sample`` labelled rows of each class which are not held out."""
    ship(docs.sparkSession)
    rows = labels.select(column(labels, id_col).cast("long").alias("_id"), column(labels, label_col).cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = rows.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    drawn = [known.where("_toxic > 0"), known.where("_toxic <= 0")]
    picked = drawn[0].orderBy(F.xxhash64("_id"), "_id").limit(sample).unionByName(drawn[1].orderBy(F.xxhash64("_id"), "_id").limit(sample))
    texts = docs.select(column(docs, id_col).cast("long").alias("_id"), F.coalesce(column(docs, text_col), F.lit("")).alias("_text"))
    # of several texts with one id the least; a text that no label is drawn for is not shuffled
    drawn_texts = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    size = drawn_texts.select("_id", "_toxic", F.length("_text").alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()  # 2 * sample rows
    total, kept = 0, []
    for r in size:
        if total + r["n"] <= chars:
            total += r["n"]
            kept.append((r["_id"], r["_toxic"]))
    if not kept:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(kept, "_id long, _toxic int"))

    def distinct_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(set(words_of(t))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string()))], names=["_id", "_toxic", "_words"])

    def learnt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        split: tuple[list, list] = ([], [])
        for _, toxic, words in sorted(rows):
            split[toxic <= 0].append(words)
        if model := fit(*split):
            yield pa.RecordBatch.from_pylist([{"weights": model.weights.tobytes(), "bias": model.bias, "logistic": model.logistic.tolist()}], _MODEL)

    # the sample is bounded, and one task fits the model: the driver gets the weights only
    bags = drawn_texts.drop("_toxic").join(chosen, "_id").select("_id", "_toxic", "_text").mapInArrow(distinct_words, "_id long, _toxic int, _words array<string>")
    got = bags.repartition(1).mapInArrow(learnt, "weights binary, bias double, logistic array<double>").collect()
    return Model(np.frombuffer(got[0]["weights"], np.float32), got[0]["bias"], np.array(got[0]["logistic"])) if got else None


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row. One pass, no shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for b in batches:
            for i, j in blocks_of(b.column(2)):
                texts = [t or "" for t in b.column(2).slice(i, j - i).to_pylist()]
                s = scorer.scores(texts) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=schema)

    rows = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("_text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that score below 0.5, with all columns of ``docs``."""
    if model is None:
        return docs
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fine(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(sent.value)
        for texts in parts:
            out = np.zeros(len(texts), bool)
            column = pa.array(texts, pa.string(), from_pandas=True)
            for i, j in blocks_of(column):
                out[i:j] = scorer.scores([t or "" for t in column.slice(i, j - i).to_pylist()]) < 0.5
            yield pd.Series(out)

    fine.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(fine(column(docs, text_col)))
