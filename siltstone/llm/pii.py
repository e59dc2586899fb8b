"""Personal data: patterns with checks, and a linear-chain conditional random field that adds to them.

The base finds emails, IP addresses, payment cards and phones by pattern, in time proportional to the text
whatever it holds. The field reads what the patterns can't: addresses spelt with "at" and "dot", phones
without a plus, two cards in a row, dotted cards, bracketed IP addresses. Its features are word shapes, those
of the neighbours, and a few words; it is trained on the small labelled table of ``labelled_table`` (or
another) by gradient ascent of the likelihood, and decoded by Viterbi over many windows side by side, in numpy.
Every span that is added holds one of the characters or words that such data can't do without (a digit, ``@``,
"dot", a bracketed "at"), so decoding begins with the words around each of these, joined where they overlap, and a window goes on, twice as
far each time, until its outer labels say that nothing goes on there. Features see the words beyond its
ends, and its path is the best one with nothing outside: that of the whole text. Spans have no longest length. Added
spans obey the checks of their kind and never overlap base spans, all of which stay.

Nulls and empty texts hold nothing. A null id stays null; repeated rows give repeated results. Offsets are
code points, ends exclusive. The counts are of base spans, ``n_added`` is of the others. Columns besides
the two that are named are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.texts import blocks_of, by_block
from siltstone.session import column, columns, ship, unused

KINDS = ("email", "ip", "card", "phone")
#: Code points of a window on either side of what opens it, at first; tokens beyond it that features see; outer tokens that must hold nothing.
AROUND, SEEN, EDGE = 64, 3, 3
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", end if m else at + 1)


def _byte(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 and (len(part) <= 3 or not part[:-3].strip("0"))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# The field -----------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_OPENS = re.compile(r"[0-9@]|(?i:\bdot\b)|(?i:[(\[{<]\s{0,2}at\s{0,2}[)\]}>])")
_KNOWN = frozenset("at dot com org net edu gov io de fr es uk mail email phone tel call mobile fax card visa ip host version".split())
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Features of a token are numbers below this; each is hashed from its name.
WIDTH = 1 << 14


@lru_cache(maxsize=1 << 16)
def _shape(token: str) -> str:
    if token.isdigit() and token.isascii():
        return f"9x{min(len(token), 20)}"
    if token.isalpha():
        low = token.lower()
        if low in _KNOWN:
            return low
        return f"{'A' if token.isupper() else 'Aa' if token[0].isupper() else 'a'}{min(len(token), 4)}"
    return token


@lru_cache(maxsize=1 << 18)
def _feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % WIDTH


def _features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens by features."""
    shapes = [_shape(text[a:b]) for a, b in spans]
    n = len(spans)
    gap = ["^", *("" if spans[i][0] == spans[i - 1][1] else "_" for i in range(1, n))]
    value = ["" if not s.startswith("9x") or len(s) > 3 else ("b" if int(text[a:b]) < 256 else "g") for s, (a, b) in zip(shapes, spans, strict=True)]
    at = lambda seq, i, other: seq[i] if 0 <= i < n else other
    rows = []
    for i in range(n):
        s, g, h = shapes[i], gap[i], at(gap, i + 1, "$")
        l1, r1, l2, r2 = (at(shapes, i + k, "#") for k in (-1, 1, -2, 2))
        rows.append([_feature(x) for x in (
            "bias", f"s{s}", f"g{g}{s}", f"h{s}{h}", f"l{l1}{g}{s}", f"r{s}{h}{r1}", f"ll{l2}|{l1}|{s}", f"rr{s}|{r1}|{r2}",
            f"lr{l1}{g}{s}{h}{r1}", f"v{value[i]}{l1}{r1}", f"r4{s}|{r1}|{r2}|{at(shapes, i + 3, '#')}", f"l4{at(shapes, i - 3, '#')}|{l2}|{l1}|{s}",
        )])
    return np.array(rows, np.int64).reshape(n, 12)


class Crf:
    """emit: features by labels; step: labels by labels; begin: labels."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.emit, self.step, self.begin = emit, step, begin

    @classmethod
    def train(cls, table: list[tuple[str, list[Span]]], rounds: int = 120, rate: float = 0.15, l2: float = 0.002) -> Crf:
        """Adam on the penalised log-likelihood, all sentences at once."""
        sentences = []
        for text, spans in table:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            labels = []
            for a, b in tokens:
                own = next(((k, s) for k, s, e in spans if s <= a and b <= e), None)
                labels.append(0 if own is None else LABELS.index(("B-" if a == own[1] else "I-") + own[0]))
            if tokens:
                sentences.append((_features(text, tokens), labels))
        sentences.sort(key=lambda s: -len(s[1]))  # those that go on at step i are the first ones
        size = np.array([len(y) for _, y in sentences])
        n, longest, k = len(sentences), int(size[0]), len(LABELS)
        live = [int((size > i).sum()) for i in range(longest)]
        on = np.arange(longest) < size[:, None]
        used, x = np.unique(np.concatenate([f for f, _ in sentences]), return_inverse=True)
        x = x.reshape(-1, 12)  # of the tokens that there are, in the order of ``on``
        gold = np.zeros((n, longest, k))
        gold[on] = np.eye(k)[np.concatenate([y for _, y in sentences])]
        w = [np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)]
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        pairs = np.einsum("ntj,ntk->jk", gold[:, :-1], gold[:, 1:])
        for t in range(1, rounds + 1):
            score = np.zeros((n, longest, k))
            score[on] = w[0][x].sum(axis=1)
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = w[2] + score[:, 0]
            for i in range(1, longest):
                a = live[i]
                alpha[:a, i] = _logsum(alpha[:a, i - 1, :, None] + w[1], 1) + score[:a, i]
            for i in range(longest - 2, -1, -1):
                a = live[i + 1]
                beta[:a, i] = _logsum(w[1] + (score[:a, i + 1] + beta[:a, i + 1])[:, None, :], 2)
            z = _logsum(alpha[np.arange(n), size - 1], 1)
            p = np.zeros_like(score)
            p[on] = np.exp(alpha[on] + beta[on] - np.repeat(z, size)[:, None])
            inner = on[:, 1:]
            both = alpha[:, :-1][inner][:, :, None] + w[1] + (score + beta)[:, 1:][inner][:, None, :] - np.repeat(z, size - 1)[:, None, None]
            q = np.exp(both).sum(axis=0)
            off = np.repeat((gold - p)[on], 12, axis=0)
            g0 = np.stack([np.bincount(x.ravel(), off[:, j], len(used)) for j in range(k)], axis=1)
            grads = [g0, pairs - q, (gold[:, 0] - p[:, 0]).sum(axis=0)]
            for j, g in enumerate(grads):
                g = g / n - l2 * w[j]
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                w[j] = w[j] + rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.99**t)) + 1e-6)
        emit = np.zeros((WIDTH + 1, k), np.float32)
        emit[used] = w[0]
        return cls(emit, w[1].astype(np.float32), w[2].astype(np.float32))

    def viterbi(self, features: list[np.ndarray], inner: list[tuple[bool, bool]] | None = None) -> list[np.ndarray]:
        """Labels of each sequence; sequences of like length go side by side. inner: whether words that hold nothing go before, and after, it."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(features)
        order = sorted((i for i in range(len(features)) if len(features[i])), key=lambda i: len(features[i]))
        k, at = len(LABELS), 0
        while at < len(order):
            most = max(1, 20_000 // len(features[order[min(at + 256, len(order)) - 1]]))
            part = order[at : at + min(most, 256)]
            at += len(part)
            longest = len(features[part[-1]])
            size = np.array([len(features[i]) for i in part])
            score = np.zeros((len(part), longest, k), np.float32)
            for row, i in enumerate(part):
                score[row, : size[row]] = self.emit[features[i]].sum(axis=1)
            before, after = np.array([inner[i] if inner else (False, False) for i in part], bool).T
            score[np.arange(len(part)), size - 1] += after[:, None] * self.step[:, 0]
            best, came = np.where(before[:, None], self.step[0], self.begin) + score[:, 0], np.zeros((len(part), longest, k), np.int8)
            for t in range(1, longest):
                through = best[:, :, None] + self.step
                came[:, t] = through.argmax(axis=1)
                best = np.where((t < size)[:, None], through.max(axis=1) + score[:, t], best)
            now = best.argmax(axis=1)
            path = np.zeros((len(part), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                path[:, t] = now
                now = np.where((t < size) & (t > 0), came[np.arange(len(part)), t, now], now)
            for row, i in enumerate(part):
                out[i] = path[row, : size[row]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def widened(text: str, a: int, b: int) -> tuple[int, int]:
    """Ends moved out of words; no token goes over white space."""
    while a > 0 and not text[a - 1].isspace():
        a -= 1
    while b < len(text) and not text[b].isspace():
        b += 1
    return a, b


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Where decoding begins: what is around all that opens something."""
    near = joined([(max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)) for m in _OPENS.finditer(text)])
    return joined([widened(text, a, b) for a, b in near])


_NUMBERS = re.compile(r"[0-9]+")
_AT, _DOT = re.compile(r"@|\bat\b", re.I), re.compile(r"\.|\bdot\b", re.I)


def _holds(kind: str, s: str) -> bool:
    """The checks of an added span, of which each holds what opens a window."""
    numbers = _NUMBERS.findall(s)
    digits = "".join(numbers)
    if kind == "email":
        return bool(_AT.search(s)) and bool(_DOT.search(s)) and bool(_OPENS.search(s))
    if kind == "ip":
        return len(numbers) == 4 and all(map(_byte, numbers))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def decoded(texts: list[str], crf: Crf, ranges: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[list[tuple[int, int]], np.ndarray]]]:
    """For each text the tokens and labels of its windows (or of ``ranges``, as they are); elsewhere are no labels."""
    now = [windows(t) for t in texts] if ranges is None else ranges
    done: dict[tuple[int, int, int], tuple[list[tuple[int, int]], np.ndarray]] = {}
    dirty = [(i, a, b) for i, r in enumerate(now) for a, b in r]
    while dirty:
        jobs, feats, inner = [], [], []
        for i, a, b in dirty:
            tokens = [m.span() for m in _TOKEN.finditer(texts[i], a, b)]
            lead, tail = (0 if a == 0 else SEEN), (0 if b == len(texts[i]) else SEEN)
            every = _features(texts[i], tokens)
            stop = max(len(tokens) - tail, lead)
            jobs.append((i, a, b, tokens[lead:stop]))
            feats.append(every[lead:stop])
            inner.append((lead > 0, tail > 0))
        wider: dict[int, list[tuple[int, int]]] = {}
        for (i, a, b, tokens), labels, (before, after) in zip(jobs, crf.viterbi(feats, inner), inner, strict=True):
            done[i, a, b] = tokens, labels
            left, right = before and (not len(labels) or labels[:EDGE].any()), after and (not len(labels) or labels[-EDGE:].any())
            if ranges is None and (left or right):
                wider.setdefault(i, []).append((a - left * (b - a + AROUND), b + right * (b - a + AROUND)))
        dirty = []
        for i, more in wider.items():
            now[i] = joined([*now[i], *(widened(texts[i], max(0, a), min(len(texts[i]), b)) for a, b in more)])
            dirty += [(i, a, b) for a, b in now[i] if (i, a, b) not in done]
    return [[done[i, a, b] for a, b in r] for i, r in enumerate(now)]


def find(texts: list[str], crf: Crf | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all spans, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    if crf is None:
        return [(b, b) for b in base]
    added = [spans_of(t, b, parts) for t, b, parts in zip(texts, base, decoded(texts, crf), strict=True)]
    order = lambda s: (KINDS.index(s[0]), s[1])
    return [(b, sorted(b + x, key=order) if x else b) for b, x in zip(base, added, strict=True)]


def spans_of(text: str, base: list[Span], parts: list[tuple[list[tuple[int, int]], np.ndarray]]) -> list[Span]:
    """Spans that tokens and labels say, pass the checks and don't overlap base spans."""
    out: list[Span] = []
    for tokens, labels in parts:
        for at in np.flatnonzero(labels).tolist():
            kind = LABELS[labels[at]][2:]
            if at and labels[at - 1] and LABELS[labels[at]][0] == "I" and LABELS[labels[at - 1]][2:] == kind:
                continue  # goes on with what began before
            end = at + 1
            while end < len(labels) and LABELS[labels[end]] == f"I-{kind}":
                end += 1
            a, b = tokens[at][0], tokens[end - 1][1]
            if _holds(kind, text[a:b]) and not any(s < b and a < e for _, s, e in base):
                out.append((kind, a, b))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or run of overlapping ones, gives way to its first kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def labelled_table(seed: int = 7, times: int = 7, only: Callable[[int], bool] = lambda i: True) -> list[tuple[str, list[Span]]]:
    """Sentences with marked spans: templates filled ``times`` each, with numbers and words that a seed draws. only: which templates, by number."""
    r = random.Random(seed)
    syllables = "an be cor dal en fir ga hol in jo ka lu men nor ou pra qui ré sta ton un vel wi é ü ón".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def fill(m: re.Match) -> str:
        kind = m[1]
        if kind == "w":
            return word()
        if kind == "W":
            return word().capitalize()
        if kind == "card":
            return card()
        if kind in ("cards", "cardd", "cardp"):
            c, sep = card(), {"cards": " ", "cardd": "-", "cardp": "."}[kind]
            return sep.join(c[i : i + 4] for i in range(0, 16, 4))
        if kind == "b":
            return str(r.randint(0, 255))
        if kind == "h":
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 40))))
        if kind == "K":
            return "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16))
        return digits(int(kind))

    near = ["{} ", "{}, ", "{}. ", "{}: ", "({}) "]
    inner = [
        "<email>{w}.{2}@{w}{1}.{w}.com</email>", "<email>{w}@{w}.org</email>", "<email>{w} at {w} dot com</email>", "<email>{w}.{w} at {w} dot org</email>",
        "<email>{w} (at) {w} (dot) com</email>", "<email>{w}[at]{w}[dot]net</email>", "<email>{w} [at] {w}.com</email>", "<email>{w}(at){w}.fr</email>", "<email>{w}_{2} @ {w}.com</email>",
        "<ip>{b}.{b}.{b}.{b}</ip>", "<ip>{b}[.]{b}[.]{b}[.]{b}</ip>", "<ip>{b} . {b} . {b} . {b}</ip>", "<ip>{b}.{b}.{b}.{b}</ip>:{4}",
        "<card>{card}</card>", "<card>{cards}</card>", "<card>{cardd}</card>", "<card>{cardp}</card>", "<card>{card}</card> <card>{card}</card>", "<card>{cards}</card> <card>{card}</card>", "<card>{card}</card>, <card>{card}</card>",
        "<phone>+{1} ({3}) {3}-{4}</phone>", "<phone>({3}) {3}-{4}</phone>", "<phone>{3}-{3}-{4}</phone>", "<phone>{3}.{3}.{4}</phone>", "<phone>{3} {3} {4}</phone>", "<phone>00{2} {3} {3} {3}</phone>", "<phone>1-{3}-{3}-{4}</phone>",
        "<phone>+{2} {3} {3} {3}</phone>", "<phone>+{1} ({3}) {3}-{4}</phone> <card>{card}</card>", "<ip>{b}.{b}.{b}.{b}</ip> <card>{card}</card>", "<phone>({3}){3}-{4}</phone>",
        "token = \"{h}\"", "password={h}", "{K}", "{1}.{1}", "version {1}.{1}.{2}", "20{2}-0{1}-1{1}", "1{1}:3{1}", "{4}", "{2} {w} {3}", "{6}", "{9}{9}{7}", "{1},{3},{3}", "§ {2}.{1}.{1}",
        "{w} at {w}", "at {w} {2} {w}", "{w} at the {w} dot {w}", "https://{w}.com/{3}/{4}", "{w}{2}", "No. {5}", "{2}/{2}/{4}", "{1} {1} {1} {1}", "{3}-{2}", "{w} ({4})", "{12}{8}", "@{w}", "{w}@{w}", "{2}% {w}", "{10}",
    ]
    out = []
    for i, template in enumerate(inner):
        for k in range(times if only(i) else 0):
            left = " ".join(word() for _ in range(r.randint(0, 5)))
            right = " ".join(word() for _ in range(r.randint(0, 5)))
            body = re.sub(r"\{(\w+)\}", fill, template)
            raw = (near[k % len(near)].format(left) if left else "") + body + r.choice((" ", ". ", ", ", "\n")) + right
            text, spans, at = "", [], 0
            for m in re.finditer(r"<(email|ip|card|phone)>(.*?)</\1>", raw):
                text += raw[at : m.start()]
                spans.append((m[1], len(text), len(text) + len(m[2])))
                text += m[2]
                at = m.end()
            out.append((text + raw[at:], spans))
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def find_pii(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of each row. One pass, no shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(crf or Crf.train(labelled_table()))  # under 1 MB

    def rows(ids: list, texts: list[str]) -> dict[str, object]:
        got = find(texts, sent.value)
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in got] for k in KINDS}
        return counts | {
            "doc_id": ids, "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in got],
            "spans": [listed(every) for _, every in got], "n_added": [len(every) - len(base) for base, every in got],
        }

    run = by_block(rows, _SCHEMA)
    return docs.select(column(docs, id_col).cast("long"), column(docs, text_col)).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_pii(docs: DataFrame, crf: Crf | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with their texts redacted, and ``size_col``, where there is one, brought up to date. A null text stays null."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(crf or Crf.train(labelled_table()))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        column = pa.array(texts, pa.string(), from_pandas=True)
        for i, j in blocks_of(column):
            part = column.slice(i, j - i).to_pylist()
            out += [None if t is None else redact(t, s) for t, (_, s) in zip(part, find([t or "" for t in part], sent.value), strict=True)]
        return pd.Series(out, dtype=object)

    clean = unused(docs, "_masked")
    whole = docs.select(*columns(docs), masked(column(docs, text_col)).alias(clean))

    def now(name: str) -> Column:
        if name == text_col:
            return F.col(clean).alias(name)
        own = column(whole, name)
        return F.length(clean).cast(whole.schema[name].dataType).alias(name) if name == size_col else own

    return whole.select(*map(now, docs.columns))
