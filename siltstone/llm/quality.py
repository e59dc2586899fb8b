"""Quality rules of documents and of the hosts they come from.

Each text is measured once. Rule failures are summed by host, before the shuffle, so a host with a third
of all rows is a row for each task. The hosts' failure rates are shrunk to a beta prior whose two
parameters are fitted to all hosts' rates by their moments: a host of few documents stays near the mean.

A host's verdict follows from its posterior, where two deviations from its mean still say the same. It is *rejected*
with all its documents if its rate is over a limit, which stands ``EXCESS`` of the way from the prior's mean to 1. It is
*trusted* if its rate is under the ``TRUST`` of that mean. Of the other hosts, which are *watched*, those documents go
that fail one of the further rules; a trusted host keeps them. Documents that fail the base go anyway.

Nulls and empty texts have no words, so they fail. A null host is a host of its own. A null id stays null;
repeated rows are judged each. Columns besides those that are named are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.texts import blocks_of
from siltstone.session import column, columns, materialize, ship, unused

LEAST_WORDS = 50
#: Percent of words in repeated windows.
MOST_REPEATED = 50
#: Further rules: symbols for each 100 words, percent of lines that repeat. Their failures and the base's count against a host.
MOST_SYMBOLS, MOST_DUP_LINES = 10, 30
#: Of a host's verdict (see above): share of what is above the prior's mean, share of the mean, deviations.
EXCESS, TRUST, SURE = 1 / 3, 0.5, 2.0
#: Documents that the prior counts for, at least and at most.
LIGHTEST, HEAVIEST = 1e-3, 1e3
#: Hosts that aren't watched, up to this number, are sent to all executors, more are shuffled.
BROADCAST_HOSTS = 100_000
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word)."""
    words = text.encode().split()  # on the six ASCII blanks
    lines = [s for s in text.split("\n") if s.strip(_BLANKS)]
    return len(words), len(text) - sum(map(text.count, _BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words), len(lines)


def _repeated(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    at = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(at)] |= at
    return int(covered.sum())


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def any_failed(m: tuple[int, int, int, int, int, int]) -> bool:
    n_words, _, n_symbols, n_dup_lines, n_repeat_words, n_lines = m
    return base_failed(n_words, n_repeat_words) or 100 * n_symbols > MOST_SYMBOLS * n_words or 100 * n_dup_lines > MOST_DUP_LINES * n_lines


_COLS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = pa.schema([("doc_id", pa.int64()), ("_host", pa.string()), *((c, pa.int64()) for c in _COLS), ("base_failed", pa.bool_()), ("_any", pa.bool_())])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in blocks_of(b.column(2)):
                m = [measure(t or "") for t in b.column(2).slice(i, j - i).to_pylist()]
                cols = [pa.array([x[k] for x in m], pa.int64()) for k in range(5)]
                failed = pa.array([base_failed(x[0], x[4]) for x in m], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *cols, failed, pa.array(list(map(any_failed, m)), pa.bool_())], schema=_MEASURED)

    rows = docs.select(column(docs, id_col).cast("long"), column(docs, host_col).cast("string"), column(docs, text_col))
    return rows.mapInArrow(run, f"doc_id long, _host string, {', '.join(f'{c} long' for c in _COLS)}, base_failed boolean, _any boolean")


def beta_prior(mean: float | None, variance: float | None, per_document: float | None = 0.0) -> tuple[float, float]:
    """The beta distribution of that mean and variance of rates; of equal rates a strong one, of none a flat one. per_document: the mean of
    1 / n over the hosts, whose share of the variance is chance."""
    if mean is None:
        return 1.0, 1.0
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    spread = max((variance or 0.0) - mean * (1 - mean) * (per_document or 0.0), 1e-12)
    weight = min(max(mean * (1 - mean) / spread - 1, LIGHTEST), HEAVIEST)
    return mean * weight, (1 - mean) * weight


def host_verdicts(failures: DataFrame) -> DataFrame:
    """_host, _rate, _verdict from _host, _any: the shrunk failure rate of each host and what follows."""
    hosts = failures.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("_any").cast("long")).alias("f"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("f") / F.col("n")
    a, b = beta_prior(*hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n"))).first())  # one row
    mean = a / (a + b)
    shrunk = hosts.select("_host", ((F.col("f") + a) / (F.col("n") + a + b)).alias("_rate"), (F.col("n") + a + b + 1).alias("_w"))
    off = SURE * F.sqrt(F.col("_rate") * (1 - F.col("_rate")) / F.col("_w"))
    verdict = F.when(F.col("_rate") - off > mean + EXCESS * (1 - mean), "rejected").when(F.col("_rate") + off < TRUST * mean, "trusted").otherwise("watched")
    return shrunk.select("_host", "_rate", verdict.alias("_verdict"))


def _named(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host), F.lit(""))


def _with_verdicts(rows: DataFrame, host: Column, failures: DataFrame, into: str) -> DataFrame:
    """Adds ``into``: the verdict of each row's host, null if it is watched."""
    name = unused(rows, "_name")
    marked = host_verdicts(failures).where("_verdict <> 'watched'").select(_named(F.col("_host")).alias(name), F.col("_verdict").alias(into))
    marked = materialize(marked, "verdicts")
    few = marked.count() <= BROADCAST_HOSTS
    return rows.select(*columns(rows), _named(host).alias(name)).join(F.broadcast(marked) if few else marked, name, "left").drop(name)


def _kept(base: Column, some: Column, verdict: Column) -> Column:
    return ~base & F.when(verdict == "rejected", False).when(verdict == "trusted", True).otherwise(~some)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_verdict of each row."""
    rows = materialize(measured(docs, id_col, text_col, host_col), "measured")
    judged = _with_verdicts(rows, F.col("_host"), rows, "_marked")
    return judged.select("doc_id", *_COLS, "base_failed", _kept(F.col("base_failed"), F.col("_any"), F.col("_marked")).alias("kept"), F.coalesce("_marked", F.lit("watched")).alias("host_verdict"))


def keep(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The kept rows with all columns of ``docs``. Rows are written with what their texts fail, so that texts are measured once and never shuffled."""
    ship(docs.sparkSession)

    @F.pandas_udf("int")
    def failures(texts: pd.Series) -> pd.Series:
        """2 of the base, 1 of a further rule only."""
        ms = (measure(t or "") for t in texts)
        return pd.Series([2 if base_failed(m[0], m[4]) else int(any_failed(m)) for m in ms], dtype="int32")

    failed = unused(docs, "_failed")
    rows = materialize(docs.select(*columns(docs), failures(column(docs, text_col)).alias(failed)), "measured")
    failing = F.col(failed)
    by_host = rows.select(column(rows, host_col).cast("string").alias("_host"), (failing > 0).alias("_any"))
    marked = unused(rows, "_marked")
    judged = _with_verdicts(rows, column(rows, host_col).cast("string"), by_host, marked)
    kept = judged.where(_kept(failing == 2, failing > 0, F.col(marked)))
    return kept.select(*(column(kept, c) for c in docs.columns))
