"""URL filter: host and path rules, and a list of URLs behind a blocked Bloom filter.

Rules name a host, which stands for its subdomains too, and the beginning of a path; the longest that fits
wins (of two of one length, that with the longer host). There are few of them (``MOST_RULES``), so they are one
expression. A URL that no rule judges is blocked if its canonical form is listed. The list may be long: a
Bloom filter of its hashes, whose size follows from the list's, lets only possible hits through to
an exact hash join, which removes false positives. The filter has ``MOST_BLOCKS`` words of 64 bits at most, so that it can be sent to
all executors; a list of more than ``MOST_BLOCKS * 64 / BITS`` URLs makes more false positives, not
other results. Pages are parsed and tested once; rows that aren't possible hits are never shuffled.

Null urls and such without ``://``: host and path empty, no rule, never listed, so allowed. A null page id
stays null; repeated rows give repeated results; an empty list blocks nothing, an empty table gives no rows.
Columns besides the two that are named are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import column, materialize, ship

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MOST_RULES = 1000
#: Bits of the filter for each listed URL, bits set for each, and words of 64 bits at most (32 MB, full at 16 million URLs).
BITS, SET, MOST_BLOCKS = 16, 6, 1 << 22


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, and path without the slashes at its end; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", "")))


def _ruled(host: Column, path: Column, rules) -> tuple[Column, Column]:
    if len(rules) > MOST_RULES or len({r[:2] for r in rules}) < len(rules):
        raise ValueError("too many rules, or two for one host and path")
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


class BlockedBloom:
    """A word of 64 bits for each block; a key sets or asks ``SET`` bits of one word."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def place(hashes: Column, blocks: int) -> tuple[Column, Column]:
        """Block and bit mask of a hash, as Spark builds the filter."""
        mask = F.lit(0).cast("long")
        for i in range(SET):
            mask = mask.bitwiseOR(F.expr("shiftleft(1L, cast(shiftrightunsigned(_h, {}) & 63 as int))".format(6 * i)))
        return F.shiftrightunsigned(hashes, 40).bitwiseAND(F.lit(blocks - 1)), mask

    @classmethod
    def of(cls, listed: DataFrame, most_blocks: int = MOST_BLOCKS) -> BlockedBloom:
        """listed: _key, unique. Words are or-ed before the shuffle; at most ``most_blocks`` rows reach the driver."""
        wanted = max(1, listed.count() * BITS // 64)
        blocks = min(most_blocks, 1 << (wanted - 1).bit_length())
        block, mask = cls.place(F.col("_h"), blocks)
        built = listed.select(F.xxhash64("_key").alias("_h")).select(block.alias("b"), mask.alias("m")).groupBy("b").agg(F.bit_or("m").alias("m")).toArrow()
        words = np.zeros(blocks, np.int64)
        words[built["b"].to_numpy()] = built["m"].to_numpy()
        return cls(words.view(np.uint64))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        mask = np.zeros(len(h), np.uint64)
        for i in range(SET):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return self.words[((h >> np.uint64(40)) & np.uint64(len(self.words) - 1)).astype(np.int64)] & mask == mask


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, by of each row of ``pages``; by: what has judged it, ``rule``, ``list``, ``join`` (a possible hit
    that the join removed) or ``filter``. listed: a table whose first column holds canonical URLs."""
    spark = pages.sparkSession
    ship(spark)
    keys = materialize(listed.select(column(listed, listed.columns[0]).alias("_key")).where("_key is not null").distinct(), "listed")
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(keys, most_blocks))

    @F.pandas_udf("boolean")
    def may_hold(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.may_hold(h.to_numpy(np.int64)))

    url = column(pages, url_col)
    split = pages.select(column(pages, id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = _ruled(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "_ruled": verdict, "_key": canonical(F.col("host"), F.col("path"))})
    tested = judged.withColumn("_hit", may_hold(F.coalesce(F.xxhash64("_key"), F.lit(0))) & F.col("_key").isNotNull() & F.col("_ruled").isNull())
    tested = materialize(tested, "tested")
    hits = tested.where("_hit").join(keys.withColumn("_listed", F.lit(True)), "_key", "left")
    rest = tested.where("not _hit").withColumn("_listed", F.lit(None).cast("boolean"))
    by = F.when(F.col("_ruled").isNotNull(), "rule").when(F.col("_listed"), "list").when(F.col("_hit"), "join").otherwise("filter")
    return hits.unionByName(rest).select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", F.when(F.col("_listed"), "block").otherwise("allow")).alias("verdict"), by.alias("by")
    )
