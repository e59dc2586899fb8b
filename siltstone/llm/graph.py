"""Connected components of an edge table, for near-duplicate links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.session import materialize


def stars(links: DataFrame) -> DataFrame:
    """u, v: the least node reachable, for every node u of ``links`` (u, v: long, u != v) that isn't the least one itself.

    Alternates two steps until nothing changes: each node hands its larger neighbours to its least one,
    then each node hands its smaller neighbours to the least of them. Chains shrink by halves, so rounds
    grow with the logarithm of the longest. Both steps are a minimum for each node, summed up before the
    shuffle, and a join back; a hub's neighbours are never gathered. No step makes more links than it reads,
    so those that are repeated are sorted out at a round's end only. Each round's links are written to the
    shared folder, where a lost executor can't take them.
    """
    edges = materialize(links.select("u", "v").where("u <> v"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # all links now point to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # the least one's own row is the node's link to it
        small = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        star = large.join(low, "u").select(small.alias("u"), F.col("m").alias("v")).distinct()
        # what tells whether anything has changed is summed while the links are written
        seen = Observation()
        edges = materialize(star.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
        now = seen.get
        if now == before or not now["n"]:
            break
        before = now
    return edges


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node of ``links`` (u, v: long, u != v)."""
    edges = stars(links)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)
