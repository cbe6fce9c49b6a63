"""Connected components of a large graph by alternating large-star and small-star steps.

Each step is one aggregation and one join, written to the shared folder; a few steps suffice even for long chains, and they go on
until nothing moves.
Self-links and repeated links do no harm; null ends are ignored; without links there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._common import discard, stage


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> node, label: the smallest node of its component, for every node that has a link."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        most = stage(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "large")
        edges_large = stage(both.where("v > u").join(most, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stage(edges_large.groupBy("u").agg(F.min("v").alias("m")), "small")
        new = edges_large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = stage(new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        after = state(new)
        discard(most, edges_large, least, edges)
        edges = new
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
