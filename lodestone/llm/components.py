"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """``edges``: a, b long. Returns node, component (its least node) for every node that an edge other than a loop holds.

    Each step is two keyed aggregations and joins, without a group in one task; the edge list is written to the
    shared folder after each round. Null ends and loops are dropped, repeated edges count once.
    """
    now = stash.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct())
    known = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == known or not mark[0]:
            break
        known = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        after = stash.save(small)
        stash.drop(now)
        now = after
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
