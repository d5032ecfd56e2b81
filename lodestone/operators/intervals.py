"""Interval operators over half-open spans [start, end) inside a key (a document, a page).

Joins deal spans out by key and bin, so that a long document with many spans is spread over tasks and each pair is met
once: in the first bin that both spans touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bin in offsets.
BIN = 256


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def contains(outer_s: Column, outer_e: Column, inner_s: Column, inner_e: Column) -> Column:
    return (outer_s <= inner_s) & (inner_e <= outer_e)


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.greatest(first, F.floor((F.col(end) - 1) / width))
    return df.withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str] = ("s", "e"), right_span: tuple[str, str] = ("s2", "e2"), width: int = BIN) -> DataFrame:
    """Inner join of spans that overlap. Column names of the sides other than the keys must differ."""
    a = _binned(left, *left_span, width).withColumnRenamed("_first", "_first_l")
    b = _binned(right, *right_span, width).withColumnRenamed("_first", "_first_r")
    met = a.join(b, [*keys, "_bin"])
    once = F.col("_bin") == F.greatest("_first_l", "_first_r")
    hit = overlaps(F.col(left_span[0]), F.col(left_span[1]), F.col(right_span[0]), F.col(right_span[1]))
    return met.where(once & hit).drop("_bin", "_first_l", "_first_r")


def islands(df: DataFrame, keys: list[str], start: str = "s", end: str = "e", touching: bool = True) -> DataFrame:
    """Adds ``island``: spans of a key that overlap (or touch) directly or through others share a number."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach if touching else F.col(start) >= reach
    opens = F.when(reach.isNull() | apart, 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def union(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """The maximal covered intervals of each key; touching ones merge."""
    return islands(df, keys, start, end).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def gaps(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """The uncovered intervals between the first and the last covered offset of each key."""
    covered = union(df, keys, start, end)
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return covered.withColumn("gap_start", F.col(end)).withColumn("gap_end", following).where("gap_end is not null").select(*keys, "gap_start", "gap_end")


def not_strictly_contained(df: DataFrame, keys: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """Spans that lie inside no longer span of the same key. Needs no pairs.

    In order of start, then of falling end, a span is strictly contained exactly if an earlier different span reaches
    at least as far.
    """
    ranked = df.withColumn("_n", F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc())))
    reach = F.max(end).over(Window.partitionBy(*keys).orderBy("_n").rangeBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("_reach", reach).where("_reach is null or _reach < " + end).drop("_n", "_reach")


def segments(df: DataFrame, keys: list[str], order: list[Column], start: str = "s", end: str = "e", identity: str = "id") -> DataFrame:
    """Cuts each key at all span borders; per segment the first covering span by ``order`` and how many cover it."""
    cuts = df.select(*keys, F.explode(F.array(start, end)).alias("seg_start")).distinct()
    cuts = cuts.withColumn("seg_end", F.lead("seg_start").over(Window.partitionBy(*keys).orderBy("seg_start"))).where("seg_end is not null")
    met = overlap_pairs(cuts, df, keys, ("seg_start", "seg_end"), (start, end))
    rank = F.row_number().over(Window.partitionBy(*keys, "seg_start").orderBy(*order))
    members = F.count("*").over(Window.partitionBy(*keys, "seg_start"))
    return met.withColumn("_rank", rank).withColumn("members", members).where("_rank = 1").select(*keys, "seg_start", "seg_end", F.col(identity).alias("top_id"), "members")
