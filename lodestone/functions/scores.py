"""Detection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def precision_recall_f1(counts: DataFrame, places: int = 6) -> DataFrame:
    """counts: tp, fp, fn beside any keys. Adds precision_score, recall_score and f1; the ratios follow the sums."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({"precision_score": F.bround(p, places), "recall_score": F.bround(r, places), "f1": F.bround(ratio(2 * p * r, p + r), places)})


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over union of two spans."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2)).cast("double")
    return ratio(shared, (e1 - s1) + (e2 - s2) - shared)


def lenient(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half of the shorter span is shared, or the starts lie within ten (even of disjoint spans)."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return (shared >= 0.5 * F.least(e1 - s1, e2 - s2)) | (F.abs(s1 - s2) <= 10)
