"""Layout of positioned text fragments: lines, bands, zones, blocks and reading order.

fragments: keys, text, x0, y0, x1, y1 (page shares, y grows downwards), font_size. Only the grouping of lines needs the
running mean of a group: a fold over one page's fragments, whose number does not grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tolerances and zone borders.
LINE_SHARE, LINE_LEAST, BAND_LEAST, BAND_SHARE = 0.6, 0.006, 0.025, 1.8
HEADER, FOOTER, RIGHT, LEFT, HEADING_FONT = 0.10, 0.90, 0.60, 0.15, 1.25


def zone(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """header, footer, right, left, body, or unknown for a box without size."""
    middle = (y0 + y1) / 2
    return F.when((x1 <= x0) | (y1 <= y0), "unknown").when(middle <= HEADER, "header").when(middle >= FOOTER, "footer").when(x0 >= RIGHT, "right").when(x1 <= LEFT, "left").otherwise("body")


def lines(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Adds line: fragments from top to bottom join a line while they stay near the running mean of its middles."""
    rest = [c for c in fragments.columns if c not in keys]
    one = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("_m"), F.col("x0").alias("_x"), F.col("text").alias("_t"), *rest)
    pages = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_f"), F.median(F.col("y1") - F.col("y0")).alias("_h"))
    tolerance = F.greatest(F.lit(LINE_LEAST), LINE_SHARE * F.col("_h"))

    def step(a: Column, f: Column) -> Column:
        near = (a["n"] > 0) & (F.abs(f["_m"] - a["total"] / a["n"]) <= F.col("_tol"))
        line = a["line"] + F.when(near, 0).otherwise(1)
        return F.struct((F.when(near, a["total"]).otherwise(0.0) + f["_m"]).alias("total"), (F.when(near, a["n"]).otherwise(0) + 1).alias("n"), line.alias("line"), F.concat(a["out"], F.array(line)).alias("out"))

    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(-1).alias("line"), F.array().cast("array<int>").alias("out"))
    numbered = pages.withColumn("_tol", tolerance).withColumn("_lines", F.aggregate("_f", start, step)["out"])
    flat = numbered.select(*keys, F.explode(F.arrays_zip("_f", "_lines")).alias("_z"))
    return flat.select(*keys, *[F.col(f"_z._f.{c}").alias(c) for c in rest], F.col("_z._lines").alias("line"))


def line_boxes(with_lines: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each line: box, largest font and the text from left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return with_lines.groupBy(*keys, "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def bands(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds band: a new one where the gap to the line above is larger than 1.8 median heights (0.025 at least)."""
    page = Window.partitionBy(*keys)
    order = page.orderBy("y0", "line")
    median = F.median(F.col("y1") - F.col("y0")).over(page)
    gap = F.col("y0") - F.lag("y1").over(order)
    opens = F.when(gap > F.greatest(F.lit(BAND_LEAST), BAND_SHARE * median), 1).otherwise(0)
    return boxes.withColumn("_opens", opens).withColumn("band", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def blocks(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """Bands as blocks with block_type heading, header, footer or body, in reading order."""
    banded = bands(line_boxes(lines(fragments, keys), keys), keys)
    body = banded.groupBy(*keys).agg(F.median("font_size").alias("usual"))
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    found = banded.groupBy(*keys, "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("font_size").alias("font_size"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    where = zone(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    kind = F.when(F.col("font_size") >= HEADING_FONT * F.col("usual"), "heading").when(where.isin("header", "footer"), where).otherwise("body")
    return found.join(body, keys).withColumn("block_type", kind).drop("usual")


def columns(boxes: DataFrame, keys: list[str], tolerance: float = 0.08) -> DataFrame:
    """Adds column: starts of lines that lie within the tolerance of the one before, from left to right."""
    order = Window.partitionBy(*keys).orderBy("x0", "line")
    opens = F.when(F.col("x0") - F.lag("x0").over(order) > tolerance, 1).otherwise(0)
    return boxes.withColumn("_opens", opens).withColumn("column", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def reading_text(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """One text a page: inside each band columns from left to right, in each column lines from top to bottom."""
    ordered = columns(bands(line_boxes(lines(fragments, keys), keys), keys), [*keys, "band"])
    parts = F.array_sort(F.collect_list(F.struct("band", "column", "y0", "line", "text")))
    return ordered.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("reading_text"))
