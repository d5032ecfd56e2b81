"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets the rate r that is nearest, in relative entropy, to one copy each while every source's tokens meet
its target: minimise sum(r log r - r) with sum(size * r) = target per source and 0 <= r <= CEILING. The dual is convex
with one multiplier per source; its solution is an exponential tilt r = min(CEILING, exp(m * size / mean size)). Newton
steps, kept inside a bracket, find all multipliers at once. A rate depends on source and size only, so the corpus is
first counted into (source, size) classes: the iterations and the rounding shuffle classes, never documents, and a hot
source costs no more than its distinct sizes. Rates become whole copies by cumulative rounding over the classes of a
source in order of size, then the remainder is settled by the class that comes nearest to it.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a source of its own, ranked last; an
empty table or one without words gives rows with zeros; repeated rows and null ids are further documents, drawn in the
order of a hash of id and text, so that reruns agree (rows that repeat both are interchangeable); very long texts count
like others; other columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Stash, packed, quoted

#: Copies of one document at most.
CEILING = 2
#: Relative error of a source's tokens at which its multiplier is settled, and the most Newton steps.
TOLERANCE, STEPS = 1e-7, 200
#: Folds of a class among which its extra copies are dealt.
FOLDS = 256
#: Limits of a multiplier; exp(60) is beyond any rate.
LIMIT = 60.0


def source_key(source: Column) -> Column:
    """The source, ordered by code point with null last, as a string that is never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """sizes: source, source_size. Returns them with target: share of all tokens by weight, filled up to CEILING sizes.

    Water filling in closed form: with sources in order of ceiling per weight, the level of the first source that does
    not overflow is the level of all later ones.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("source")) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    weighed = ranked.withColumn("weight", weight).withColumn("top", CEILING * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("top") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (share / CEILING * F.sum("top").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    filled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    tau = F.min(F.when(F.col("level") * F.col("weight") <= F.col("top"), F.struct("place", "level"))).over(everything)["level"]
    return filled.withColumn("tau", tau).select("source", "source_size", F.least("top", F.coalesce(F.col("tau") * F.col("weight"), F.col("top"))).alias("target"))


def _rate(m: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(CEILING)), F.exp(m * size / mean))


def full() -> Column:
    """Whether the source's target is all it can give; its multiplier would be infinite."""
    return F.col("target") >= CEILING * F.col("source_size")


def multipliers(classes: DataFrame, targets: DataFrame, stash: Stash) -> DataFrame:
    """classes: source, size, n with size > 0. Returns targets with m, the dual multiplier, and mean, the mean size."""
    means = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    now = stash.save(targets.join(means, "source").select("source", "source_size", "target", "mean", F.lit(0.0).alias("m"), F.lit(-LIMIT).alias("low"), F.lit(LIMIT).alias("high"), full().alias("done")))
    for _ in range(STEPS):
        size, scaled = F.col("size"), F.col("size") / F.col("mean")
        r = _rate(F.col("m"), size, F.col("mean"))
        tokens, slope = F.col("n") * size * r, F.when(r < CEILING, F.col("n") * size * scaled * r).otherwise(0.0)
        open_ = now.where("not done")
        moments = classes.join(open_, "source").groupBy("source").agg(F.sum(tokens).alias("g"), F.sum(slope).alias("h"))
        step = now.join(moments, "source", "left")
        gap = F.col("g") - F.col("target")
        low, high = F.when(gap < 0, F.col("m")).otherwise(F.col("low")), F.when(gap > 0, F.col("m")).otherwise(F.col("high"))
        newton = F.col("m") - F.try_divide(gap, F.col("h"))
        inside = (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target")) | (high - low < 1e-12)
        moved = step.select("source", "source_size", "target", "mean", F.when(done, F.col("m")).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("m"), F.when(done, F.col("low")).otherwise(low).alias("low"), F.when(done, F.col("high")).otherwise(high).alias("high"), done.alias("done"))
        after = stash.save(moved)
        stash.drop(now)
        now = after
        if now.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"multipliers have not settled in {STEPS} steps")
    return now.select("source", "source_size", "target", "mean", "m")


def class_copies(classes: DataFrame, targets: DataFrame, stash: Stash) -> DataFrame:
    """Returns source, size, n, rate and copies, the whole number of copies that the class's documents take together."""
    found = multipliers(classes, targets, stash)
    rated = classes.join(found, "source").select("source", "size", "n", "target", F.when(full(), float(CEILING)).otherwise(_rate(F.col("m"), F.col("size"), F.col("mean"))).alias("rate"))
    so_far = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.floor(so_far + 0.5)
    copies = whole - F.coalesce(F.lag(whole).over(Window.partitionBy("source").orderBy("size")), F.lit(0))
    now = stash.save(rated.withColumn("upto", so_far).withColumn("copies", F.greatest(F.lit(0), F.least(copies, CEILING * F.col("n")))).drop("upto"))
    while True:  # every move brings its source's words nearer to the target, by whole words
        rest = now.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
        open_ = now.join(rest, "source")
        room = F.when(F.col("rest") > 0, CEILING * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        move = F.least(room, F.greatest(F.lit(1), F.floor(F.abs("rest") / F.col("size"))))
        left = F.abs(F.abs("rest") - move * F.col("size"))
        best = open_.where((room > 0) & (left < F.abs("rest"))).groupBy("source").agg(F.min(F.struct(left.alias("left"), "size", (move * F.signum("rest")).cast("long").alias("move"))).alias("best"))
        moves = stash.save(best.select("source", "best.size", "best.move"))
        if moves.isEmpty():
            return now.select("source", "size", "n", "rate", "copies")
        after = stash.save(now.join(moves, ["source", "size"], "left").select("source", "size", "n", "target", "rate", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies")))
        stash.drop(now, moves)
        now = after


def mix(docs: DataFrame, stash: Stash, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Returns row (the columns ``keep``, by default all but the text), size, source_size, target, rate, copies (0 to CEILING)."""
    row = packed(keep or [c for c in docs.columns if c != text])
    own, text = quoted(doc_id), quoted(text)
    sized = docs.select(row, source_key(F.col(quoted(source))).alias("source"), word_count(F.col(text)).alias("size"), F.pmod(F.xxhash64(F.lit("fold"), own, text), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64(F.lit("rank"), own, text).alias("draw"))
    folds = stash.save(sized.groupBy("source", "size", "fold").agg(F.count("*").alias("n")))
    sizes = folds.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stash.save(source_targets(sizes, weights, share))
    classes = stash.save(folds.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")))
    copies = class_copies(classes, targets, stash)
    # The class's copies over its documents: all get the quotient, the first few in (fold, draw) order one more.
    parts = copies.select("source", "size", "rate", F.floor(F.col("copies") / F.col("n")).alias("each"), (F.col("copies") % F.col("n")).alias("extra"))
    spread = folds.join(parts, ["source", "size"], "left").fillna({"rate": 0.0, "each": 0, "extra": 0})
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = spread.select("source", "size", "fold", "rate", "each", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - earlier)).alias("first"))
    quota = quota.join(targets, "source")
    dealt = sized.join(quota, ["source", "size", "fold"])
    nth = F.row_number().over(Window.partitionBy("source", "size", "fold").orderBy("draw"))
    return dealt.withColumn("nth", nth).select("row", "size", "source_size", "target", "rate", (F.col("each") + (F.col("nth") <= F.col("first")).cast("long")).alias("copies"))
