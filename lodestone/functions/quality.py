"""Text-layer quality as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds, status names and reason codes of the quality verdict.
MIN_CHARS_FOR_BROKEN, SPARSE_MIN_CHARS, SPARSE_MIN_WORDS = 50, 45, 8
LOW_LETTER_RATIO, MODERATE_LETTER_RATIO, HIGH_SYMBOL_DIGIT_RATIO, LOW_WORD_RATIO = 0.15, 0.35, 0.50, 0.30
CONTROL_RATIO_BROKEN, CONTROL_MIN_CHARS, GOOD_MIN_SCORE, WORD_LETTER_RATIO = 0.10, 20, 80, 0.7
VOWELS = "aeiouyäöüàáâãèéêëìíîïòóôõùúû"
GOOD, LOW, BROKEN, EMPTY = "GOOD_TEXT_LAYER", "LOW_CONFIDENCE_TEXT_LAYER", "BROKEN_TEXT_LAYER", "EMPTY_TEXT_LAYER"


def characters(text: Column, pattern: str) -> Column:
    """How many characters of a class a text holds; taking whole runs out costs fewer matches than counting each."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))).cast("long")


def metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts and ratios that the verdict rests on; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    tokens = F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))
    cores = F.transform("_tokens", lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    # Each core is measured once, each kind decided once: lambdas share no results.
    measured = F.transform("_cores", lambda x: F.struct(x.alias("core"), F.length(x).alias("n"), F.length(F.regexp_replace(x, r"[^\p{L}]+", "")).alias("letters")))
    word = lambda m: (m["n"] >= 2) & (m["letters"] >= 2) & (m["letters"] / m["n"] >= WORD_LETTER_RATIO) & F.lower(m["core"]).rlike(f"[{VOWELS}]")
    number = lambda m: m["core"].rlike(r"^[0-9][0-9.,:/\- ]*$")
    kinds = F.transform("_measured", lambda m: F.when(word(m), 1).when(number(m), 2).otherwise(0))
    split = df.withColumn("_tokens", tokens).withColumn("_cores", cores).withColumn("_measured", measured).withColumn("_kinds", kinds)
    counted = split.withColumns(
        {
            "n_non_space": F.greatest(characters(t, r"\S"), F.lit(1)),
            "n_letters": characters(t, r"\p{L}"),
            "n_digits": characters(t, r"\p{Nd}"),
            "n_control": characters(t, r"[\p{Cc}\p{Cf}\p{Co}\x{FFFD}&&[^\s]]"),
            "n_punct": characters(t, r"[\p{P}\p{S}&&[^\x{FFFD}]]"),
            "n_tokens": F.size("_tokens").cast("long"),
            "n_words": F.size(F.filter("_kinds", lambda k: k == 1)).cast("long"),
            "n_numbers": F.size(F.filter("_kinds", lambda k: k == 2)).cast("long"),
            "n_stripped": F.length(F.regexp_replace(t, r"^\s+|\s+$", "")).cast("long"),
        }
    )
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    return counted.withColumns(
        {
            "letter_ratio": share("n_letters", "n_non_space"),
            "digit_ratio": share("n_digits", "n_non_space"),
            "punct_ratio": share("n_punct", "n_non_space"),
            "control_ratio": share("n_control", "n_non_space"),
            "word_ratio": share("n_words", "n_tokens"),
            "number_ratio": share("n_numbers", "n_tokens"),
        }
    ).drop("_tokens", "_cores", "_measured", "_kinds")


def score() -> Column:
    """0 to 100, rounded half to even, from the columns of metrics()."""
    usable = F.least(F.lit(1.0), F.col("word_ratio") + F.when(F.col("word_ratio") >= 0.1, F.col("number_ratio")).otherwise(0.0))
    quality = 0.5 * F.least(F.col("letter_ratio") / 0.5, F.lit(1.0)) + 0.5 * usable - F.least(F.col("control_ratio") * 2.0, F.lit(0.5))
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality)) * 100, 0).cast("long")


def verdict(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds quality_status, quality_score, text_source, needs_ocr and reasons (in order)."""
    c = metrics(df, text)
    long = F.col("n_non_space") >= MIN_CHARS_FOR_BROKEN
    control = (F.col("control_ratio") >= CONTROL_RATIO_BROKEN) & (F.col("n_non_space") >= CONTROL_MIN_CHARS)
    low = long & (F.col("letter_ratio") < LOW_LETTER_RATIO)
    symbols = long & (F.col("digit_ratio") + F.col("punct_ratio") > HIGH_SYMBOL_DIGIT_RATIO)
    few = long & (F.col("word_ratio") < LOW_WORD_RATIO)
    empty = F.col("n_stripped") == 0
    broken = ~empty & (control | (symbols & (low | ((F.col("letter_ratio") < MODERATE_LETTER_RATIO) & few))))
    sparse = ~empty & ~broken & ((F.col("n_stripped") < SPARSE_MIN_CHARS) | (F.col("n_tokens") < SPARSE_MIN_WORDS))
    good = ~empty & ~broken & ~sparse & (F.col("quality_score") >= GOOD_MIN_SCORE)
    mixed = ~empty & ~broken & ~sparse & ~good
    reason = lambda when, code: F.when(when, F.lit(code))
    return c.withColumn("quality_score", F.when(empty, 0).otherwise(score()).cast("long")).withColumns(
        {
            "quality_status": F.when(empty, EMPTY).when(broken, BROKEN).when(good, GOOD).otherwise(LOW),
            "text_source": F.when(empty | broken, "ocr").otherwise("text_layer"),
            "needs_ocr": empty | broken,
            "reasons": F.array_compact(F.array(reason(empty, "empty_text_layer"), reason(~empty & control, "high_control_char_ratio"), reason(~empty & low, "very_low_letter_ratio"), reason(~empty & symbols, "high_symbol_or_digit_ratio"), reason(~empty & few, "few_word_tokens"), reason(sparse, "sparse_text"), reason(mixed, "mixed_quality_signals"))),
        }
    )
