"""Text anchors: tokens with kind, class and shape, and the binding of spans to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import intervals as iv

# The kinds in order of precedence at one position.
KINDS = [
    ("email", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("phone", r"\+?[0-9][0-9 ()/.\-]{5,}[0-9]"),
    ("identifier", r"[\p{L}\p{N}]+(?:[-/_.][\p{L}\p{N}]+)+"),
    ("identifier", r"(?=[\p{L}\p{N}]*[0-9])(?=[\p{L}\p{N}]*\p{L})[\p{L}\p{N}]{5,}"),
    ("number", r"[0-9]+(?:[.,][0-9]+)*"),
    ("word", r"[\p{L}\p{M}]+"),
    ("symbol", r"\S"),
]


#: Tokens that a task hands on at a time, and bytes of texts that it takes in at a time.
TOKENS, BYTES = 1 << 15, 1 << 23


def tokenize(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end): at each position the first kind that matches; a phone needs seven digits and a separator, an
    identifier with separators a digit, else the next kind is tried."""
    compiled = [(kind, _compiled(p)) for kind, p in KINDS]
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        for i, (kind, pattern) in enumerate(compiled):
            m = pattern.match(text, at)
            if not m:
                continue
            value = m.group()
            if kind == "phone" and (sum(c.isdigit() for c in value) < 7 or not any(c in " ()/.-+" for c in value)):
                continue
            if i == 2 and not any(c.isdigit() for c in value):
                continue
            yield kind, at, m.end()
            at = m.end()
            break


_PATTERNS: dict[str, regex.Pattern] = {}


def _compiled(pattern: str) -> regex.Pattern:
    if pattern not in _PATTERNS:
        _PATTERNS[pattern] = regex.compile(pattern)
    return _PATTERNS[pattern]


def pieces(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of keys and text -> their tokens, TOKENS at a time, however many and long the texts of a batch are."""
    types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []

            def send() -> pa.RecordBatch:
                found = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)]
                own = pa.array(owner, pa.int32())
                owner.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in range(len(keys))), *found], names=[*keys, "ordinal", "kind", "s", "e", "token"])

            for i, value in enumerate(batch.column(len(keys))):
                text = value.as_py() or ""
                for n, (kind, s, e) in enumerate(tokenize(text)):
                    owner.append(i)
                    rows.append((n, kind, s, e, text[s:e]))
                    if len(rows) == TOKENS:
                        yield send()
            yield send()

    return run


def anchors(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row for each token: keys, ordinal, kind, s, e, token. Row-wise, without a shuffle."""
    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keys), "ordinal int, kind string, s int, e int, token string"])
    most = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(most, str(BYTES + 1)).rstrip("bB")) > BYTES:
        df.sparkSession.conf.set(most, str(BYTES))
    return df.select(*keys, text).mapInArrow(pieces(keys), schema)


def token_class(kind: Column) -> Column:
    return F.when(kind.isin("email", "phone", "identifier"), "structured").when(kind == "number", "numeric").when(kind == "word", "lexical").otherwise("symbol")


def shape(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{L}+$"), "alpha").when(token.rlike(r"^[0-9]+$"), "digit").when(token.rlike(r"^[^\p{L}\p{N}]+$"), "symbol").otherwise("mixed")


def anchor_id(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, joined by NUL."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), p.cast("string"))
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 32)


def bind(spans: DataFrame, tokens: DataFrame, keys: list[str], identity: str = "id") -> DataFrame:
    """Spans (s, e) against tokens (s2, e2): exact if all tokens met lie inside and they do not overlap each other,
    partial if one sticks out, ambiguous if they overlap, missing without any. Adds n_tokens and binding."""
    met = iv.overlap_pairs(spans.select(*keys, identity, "s", "e"), tokens.select(*keys, "s2", "e2"), keys)
    order = Window.partitionBy(*keys, identity).orderBy("s2", "e2")
    clash = F.lead("s2").over(order) < F.col("e2")
    found = met.withColumn("clash", F.coalesce(clash, F.lit(False))).groupBy(*keys, identity).agg(F.count("*").alias("n_tokens"), F.bool_or("clash").alias("clash"), F.bool_and(F.expr("s <= s2 and e2 <= e")).alias("inside"))
    joined = spans.join(found, [*keys, identity], "left")
    status = F.when(F.col("n_tokens").isNull(), "missing").when(F.col("clash"), "ambiguous").when(F.col("inside"), "exact").otherwise("partial")
    return joined.withColumn("binding", status).withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))).drop("clash", "inside")
