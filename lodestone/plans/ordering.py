"""Stable orders, neighbour tests, detector routing and token shape tests."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..sources.tables import SPANS, spans, table, texts


def ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds rank, the place in a stable order inside a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


@register("documents_newest", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders")
def documents_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders stand for an owner's documents: newest first, the greater id first among equals."""
    return ranked(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "rank")


def entity_order() -> list[Column]:
    return [F.col("s"), F.col("e"), F.col("type"), F.col("recognizer"), F.col("score").desc(), F.col("id")]


@register("entity_order", f"SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY s, e, type, recognizer, score DESC, id) AS rank FROM {SPANS}")
def entity_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spans(spark, sf_dir), ["doc"], entity_order()).select("doc", "id", "rank")


@register("group_order", f"SELECT doc, type, count(*) AS n, row_number() OVER (PARTITION BY doc ORDER BY min(s), type) AS rank FROM {SPANS} GROUP BY doc, type")
def group_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by their first offset."""
    groups = spans(spark, sf_dir).groupBy("doc", "type").agg(F.min("s").alias("first"), F.count("*").alias("n"))
    return ranked(groups, ["doc"], [F.col("first"), F.col("type")]).drop("first")


@register("bound_order", f"SELECT doc, id, row_number() OVER (PARTITION BY doc ORDER BY s, e, type, entity_id, id) AS rank FROM (SELECT *, sha256(concat_ws('|', doc, type, s, e)) AS entity_id FROM {SPANS})")
def bound_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spans(spark, sf_dir).withColumn("entity_id", F.sha2(F.concat_ws("|", "doc", "type", "s", "e"), 256))
    return ranked(named, ["doc"], [F.col(c) for c in ("s", "e", "type", "entity_id", "id")]).select("doc", "id", "rank")


# Sources by priority.
SOURCES = ("r0", "r1", "r2")


def anchor_order(ranges: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """ranges: keys, anchor, source, s, e. Anchors in order of their first range: by source priority, start, end, then name."""
    priority = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    first = ranges.groupBy(*keys, anchor).agg(F.min(F.struct(priority.alias("p"), "s", "e")).alias("first"))
    return ranked(first, keys, [F.col("first"), F.col(anchor)]).select(*keys, anchor, "rank")


@register("anchor_order", f"SELECT doc, type, row_number() OVER (PARTITION BY doc ORDER BY f[1], f[2], f[3], type) AS rank FROM (SELECT doc, type, min([recognizer[2:]::BIGINT, s, e]) AS f FROM {SPANS} GROUP BY doc, type)")
def anchor_order_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_order(spans(spark, sf_dir).withColumnRenamed("recognizer", "source"), ["doc"], "type")


def nearest_place(x: Column, places: list[float]) -> Column:
    """Index of the nearest place; the first of equally near ones."""
    near = [F.struct(F.abs(x - F.lit(p)).alias("gap"), F.lit(i).alias("at")) for i, p in enumerate(places)]
    return F.array_min(F.array(*near))["at"]


@register("nearest_column", f"SELECT a.id, arg_min(c.i, abs(a.s - c.x) * 10 + c.i)::INT AS place FROM {SPANS} a, (VALUES (0, 0), (1, 90), (2, 180), (3, 300)) c(i, x) GROUP BY a.id")
def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select("id", nearest_place(F.col("s"), [0, 90, 180, 300]).alias("place"))


@register("longest_run", """SELECT l_orderkey, arg_max(first, n * 1000 - first) AS first, max(n) AS n FROM (
  SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS n FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS island FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 20)) GROUP BY l_orderkey, island) GROUP BY l_orderkey""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the runs of neighbouring lines that qualify the longest, the first of equally long ones."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 20").select("l_orderkey", "l_linenumber").distinct()
    island = F.col("l_linenumber") - F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    runs = lines.withColumn("island", island).groupBy("l_orderkey", "island").agg(F.min("l_linenumber").alias("first"), F.count("*").alias("n"))
    best = runs.groupBy("l_orderkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "first")).alias("b"))
    return best.select("l_orderkey", F.col("b.first").alias("first"), (-F.col("b.n")).alias("n"))


@register("pairwise_tests", f"""SELECT doc, count(*) FILTER (s = pe) AS n_contiguous, count(*) FILTER (s > pe) AS n_gaps, coalesce(bool_and(e >= pe), true) AS rising
  FROM (SELECT doc, s, e, lag(e) OVER (PARTITION BY doc ORDER BY s, e, id) AS pe FROM {SPANS}) GROUP BY doc""")
def pairwise_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in order of start: touching ones, gaps, and whether ends never fall."""
    before = spans(spark, sf_dir).withColumn("pe", F.lag("e").over(Window.partitionBy("doc").orderBy("s", "e", "id")))
    return before.groupBy("doc").agg(F.count_if(F.col("s") == F.col("pe")).alias("n_contiguous"), F.count_if(F.col("s") > F.col("pe")).alias("n_gaps"), F.coalesce(F.bool_and(F.col("e") >= F.col("pe")), F.lit(True)).alias("rising"))


def routed(asked: DataFrame, patterns: DataFrame, model: DataFrame, handled: list[str], threshold: float) -> DataFrame:
    """Detections of both detectors as a bag: types that the model handles are taken from it alone, others from the patterns."""
    owned = F.col("type").isin(handled)
    both = patterns.where(~owned).unionByName(model.where(owned)).where(F.col("score") >= threshold)
    return both.join(F.broadcast(asked), "type", "left_semi")


@register("detector_union", f"SELECT doc, type, recognizer, count(*) AS n FROM {SPANS} WHERE score >= 0.3 AND type IN ('view', 'click', 'error') AND (CASE WHEN type IN ('click', 'error') THEN recognizer = 'r0' ELSE recognizer <> 'r0' END) GROUP BY doc, type, recognizer")
def detector_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer r0 stands for the model, which handles two of the three types asked for."""
    found = spans(spark, sf_dir)
    asked = spark.createDataFrame([("view",), ("click",), ("error",)], "type string")
    out = routed(asked, found.where("recognizer != 'r0'"), found.where("recognizer = 'r0'"), ["click", "error"], 0.3)
    return out.groupBy("doc", "type", "recognizer").agg(F.count("*").alias("n"))


def run_settings(requests: DataFrame, default: str, gate: Column) -> DataFrame:
    """requests: profile (null: no override). Adds resolved and origin; an override behind a closed gate is refused (null)."""
    over = F.col("profile").isNotNull()
    origin = F.when(~over, "server-default").when(gate, "dev-ui-override").otherwise("refused")
    return requests.withColumn("origin", origin).withColumn("resolved", F.when(~over, F.lit(default)).when(gate, F.col("profile")))


@register("run_settings", "SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR c_acctbal < 0 THEN 'server-default' WHEN c_nationkey < 12 THEN 'dev-ui-override' ELSE 'refused' END AS origin, CASE WHEN c_mktsegment IS NULL OR c_acctbal < 0 THEN 'BASE' WHEN c_nationkey < 12 THEN c_mktsegment END AS resolved FROM customer")
def run_settings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").withColumn("profile", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")))
    return run_settings(asked, "BASE", F.col("c_nationkey") < 12).select("c_custkey", "origin", "resolved")


def tokens(df: DataFrame, keep: str, text: str = "text") -> DataFrame:
    return df.select(keep, F.explode(F.split(F.col(text), r"[\x20\x09-\x0D]+")).alias("token")).where("token != ''")


def alternations(token: Column) -> Column:
    """How often letters and decimal digits follow each other; other characters are passed over."""
    plain = F.regexp_replace(token, r"[^\p{L}\p{Nd}]", "")
    return F.regexp_count(plain, F.lit(r"(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"))


def glyph_reason(token: Column) -> Column:
    """Replacement characters, box drawing, and private, unassigned or surrogate code points; rare characters alone."""
    return F.when(token.rlike(r"[\x{FFFD}\x{2500}-\x{259F}\p{Co}\p{Cn}\p{Cs}]"), "unsupported_glyph_cluster").when(token.rlike(r"^[¬¦¤`^~]$"), "isolated_glyph_like_token")


def confusion_letters(token: Column) -> Column:
    """Tokens of three or more characters with a digit whose letters are all alike to zero or to one."""
    digit = token.rlike(r"\p{Nd}") & (F.length(token) >= 3)
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    return F.when(digit & letters.rlike("^[oO]+$"), "o_zero_confusion").when(digit & letters.rlike("^[iIl]+$"), "i_l_one_confusion")


_TOKENS = r"(SELECT doc_id, unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS token FROM documents)"


@register("letter_digit_alternation", rf"SELECT doc_id, count(*) FILTER (n >= 3) AS n_mixed, max(n)::INT AS most FROM (SELECT doc_id, greatest(0, length(regexp_replace(regexp_replace(regexp_replace(token, '[^\p{{L}}\p{{Nd}}]', '', 'g'), '\p{{L}}+', 'a', 'g'), '\p{{Nd}}+', '1', 'g')) - 1) AS n FROM {_TOKENS} WHERE token <> '') GROUP BY doc_id")
def letter_digit_alternation(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens(texts(spark, sf_dir, "doc_id", "text"), "doc_id").withColumn("n", alternations(F.col("token")))
    return counted.groupBy("doc_id").agg(F.count_if(F.col("n") >= 3).alias("n_mixed"), F.max("n").cast("int").alias("most"))


#: A character that a rule is about is put behind tokens, as the tables hold none of them.
_PLANTED = "token || CASE length(token) % 5 WHEN 0 THEN chr(65533) WHEN 1 THEN chr(9608) WHEN 2 THEN chr(57345) ELSE '' END"


@register("glyph_artifacts", rf"SELECT length(token) AS n_chars, reason, count(*) AS n FROM (SELECT token, CASE WHEN regexp_matches(t, '[\x{{FFFD}}\x{{2500}}-\x{{259F}}\p{{Co}}]') THEN 'unsupported_glyph_cluster' WHEN length(t) = 1 AND instr('¬¦¤`^~', t) > 0 THEN 'isolated_glyph_like_token' END AS reason FROM (SELECT token, {_PLANTED} AS t FROM {_TOKENS} WHERE token <> '')) GROUP BY ALL")
def glyph_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("token") % 5
    tail = F.when(n == 0, "�").when(n == 1, "█").when(n == 2, "").otherwise("")
    found = tokens(texts(spark, sf_dir, "doc_id", "text"), "doc_id").select("token", glyph_reason(F.concat("token", tail)).alias("reason"))
    return found.groupBy(F.length("token").cast("long").alias("n_chars"), "reason").agg(F.count("*").alias("n"))


@register("confusion_tokens", rf"SELECT doc_id, count(*) FILTER (reason = 'o') AS n_o, count(*) FILTER (reason = 'i') AS n_i FROM (SELECT doc_id, CASE WHEN NOT regexp_matches(t, '\p{{Nd}}') OR length(t) < 3 THEN NULL WHEN l <> '' AND replace(replace(l, 'o', ''), 'O', '') = '' THEN 'o' WHEN l <> '' AND replace(replace(replace(l, 'i', ''), 'I', ''), 'l', '') = '' THEN 'i' END AS reason FROM (SELECT doc_id, t, regexp_replace(t, '[^\p{{L}}]', '', 'g') AS l FROM (SELECT doc_id, left(token, 1) || '1' || right(token, 1) AS t FROM {_TOKENS} WHERE token <> ''))) GROUP BY doc_id")
def confusion_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over each token's first and last character with a digit between."""
    shaped = tokens(texts(spark, sf_dir, "doc_id", "text"), "doc_id").withColumn("reason", confusion_letters(F.concat(F.left("token", F.lit(1)), F.lit("1"), F.right("token", F.lit(1)))))
    return shaped.groupBy("doc_id").agg(F.count_if(F.col("reason") == "o_zero_confusion").alias("n_o"), F.count_if(F.col("reason") == "i_l_one_confusion").alias("n_i"))


def cut_at_lines(text: str, size: int) -> list[tuple[int, str]]:
    """(start, stretch): whole lines, at most ``size`` characters unless one line is longer; together they are the text."""
    out, begin, at = [], 0, 0
    for line in text.splitlines(keepends=True):
        if at > begin and at - begin + len(line) > size:
            out.append((begin, text[begin:at]))
            begin = at
        at += len(line)
    return out + [(begin, text[begin:])] if at > begin else out


def stretches(df: DataFrame, key: str, text: str, size: int = 1200) -> DataFrame:
    """key, start, stretch of every text; a fold over lines, hence one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, s, t) for k, own in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s, t in cut_at_lines(own or "", size)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["key", "start", "stretch"])

    data = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return data.mapInArrow(run, f"key {data.schema['key'].dataType.simpleString()}, start int, stretch string").withColumnRenamed("key", key)


@register("line_stretches")
def line_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stretches(table(spark, sf_dir, "documents"), "doc_id", "text")
