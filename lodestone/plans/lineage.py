"""Anchors, bindings, projections, layout and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import anchors as an
from ..operators import layout
from ..sources.tables import SPANS, spans, table, values, texts
from .text import _FLAT, _TOKENS, tokens


@register("anchor_tokens")
def anchor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds depend on what failed before at a position, so there is no SQL; tests use literal cases."""
    found = an.anchors(texts(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    return found.groupBy("doc_id", "kind", an.token_class(F.col("kind")).alias("token_class"), an.shape(F.col("token")).alias("shape")).agg(F.count("*").alias("n"), F.sum("s").alias("sum_s"))


@register("anchor_ids", f"SELECT doc_id, substr(sha256(doc_id || chr(0) || s || chr(0) || e || chr(0) || token), 1, 32) AS anchor_id FROM {_TOKENS}")
def anchor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that depend on place and value only."""
    found = tokens(texts(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    return found.select("doc_id", an.anchor_id(F.col("doc_id"), F.col("s"), F.col("e"), F.col("token")).alias("anchor_id"))


_TOK = f"(SELECT doc, s AS s2, e AS e2 FROM {SPANS} WHERE type = 'view')"


@register("anchor_binding", f"""SELECT x.id, count(t.s2) AS n_tokens, CASE WHEN count(t.s2) = 0 THEN 'missing' WHEN bool_or(t.clash) THEN 'ambiguous' WHEN bool_and(x.s <= t.s2 AND t.e2 <= x.e) THEN 'exact' ELSE 'partial' END AS binding
  FROM {SPANS} x LEFT JOIN (SELECT x.id, t.s2, t.e2, coalesce(lead(t.s2) OVER (PARTITION BY x.id ORDER BY t.s2, t.e2) < t.e2, false) AS clash FROM {SPANS} x JOIN {_TOK} t ON t.doc = x.doc AND t.s2 < x.e AND x.s < t.e2) t ON t.id = x.id GROUP BY x.id""")
def anchor_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spans(spark, sf_dir)
    tok = x.where("type = 'view'").select("doc", F.col("s").alias("s2"), F.col("e").alias("e2"))
    return an.bind(x.select("doc", "id", "s", "e"), tok, ["doc"]).select("id", "n_tokens", "binding")


_KTH = "(SELECT doc_id, token, s, row_number() OVER (PARTITION BY doc_id, token ORDER BY s) AS k FROM {t} WHERE token != '')"
_READING = _FLAT.format(k="doc_id", t="reading", src=r"(SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) AS reading FROM documents)")


@register("text_match_projection", f"SELECT a.doc_id, count(*) AS n, sum(b.s)::BIGINT AS sum_s, count(*) FILTER (a.s = b.s) AS unmoved FROM {_KTH.format(t=_TOKENS)} a JOIN {_KTH.format(t=_READING)} b USING (doc_id, token, k) GROUP BY a.doc_id")
def text_match_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th occurrence of a value in the raw text is the k-th in the reading text, where runs of white space are one space."""
    kth = F.row_number().over(Window.partitionBy("doc_id", "token").orderBy("s"))
    docs = texts(spark, sf_dir, "doc_id", "text")
    raw = tokens(docs, ["doc_id"]).withColumn("k", kth)
    reading = docs.select("doc_id", F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")).alias("text"))
    reading = tokens(reading, ["doc_id"]).withColumn("k", kth).select("doc_id", "token", "k", F.col("s").alias("rs"))
    return raw.join(reading, ["doc_id", "token", "k"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("rs").alias("sum_s"), F.count_if(F.col("s") == F.col("rs")).alias("unmoved"))


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments made from line items: an order is a page."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    x, y = (F.col("l_partkey") % 7) / 10.0, (F.col("l_partkey") % 19) / 20.0
    return li.select(F.col("l_orderkey").alias("page"), F.concat(F.lit("t"), F.col("l_linenumber")).alias("text"), x.alias("x0"), y.alias("y0"), (x + 0.2).alias("x1"), (y + 0.02).alias("y1"), F.when(F.col("l_partkey") % 11 == 0, 14.0).otherwise(10.0).alias("font_size"))


_FRAG = "(SELECT l_orderkey AS page, 't' || l_linenumber AS text, (l_partkey % 7) / 10.0 AS x0, (l_partkey % 19) / 20.0 AS y0, (l_partkey % 7) / 10.0 + 0.2 AS x1, (l_partkey % 19) / 20.0 + 0.02 AS y1 FROM lineitem)"


@register("line_zones", f"SELECT page, zone, count(*) AS n FROM (SELECT page, CASE WHEN (y0 + y1) / 2 <= 0.1 THEN 'header' WHEN (y0 + y1) / 2 >= 0.9 THEN 'footer' WHEN x0 >= 0.6 THEN 'right' WHEN x1 <= 0.15 THEN 'left' ELSE 'body' END AS zone FROM {_FRAG}) GROUP BY ALL")
def line_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fragments(spark, sf_dir)
    return f.groupBy("page", layout.zone(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("zone")).agg(F.count("*").alias("n"))


@register("dominant_zone", f"SELECT page, arg_max(zone, (n, CASE zone WHEN 'body' THEN 5 WHEN 'header' THEN 4 WHEN 'footer' THEN 3 WHEN 'right' THEN 2 ELSE 1 END)) AS zone FROM (SELECT page, CASE WHEN (y0 + y1) / 2 <= 0.1 THEN 'header' WHEN (y0 + y1) / 2 >= 0.9 THEN 'footer' WHEN x0 >= 0.6 THEN 'right' WHEN x1 <= 0.15 THEN 'left' ELSE 'body' END AS zone, count(*) AS n FROM {_FRAG} GROUP BY ALL) GROUP BY page")
def dominant_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("zone") == "body", 5).when(F.col("zone") == "header", 4).when(F.col("zone") == "footer", 3).when(F.col("zone") == "right", 2).otherwise(1)
    return line_zones(spark, sf_dir).groupBy("page").agg(F.max_by("zone", F.struct("n", rank.alias("r"))).alias("zone"))


@register("page_bounds", f"SELECT page, round_even(min(x0), 6) AS x0, round_even(min(y0), 6) AS y0, round_even(least(1.0, max(x1)), 6) AS x1, round_even(least(1.0, max(y1)), 6) AS y1, median(y0) AS middle FROM {_FRAG} GROUP BY page")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.least(F.lit(1.0), F.max(c))
    return fragments(spark, sf_dir).groupBy("page").agg(F.bround(F.min("x0"), 6).alias("x0"), F.bround(F.min("y0"), 6).alias("y0"), F.bround(one("x1"), 6).alias("x1"), F.bround(one("y1"), 6).alias("y1"), F.median("y0").alias("middle"))


@register("layout_blocks")
def layout_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.blocks(fragments(spark, sf_dir), ["page"]).select("page", "band", "block_type", "text")


@register("reading_text")
def reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_text(fragments(spark, sf_dir), ["page"])


_LOCAL = "(1, 'a.pdf', 10), (2, ' b.pdf', 20), (3, 'c (1).pdf', 30), (4, 'd.pdf', 40), (5, 'zz.pdf', 50)"
_BENCH = "(101, 'a.pdf', 10), (102, 'b.pdf', 20), (103, 'c.pdf', 30), (104, 'd.pdf', 40), (105, 'd.pdf', 41), (106, 'n.txt', 1)"
_CLEAN = "trim(regexp_replace({0}, '\\s*\\([0-9]+\\)(\\.[A-Za-z]+)$', '{1}1'))"


def _steps(column: str, slash: str) -> str:
    return f"(1, {column}), (2, trim({column})), (3, {_CLEAN.format(column, slash)})"


@register("filename_match", f"""WITH l AS (SELECT id, size, step, k FROM (VALUES {_LOCAL}) t(id, name, size), LATERAL (VALUES (1, name), (2, trim(name)), (3, {_CLEAN.format('name', chr(92))})) s(step, k)), b AS (SELECT bid, bsize, step, k FROM (VALUES {_BENCH}) t(bid, name, bsize), LATERAL (VALUES (1, name), (2, trim(name)), (3, {_CLEAN.format('name', chr(92))})) s(step, k)),
  c AS (SELECT l.id, min(l.step) AS step FROM l JOIN b ON l.step = b.step AND l.k = b.k GROUP BY l.id), m AS (SELECT l.id, l.step, count(*) AS n, count(*) FILTER (l.size = b.bsize) AS same, min(CASE WHEN l.size = b.bsize THEN b.bid END) AS sized, min(b.bid) AS any_bid FROM c JOIN l ON l.id = c.id AND l.step = c.step JOIN b ON b.step = l.step AND b.k = l.k GROUP BY ALL)
  SELECT t.id, m.step, CASE WHEN m.n IS NULL THEN 'unmatched' WHEN m.n = 1 OR m.same = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN m.n = 1 THEN any_bid WHEN m.same = 1 THEN sized END AS bid FROM (VALUES {_LOCAL}) t(id, name, size) LEFT JOIN m USING (id)""")
def filename_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade of keyed joins: the name, trimmed, without copy suffix; the size settles ties, the rest is ambiguous."""
    name = F.col("name")
    steps = F.posexplode(F.array(name, F.trim(name), F.trim(F.regexp_replace(name, r"\s*\([0-9]+\)(\.[A-Za-z]+)$", "$1")))).alias("step", "k")
    local = values(spark, _LOCAL, "id, name, size").select("id", "size", steps).withColumn("step", F.col("step") + 1)
    bench = values(spark, _BENCH, "bid, name, bsize").select("bid", "bsize", steps).withColumn("step", F.col("step") + 1)
    met = local.join(bench, ["step", "k"])
    first = met.withColumn("first", F.min("step").over(Window.partitionBy("id"))).where("step = first")
    same = F.col("size") == F.col("bsize")
    m = first.groupBy("id", "step").agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.min(F.when(same, F.col("bid"))).alias("sized"), F.min("bid").alias("any_bid"))
    j = values(spark, _LOCAL, "id, name, size").join(m, "id", "left")
    one = (F.col("n") == 1) | (F.col("same") == 1)
    return j.select("id", "step", F.when(F.col("n").isNull(), "unmatched").when(one, "matched").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("any_bid")).when(F.col("same") == 1, F.col("sized")).alias("bid"))


_LINE_SETS = "(SELECT name FROM (VALUES " + _BENCH + ") b(id, name, size))"


@register("unmatched_names", f"SELECT name FROM {_LINE_SETS} WHERE name NOT LIKE '%.txt' EXCEPT SELECT name FROM (VALUES {_LOCAL}) l(id, name, size)")
def unmatched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench, local = values(spark, _BENCH, "bid, name, bsize").select("name"), values(spark, _LOCAL, "id, name, size").select("name")
    return bench.where(~F.lower("name").endswith(".txt")).subtract(local)


_OCR = "(1, 'Hallo', 0.9D, 0.1D, 0.2D, 0.5D, 0.25D), (1, '', 0.5D, 0.1D, 0.3D, 0.5D, 0.35D), (1, 'Welt', 1.4D, 0.1D, 0.4D, 0.6D, 0.45D), (2, 'x', 0.4D, 0.7D, 0.05D, 0.9D, 0.08D)"
_OCRD = _OCR.replace("D", "::DOUBLE")


@register("ocr_payload", f"SELECT page, row_number() OVER (PARTITION BY page ORDER BY y0, x0) - 1 AS line_index, text, CASE WHEN score BETWEEN 0 AND 1 THEN score END AS confidence FROM (VALUES {_OCRD}) t(page, text, score, x0, y0, x1, y1) WHERE text != ''")
def ocr_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines: empty ones fall out before lines are counted, scores outside 0 to 1 are unknown."""
    rows = values(spark, _OCR, "page, text, score, x0, y0, x1, y1").where("text != ''")
    index = F.row_number().over(Window.partitionBy("page").orderBy("y0", "x0")) - 1
    return rows.select("page", index.cast("long").alias("line_index"), "text", F.when(F.col("score").between(0, 1), F.col("score")).alias("confidence"))


@register("display_status", f"SELECT id, CASE WHEN n > 1 THEN 'ambiguous' WHEN s % 4 = 0 THEN 'missing' WHEN s % 4 = 1 THEN 'exact' ELSE 'projected' END AS mapping_status, array_to_string(list_filter([CASE WHEN n > 1 THEN 'value_repeats' END, CASE WHEN s % 4 = 0 THEN 'no_range' END], lambda x: x IS NOT NULL), ',') AS review_reasons FROM (SELECT *, count(*) OVER (PARTITION BY doc, type, s) AS n FROM {SPANS})")
def display_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that repeats is ambiguous, whatever else is known of it."""
    n = F.count("*").over(Window.partitionBy("doc", "type", "s"))
    x = spans(spark, sf_dir).withColumn("n", n)
    status = F.when(F.col("n") > 1, "ambiguous").when(F.col("s") % 4 == 0, "missing").when(F.col("s") % 4 == 1, "exact").otherwise("projected")
    reasons = F.array_compact(F.array(F.when(F.col("n") > 1, F.lit("value_repeats")), F.when(F.col("s") % 4 == 0, F.lit("no_range"))))
    return x.select("id", status.alias("mapping_status"), F.array_join(reasons, ",").alias("review_reasons"))


@register("contract_status", f"SELECT doc, CASE WHEN count(*) FILTER (score < 0.02) > 0 THEN 'invalid' WHEN count(*) FILTER (score < 0.2) > 0 THEN 'degraded' ELSE 'valid' END AS status, count(*) FILTER (score < 0.02) AS blockers, count(*) FILTER (score < 0.2) AS warnings FROM {SPANS} GROUP BY doc")
def contract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, w = F.count_if(F.col("score") < 0.02), F.count_if(F.col("score") < 0.2)
    return spans(spark, sf_dir).groupBy("doc").agg(F.when(b > 0, "invalid").when(w > 0, "degraded").otherwise("valid").alias("status"), b.alias("blockers"), w.alias("warnings"))


# Risk classes of the taxonomy, default by type.
_RISK = "('EMAIL_ADDRESS', 2), ('PHONE_NUMBER', 2), ('IP_ADDRESS', 2), ('CREDIT_CARD', 4), ('IBAN_CODE', 4), ('URL', 0), ('SVNR_AT', 5)"


@register("risk_classes", f"SELECT t, lvl AS default_class, ctx AS context_class, greatest(lvl, ctx) AS effective_class FROM (VALUES {_RISK}) r(t, lvl), (VALUES (1), (3)) c(ctx)")
def risk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = values(spark, _RISK, "t, lvl").withColumn("ctx", F.explode(F.array(F.lit(1), F.lit(3))))
    return r.select("t", F.col("lvl").alias("default_class"), F.col("ctx").alias("context_class"), F.greatest("lvl", "ctx").alias("effective_class"))
