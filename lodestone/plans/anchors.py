"""Anchors, bindings, projections and the summaries over them, on spans of the events table and pages of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import intervals as iv
from ..sources.tables import SPANS, spans, table
from .spans import _BASES, page_bases


def _kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return spans(spark, sf_dir).where(F.col("type") == kind)


def to_raw(spans_: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """spans_: keys, id, s, e; anchors: keys, anchor, s2, e2 (canonical), raw_s, raw_e. Adds raw_s, raw_e, status.

    The raw envelope of all anchors that a span meets: exact if they cover the span without a gap and leave none between
    neighbours in the raw text, otherwise partial; unmapped without any.
    """
    met = iv.overlap_pairs(spans_, anchors, keys)
    canonical, raw = Window.partitionBy("id").orderBy("s2", "e2", "anchor"), Window.partitionBy("id").orderBy("raw_s", "s2", "anchor")
    reach = F.greatest(F.col("s"), F.coalesce(F.max("e2").over(canonical.rowsBetween(Window.unboundedPreceding, -1)), F.col("s")))
    tested = met.withColumn("gap", F.col("s2") > reach).withColumn("raw_gap", F.coalesce(F.col("raw_s") > F.lag("raw_e").over(raw), F.lit(False)))
    whole = ~F.bool_or("gap") & ~F.bool_or("raw_gap") & (F.max("e2") >= F.max("e"))
    found = tested.groupBy("id").agg(F.min("raw_s").alias("raw_s"), F.max("raw_e").alias("raw_e"), whole.alias("whole"))
    status = F.when(F.col("whole").isNull(), "unmapped").when(F.col("whole"), "exact").otherwise("partial")
    return spans_.join(found, "id", "left").withColumn("status", status).drop("whole")


_ANCHORS = f"(SELECT id AS anchor, doc, s AS s2, e AS e2, s + 3 * (s % 2) AS raw_s, e + 3 * (s % 2) AS raw_e FROM {SPANS} WHERE type IN ('view', 'error'))"


@register("reverse_envelope", f"""WITH m AS (SELECT t.id, t.s, t.e, a.* EXCLUDE (doc) FROM (SELECT * FROM {SPANS} WHERE type = 'click') t JOIN {_ANCHORS} a ON a.doc = t.doc AND a.s2 < t.e AND t.s < a.e2),
  w AS (SELECT *, max(e2) OVER (PARTITION BY id ORDER BY s2, e2, anchor ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, lag(raw_e) OVER (PARTITION BY id ORDER BY raw_s, s2, anchor) AS before FROM m),
  g AS (SELECT id, min(raw_s) AS raw_s, max(raw_e) AS raw_e, count(*) FILTER (s2 > greatest(s, coalesce(reach, s))) + count(*) FILTER (raw_s > before) AS gaps, max(e2) - max(e) AS rest FROM w GROUP BY id)
  SELECT t.id, t.doc, g.raw_s, g.raw_e, CASE WHEN g.id IS NULL THEN 'unmapped' WHEN gaps = 0 AND rest >= 0 THEN 'exact' ELSE 'partial' END AS status FROM {SPANS} t LEFT JOIN g USING (id) WHERE t.type = 'click'""")
def reverse_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are canonical spans, views and errors anchors whose raw place is three further on for odd starts."""
    shift = 3 * (F.col("s") % 2)
    anchors = spans(spark, sf_dir).where("type in ('view', 'error')").select("doc", F.col("id").alias("anchor"), F.col("s").alias("s2"), F.col("e").alias("e2"), (F.col("s") + shift).alias("raw_s"), (F.col("e") + shift).alias("raw_e"))
    return to_raw(_kind(spark, sf_dir, "click").select("id", "doc", "s", "e"), anchors, ["doc"]).select("id", "doc", "raw_s", "raw_e", "status")


@register("uncovered_tokens", f"SELECT id, doc, s, e FROM {SPANS} a WHERE type = 'view' AND NOT EXISTS (SELECT 1 FROM {SPANS} b WHERE b.type = 'click' AND b.doc = a.doc AND b.s <= a.s AND a.e <= b.e)")
def uncovered_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for canonical tokens, clicks for covered ranges."""
    token = _kind(spark, sf_dir, "view").select("id", "doc", "s", "e")
    cover = _kind(spark, sf_dir, "click").select("doc", F.col("s").alias("s2"), F.col("e").alias("e2"))
    inside = iv.overlap_pairs(token, cover, ["doc"]).where(iv.contains(F.col("s2"), F.col("e2"), F.col("s"), F.col("e")))
    return token.join(inside.select("id"), "id", "left_anti")


def first_mechanism(tokens: DataFrame, mechanisms: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """tokens: keys, id, s, e; a mechanism: keys, s2, e2. Adds mechanism: the first in the list with a segment that meets the token, and segment_s, that segment's start."""
    met = [iv.overlap_pairs(tokens, segments, keys).select("id", F.lit(i).alias("i"), F.lit(name).alias("mechanism"), F.col("s2").alias("segment_s")) for i, (name, segments) in enumerate(mechanisms)]
    every = met[0]
    for m in met[1:]:
        every = every.unionByName(m)
    best = every.groupBy("id").agg(F.min(F.struct("i", "segment_s", "mechanism")).alias("b"))
    return tokens.join(best.select("id", "b.mechanism", "b.segment_s"), "id", "left")


@register("projection_precedence", f"""WITH m AS (SELECT t.id, x.i, x.name, x.s FROM {SPANS} t JOIN (SELECT *, CASE type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'signup' THEN 2 END AS i, CASE type WHEN 'click' THEN 'row_lineage' WHEN 'error' THEN 'geometry' WHEN 'signup' THEN 'map' END AS name FROM {SPANS} WHERE type IN ('click', 'error', 'signup')) x ON x.doc = t.doc AND x.s < t.e AND t.s < x.e WHERE t.type = 'view')
  SELECT t.id, b.name AS mechanism, b.s AS segment_s FROM {SPANS} t LEFT JOIN (SELECT id, arg_min(name, i * 100000 + s) AS name, arg_min(s, i * 100000 + s) AS s FROM m GROUP BY id) b USING (id) WHERE t.type = 'view'""")
def projection_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = [(name, _kind(spark, sf_dir, kind).select("doc", F.col("s").alias("s2"), F.col("e").alias("e2"))) for name, kind in (("row_lineage", "click"), ("geometry", "error"), ("map", "signup"))]
    return first_mechanism(_kind(spark, sf_dir, "view").select("id", "doc", "s", "e"), segments, ["doc"]).select("id", "mechanism", "segment_s")


@register("span_lines", f"SELECT t.id, count(*) AS n_lines, min(p.turn) AS first_line, max(p.turn) AS last_line FROM {SPANS} t JOIN {_BASES} p ON p.conv_id = t.doc AND p.base < t.e AND t.s < p.base + p.n GROUP BY t.id")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines (turns of a conversation) that a span meets."""
    lines = page_bases(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("doc"), "turn", F.col("base").alias("s2"), (F.col("base") + F.col("n")).alias("e2"))
    met = iv.overlap_pairs(spans(spark, sf_dir).select("id", "doc", "s", "e"), lines, ["doc"])
    return met.groupBy("id").agg(F.count("*").alias("n_lines"), F.min("turn").alias("first_line"), F.max("turn").alias("last_line"))


@register("label_value_pairs", f"SELECT l.doc, l.box, l.id AS label_id, v.id AS value_id FROM (SELECT doc, s // 40 AS box, max(id) AS id FROM {SPANS} WHERE type = 'click' GROUP BY ALL) l JOIN (SELECT doc, s // 40 AS box, max(id) AS id FROM {SPANS} WHERE type = 'view' GROUP BY ALL) v ON v.doc = l.doc AND v.box = l.box")
def label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (clicks) and values (views) of one container (40 offsets); the last of several counts."""
    def last(kind: str, name: str) -> DataFrame:
        return _kind(spark, sf_dir, kind).groupBy("doc", F.floor(F.col("s") / 40).alias("box")).agg(F.max("id").alias(name))

    return last("click", "label_id").join(last("view", "value_id"), ["doc", "box"])


@register("feedback_entity", f"SELECT f.id, min(x.id) AS entity_id FROM {SPANS} f LEFT JOIN {SPANS} x ON x.type = f.type AND x.s = f.s AND x.e = f.e AND x.recognizer = f.recognizer AND x.doc <> f.doc GROUP BY f.id")
def feedback_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entity of another document that agrees in type, place and recognizer; two least ids a key decide it."""
    key = ["type", "s", "e", "recognizer"]
    found = spans(spark, sf_dir)
    least = found.groupBy(*key, "doc").agg(F.min("id").alias("least"))
    order = Window.partitionBy(*key).orderBy("least")
    two = least.withColumn("n", F.row_number().over(order)).where("n <= 2").select(*key, F.col("doc").alias("other"), "least")
    met = found.join(two, key).where("doc != other").groupBy("id").agg(F.min("least").alias("entity_id"))
    return found.select("id").join(met, "id", "left")


@register("page_zip", """SELECT conv_id, coalesce(a.n, b.n) AS page, CASE WHEN a.n IS NULL THEN 'no_audit' WHEN b.n IS NULL THEN 'no_page' ELSE 'ok' END AS status FROM
  (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') a
  FULL JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'user') b USING (conv_id, n)""".replace("coalesce(a.n, b.n)", "n"))
def page_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of two sides by number; what only one side has is an error."""
    turns = table(spark, sf_dir, "conversations")
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    a = turns.where("role = 'user'").select("conv_id", number.alias("page"), F.lit(True).alias("a"))
    b = turns.where("role != 'user'").select("conv_id", number.alias("page"), F.lit(True).alias("b"))
    status = F.when(F.col("a").isNull(), "no_audit").when(F.col("b").isNull(), "no_page").otherwise("ok")
    return a.join(b, ["conv_id", "page"], "full").select("conv_id", "page", status.alias("status"))


def merged_observations(observed: DataFrame, keys: list[str]) -> DataFrame:
    """observed: keys, id, score, recognizer, reason. One entity a key: best score, recognizers, review if any asks, the first reason by id."""
    return observed.groupBy(*keys).agg(
        F.min("id").alias("id"),
        F.max("score").alias("score"),
        F.array_join(F.sort_array(F.collect_set("recognizer")), ",").alias("recognizers"),
        F.bool_or(F.col("reason").isNotNull()).alias("review_required"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("id"))).alias("reason"),
        F.count("*").alias("n"),
    )


_REASONED = f"(SELECT *, CASE WHEN score < .1 THEN 'low_score' WHEN e - s > 38 THEN 'long_span' END AS reason FROM {SPANS})"


@register("observation_merge", f"SELECT doc, type, s, e, min(id) AS id, max(score) AS score, array_to_string(list_sort(list_distinct(list(recognizer))), ',') AS recognizers, count(reason) > 0 AS review_required, arg_min(reason, id) FILTER (reason IS NOT NULL) AS reason, count(*) AS n FROM {_REASONED} GROUP BY doc, type, s, e")
def observation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("score") < 0.1, "low_score").when(F.col("e") - F.col("s") > 38, "long_span")
    return merged_observations(spans(spark, sf_dir).withColumn("reason", reason), ["doc", "type", "s", "e"])


@register("observation_entities", f"SELECT x.id AS observation_id, m.id AS entity_id FROM {SPANS} x JOIN (SELECT doc, type, s, e, min(id) AS id FROM {SPANS} GROUP BY ALL) m USING (doc, type, s, e)")
def observation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's source observations, a row each."""
    merged = spans(spark, sf_dir).groupBy("doc", "type", "s", "e").agg(F.min("id").alias("entity_id"), F.sort_array(F.collect_set("id")).alias("observations"))
    return merged.select(F.explode("observations").alias("observation_id"), "entity_id")


def ratio(numerator, denominator, places: int = 6):
    """Zero over nothing."""
    return F.when(denominator == 0, 0.0).otherwise(F.bround(numerator / denominator, places))


_BOUND = f"""(SELECT t.id, t.doc, CASE WHEN bool_or(a.s = t.s AND a.e = t.e) THEN 'exact' WHEN count(a.s) > 3 THEN 'ambiguous' WHEN count(a.s) > 0 THEN 'partial' ELSE 'missing' END AS status
  FROM {SPANS} t LEFT JOIN (SELECT doc, s, e FROM {SPANS} WHERE type = 'view') a ON a.doc = t.doc AND a.s < t.e AND t.s < a.e WHERE t.type = 'click' GROUP BY t.id, t.doc)"""


def bindings(entities: DataFrame, anchors: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """entities: id, keys, s, e; anchors: keys, s2, e2. Adds status: exact, ambiguous (more than ``most`` anchors), partial or missing."""
    met = iv.overlap_pairs(entities, anchors, keys).groupBy("id").agg(F.bool_or((F.col("s") == F.col("s2")) & (F.col("e") == F.col("e2"))).alias("same"), F.count("*").alias("n"))
    status = F.when(F.col("same"), "exact").when(F.col("n") > most, "ambiguous").when(F.col("n") > 0, "partial").otherwise("missing")
    return entities.join(met, "id", "left").withColumn("status", status).drop("same", "n")


@register("binding_summary", f"""SELECT doc, count(*) AS total, count(*) FILTER (status = 'exact') AS n_exact, count(*) FILTER (status = 'partial') AS n_partial, count(*) FILTER (status = 'ambiguous') AS n_ambiguous, count(*) FILTER (status = 'missing') AS n_missing,
  round_even(count(*) FILTER (status IN ('exact', 'partial')) / count(*), 6) AS bound_ratio, round_even(count(*) FILTER (status = 'exact') / count(*), 6) AS exact_ratio, array_to_string(list_sort(list_distinct(list(status) FILTER (status <> 'exact'))), ',') AS warnings FROM {_BOUND} GROUP BY doc""")
def binding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = _kind(spark, sf_dir, "view").select("doc", F.col("s").alias("s2"), F.col("e").alias("e2"))
    bound = bindings(_kind(spark, sf_dir, "click").select("id", "doc", "s", "e"), anchors, ["doc"])
    n = {k: F.count_if(F.col("status") == k) for k in ("exact", "partial", "ambiguous", "missing")}
    warnings = F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "exact", F.col("status")))), ",")
    return bound.groupBy("doc").agg(F.count("*").alias("total"), *[c.alias(f"n_{k}") for k, c in n.items()], ratio(n["exact"] + n["partial"], F.count("*")).alias("bound_ratio"), ratio(n["exact"], F.count("*")).alias("exact_ratio"), warnings.alias("warnings"))


def geometry_coverage(pages: DataFrame, key: str) -> DataFrame:
    """pages: key, status, source. The share of pages that are not unsupported, and the flags of the document."""
    covered = F.count_if(F.col("status") != "unsupported") / F.count("*")
    layer, ocr = F.bool_or(F.col("source") == "pdf_text_layer"), F.bool_or(F.col("source") == "ocr")
    flags = F.concat_ws(",", F.when(layer, "text_layer_geometry"), F.when(ocr, "ocr_geometry"), F.when(layer & ocr, "mixed_geometry"), F.when((covered < 1) | F.bool_or(F.col("status") != "complete"), "partial_geometry"))
    return pages.groupBy(key).agg(F.bround(covered, 6).alias("coverage"), flags.alias("flags"))


_PAGES = "(SELECT conv_id, CASE WHEN length(text) < 40 THEN 'unsupported' WHEN length(text) < 120 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN role = 'user' THEN 'pdf_text_layer' ELSE 'ocr' END AS source FROM conversations)"
_COVERAGE = f"""(SELECT conv_id, round_even(count(*) FILTER (status <> 'unsupported') / count(*), 6) AS coverage,
  concat_ws(',', CASE WHEN bool_or(source = 'pdf_text_layer') THEN 'text_layer_geometry' END, CASE WHEN bool_or(source = 'ocr') THEN 'ocr_geometry' END, CASE WHEN count(DISTINCT source) = 2 THEN 'mixed_geometry' END, CASE WHEN bool_or(status <> 'complete') THEN 'partial_geometry' END) AS flags FROM {_PAGES} GROUP BY conv_id)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", F.when(n < 40, "unsupported").when(n < 120, "partial").otherwise("complete").alias("status"), F.when(F.col("role") == "user", "pdf_text_layer").otherwise("ocr").alias("source"))


@register("geometry_coverage", f"SELECT * FROM {_COVERAGE}")
def geometry_coverage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry_coverage(_pages(spark, sf_dir), "conv_id")


def overall_score(heuristic, mapping, geometry):
    """The mean of 1 (or 0.3 where the reading is no heuristic one), the mapping ratio and, where known, the geometry ratio."""
    known = F.array_compact(F.array(F.when(heuristic, 1.0).otherwise(0.3), mapping, geometry))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)), 4)


@register("overall_score", f"""SELECT conv_id, round_even(CASE WHEN g IS NULL THEN (h + m) / 2 ELSE (h + m + g) / 3 END, 4) AS score FROM (SELECT c.conv_id, CASE WHEN count(*) >= 4 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS h, sum(length(text)) FILTER (role = 'user') / sum(length(text)) AS m, any_value(CASE WHEN coverage > .5 THEN coverage END) AS g FROM conversations c JOIN {_COVERAGE} v ON v.conv_id = c.conv_id GROUP BY c.conv_id HAVING sum(length(text)) > 0 AND count(*) FILTER (role = 'user') > 0)""")
def overall_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's share of the text stands for the mapping ratio; a coverage of a half or less counts as unknown."""
    user = F.sum(F.when(F.col("role") == "user", F.length("text")))
    parts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), user.alias("user"), F.sum(F.length("text")).alias("all")).where("all > 0 and user is not null")
    joined = parts.join(geometry_coverage(_pages(spark, sf_dir), "conv_id"), "conv_id")
    return joined.select("conv_id", overall_score(F.col("n") >= 4, F.col("user") / F.col("all"), F.when(F.col("coverage") > 0.5, F.col("coverage"))).alias("score"))


@register("valid_highlights", f"SELECT t.id, t.s >= 0 AND t.s < t.e AND t.e <= length(d.text) AS valid FROM {SPANS} t JOIN documents d ON d.doc_id = t.doc")
def valid_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A highlight lies inside its text, counted in code points."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("n"))
    return spans(spark, sf_dir).join(texts, "doc").select("id", ((F.col("s") >= 0) & (F.col("s") < F.col("e")) & (F.col("e") <= F.col("n"))).alias("valid"))


@register("projection_coverage", f"SELECT d.doc_id, round_even(coalesce(sum(greatest(0, least(u.e, n) - least(u.s, n))), 0) / n, 6) AS coverage FROM (SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 0) d LEFT JOIN (SELECT doc, min(s) AS s, max(e) AS e FROM (SELECT *, sum(o) OVER (PARTITION BY doc ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM {SPANS})) GROUP BY doc, g) u ON u.doc = d.doc_id GROUP BY d.doc_id, n")
def projection_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a text that spans cover, each place once."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0")
    covered = iv.union(spans(spark, sf_dir), ["doc"]).withColumnRenamed("doc", "doc_id")
    inside = F.greatest(F.lit(0), F.least("e", "n") - F.least("s", "n"))
    return texts.join(covered, "doc_id", "left").groupBy("doc_id", "n").agg(F.bround(F.coalesce(F.sum(inside), F.lit(0)) / F.col("n"), 6).alias("coverage")).drop("n")


# An image counts if both sides have so many pixels, and it as many in all.
LEAST_SIDE, LEAST_PIXELS = 200, 100_000


@register("significant_images", "SELECT p_brand, count(*) FILTER (least(w, h) >= 200 AND w * h >= 100000) AS n_significant, count(*) AS n FROM (SELECT p_brand, p_size * 20 AS w, (p_partkey * 37) % 900 AS h FROM part) GROUP BY p_brand")
def significant_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for images, brands for pages."""
    image = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 20).alias("w"), ((F.col("p_partkey") * 37) % 900).alias("h"))
    large = (F.least("w", "h") >= LEAST_SIDE) & (F.col("w") * F.col("h") >= LEAST_PIXELS)
    return image.groupBy("p_brand").agg(F.count_if(large).alias("n_significant"), F.count("*").alias("n"))


def placed_box(x, y, size, chars, width, height, matrix):
    """x0, y0, x1, y1 of a text fragment as shares of the page: affine transform, estimated width, clamped."""
    def clamp(v):
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    px, py = x * matrix[0] + y * matrix[2] + matrix[4], x * matrix[1] + y * matrix[3] + matrix[5]
    estimated = F.least(width - px, F.greatest(size * 0.5, chars * size * 0.52))
    return [clamp(px / width), clamp((height - py - size) / height), clamp((px + estimated) / width), clamp((height - py + size * 0.2) / height)]


@register("fragment_boxes", """SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, px / 600)), 6) AS x0, round(least(1, greatest(0, (800 - py - 12) / 800)), 6) AS y0, round(least(1, greatest(0, (px + least(600 - px, greatest(6, l_linenumber * 12 * .52))) / 600)), 6) AS x1, round(least(1, greatest(0, (800 - py + 2.4) / 800)), 6) AS y1
  FROM (SELECT l_orderkey, l_linenumber, x * 1.1 + y * .2 + 5 AS px, x * .1 + y * .9 - 3 AS py FROM (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE * 11 AS x, l_linenumber::DOUBLE * 97 AS y FROM lineitem))""")
def fragment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    x, y = F.col("l_quantity").cast("double") * 11, F.col("l_linenumber").cast("double") * 97
    box = placed_box(x, y, F.lit(12.0), F.col("l_linenumber"), F.lit(600.0), F.lit(800.0), [1.1, 0.1, 0.2, 0.9, 5.0, -3.0])
    return lines.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])


@register("highlighted_documents", "SELECT v.stem, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, coalesce(source, '') || '-' || doc_id || '.pdf' AS name FROM documents) d JOIN (VALUES ('src1'), ('src12-'), ('src7-1'), ('none')) v(stem) ON starts_with(regexp_replace(d.name, '\\.[^.]*$', ''), v.stem) GROUP BY v.stem".replace("\\\\", "\\"))
def highlighted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose file name without its ending begins with one of a few names."""
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    stems = F.broadcast(spark.createDataFrame([("src1",), ("src12-",), ("src7-1",), ("none",)], "stem string"))
    named = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(name, r"\.[^.]*$", "").alias("own"))
    return named.join(stems, F.col("own").startswith(F.col("stem"))).groupBy("stem").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
