"""Interval queries: overlaps, containment, coverage, projection, matching and highlights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import scores
from ..operators import intervals as iv
from ..sources.tables import SPANS, spans, table, values

# Which type takes precedence over which inside it.
PRECEDENCE = "('EMAIL_ADDRESS', 'URL'), ('BIRTH_DATE', 'DATE_TIME'), ('purchase', 'view'), ('click', 'error')"
_P = f"(SELECT * FROM (VALUES {PRECEDENCE}) p(outer_type, inner_type))"
_EXACT = f"(SELECT doc, type, s, e, arg_min(id, (-score, recognizer, id)) AS id, max(score) AS score, list_sort(list_distinct(list(recognizer))) AS recognizers, count(*) AS n FROM {SPANS} GROUP BY doc, type, s, e)"


def exact_merge(df: DataFrame) -> DataFrame:
    """One span of those that are equal in place and type: best score, then recognizer, then id; partial and final."""
    order = F.struct((-F.col("score")).alias("a"), "recognizer", "id")
    return df.groupBy("doc", "type", "s", "e").agg(F.min_by("id", order).alias("id"), F.max("score").alias("score"), F.sort_array(F.collect_set("recognizer")).alias("recognizers"), F.count("*").alias("n"))


@register("exact_duplicate_merge", f"SELECT doc, type, s, e, id, score, array_to_string(recognizers, ',') AS recognizers, n FROM {_EXACT}")
def exact_duplicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_merge(spans(spark, sf_dir)).withColumn("recognizers", F.array_join("recognizers", ","))


_KEPT = f"(SELECT a.* FROM {_EXACT} a WHERE NOT EXISTS (SELECT 1 FROM {_EXACT} b WHERE b.doc = a.doc AND b.type = a.type AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s))"


def same_type_kept(df: DataFrame) -> DataFrame:
    return iv.not_strictly_contained(exact_merge(df), ["doc", "type"])


@register("same_type_containment", f"SELECT doc, type, s, e, id FROM {_KEPT}")
def same_type_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_type_kept(spans(spark, sf_dir)).select("doc", "type", "s", "e", "id")


_PRECEDED = f"(SELECT a.* FROM {_KEPT} a WHERE NOT EXISTS (SELECT 1 FROM {_KEPT} b JOIN {_P} p ON p.outer_type = b.type AND p.inner_type = a.type WHERE b.doc = a.doc AND b.s <= a.s AND b.e >= a.e))"


def preceded(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Drops spans inside one of a type that takes precedence (equal places included)."""
    outer = df.join(F.broadcast(values(spark, PRECEDENCE, "outer_type, inner_type")), F.col("type") == F.col("outer_type")).select("doc", F.col("inner_type").alias("type"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    inside = iv.overlap_pairs(df, outer, ["doc", "type"]).where(iv.contains(F.col("s2"), F.col("e2"), F.col("s"), F.col("e"))).select("id")
    return df.join(inside, "id", "left_anti")


@register("cross_type_precedence", f"SELECT doc, type, s, e, id FROM {_PRECEDED}")
def cross_type_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preceded(spark, same_type_kept(spans(spark, sf_dir))).select("doc", "type", "s", "e", "id")


_FLAGGED = f"SELECT a.doc, a.type, a.s, a.e, a.id, EXISTS (SELECT 1 FROM {_PRECEDED} b WHERE b.doc = a.doc AND b.type != a.type AND b.s < a.e AND a.s < b.e) AS review_required FROM {_PRECEDED} a"


@register("overlap_resolution", _FLAGGED)
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact merge, containment, precedence; what still overlaps another type needs review."""
    kept = preceded(spark, same_type_kept(spans(spark, sf_dir)))
    other = kept.select("doc", F.col("type").alias("type2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    flagged = iv.overlap_pairs(kept.select("doc", "type", "s", "e", "id"), other, ["doc"]).where("type != type2").select("id").distinct().withColumn("hit", F.lit(True))
    return kept.join(flagged, "id", "left").select("doc", "type", "s", "e", "id", F.coalesce("hit", F.lit(False)).alias("review_required"))


@register("overlap_summary", f"SELECT (SELECT count(*) FROM {SPANS}) AS n_input, (SELECT count(*) FROM {SPANS}) - (SELECT count(*) FROM {_EXACT}) AS n_merged, (SELECT count(*) FROM {_EXACT}) - (SELECT count(*) FROM {_PRECEDED}) AS n_dropped, count(*) AS n_output, count(*) FILTER (review_required) AS n_review FROM ({_FLAGGED})")
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_in = spans(spark, sf_dir).agg(F.count("*").alias("n_input"))
    merged = exact_merge(spans(spark, sf_dir)).agg(F.count("*").alias("m"))
    out = overlap_resolution(spark, sf_dir).agg(F.count("*").alias("n_output"), F.count_if("review_required").alias("n_review"))
    return n_in.join(merged, F.lit(True)).join(out, F.lit(True)).select("n_input", (F.col("n_input") - F.col("m")).alias("n_merged"), (F.col("m") - F.col("n_output")).alias("n_dropped"), "n_output", "n_review")


_ISLANDS = "SELECT *, sum(opens) OVER (PARTITION BY {k} ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY {k} ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {op} s THEN 0 ELSE 1 END AS opens FROM {src})"


@register("overlap_clusters", f"SELECT doc, min(s) AS s, max(e) AS e, count(*) AS n, count(DISTINCT type) AS n_types FROM ({_ISLANDS.format(k='doc', op='>', src=SPANS)}) GROUP BY doc, island")
def overlap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iv.islands(spans(spark, sf_dir), ["doc"], touching=False)
    return found.groupBy("doc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), F.countDistinct("type").alias("n_types")).drop("island")


_UNION = f"(SELECT doc, type, min(s) AS s, max(e) AS e FROM ({_ISLANDS.format(k='doc, type', op='>=', src=SPANS)}) GROUP BY doc, type, island)"


@register("interval_union_coverage", f"SELECT doc, type, sum(e - s)::BIGINT AS covered, count(*) AS n_intervals, round_even(least(1.0, sum(e - s) / 440.0), 6) AS coverage FROM {_UNION} GROUP BY doc, type")
def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = F.sum(F.col("e") - F.col("s"))
    return iv.union(spans(spark, sf_dir), ["doc", "type"]).groupBy("doc", "type").agg(covered.alias("covered"), F.count("*").alias("n_intervals"), F.bround(F.least(F.lit(1.0), covered / 440.0), 6).alias("coverage"))


@register("gap_detection", f"SELECT doc, type, e AS gap_start, nxt AS gap_end FROM (SELECT *, lead(s) OVER (PARTITION BY doc, type ORDER BY s) AS nxt FROM {_UNION}) WHERE nxt IS NOT NULL")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gaps(spans(spark, sf_dir), ["doc", "type"])


@register("overlap_count", f"SELECT doc, count(*) FILTER (s < reach) AS n_overlaps FROM (SELECT doc, s, max(e) OVER (PARTITION BY doc ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {SPANS}) GROUP BY doc")
def overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = F.max("e").over(Window.partitionBy("doc").orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1))
    return spans(spark, sf_dir).withColumn("reach", reach).groupBy("doc").agg(F.count_if(F.col("s") < F.col("reach")).alias("n_overlaps"))


_BASES = "(SELECT conv_id, turn, text, length(text) AS n, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM conversations)"


def page_bases(df: DataFrame) -> DataFrame:
    """Adds base, where each page begins in the document: pages are joined by two characters."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("n", F.length("text")).withColumn("base", F.coalesce(F.sum(F.col("n") + 2).over(before), F.lit(0)))


@register("page_bases", f"SELECT conv_id, turn, n::BIGINT AS n, base FROM {_BASES}")
def page_bases_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_bases(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.col("n").cast("long").alias("n"), "base")


@register("intake_contract", f"SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) = max(whole) AS consistent, max(base + n)::BIGINT AS n_chars FROM (SELECT b.*, w.whole FROM {_BASES} b JOIN (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id) w USING (conv_id)) GROUP BY conv_id")
def intake_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages joined must give the raw text, and their places must add up to its length."""
    paged = page_bases(table(spark, sf_dir, "conversations"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return paged.groupBy("conv_id").agg(joined.alias("raw"), F.max(F.col("base") + F.col("n")).alias("n_chars")).select("conv_id", (F.length("raw") == F.col("n_chars")).alias("consistent"), "n_chars")


@register("span_to_page", f"SELECT x.id, p.turn AS page, x.s - p.base AS page_s, x.e - p.base AS page_e FROM (SELECT id, doc AS conv_id, s, e FROM {SPANS}) x LEFT JOIN {_BASES} p ON p.conv_id = x.conv_id AND p.base <= x.s AND x.e <= p.base + p.n")
def span_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that holds a whole span; null for spans that lie in none."""
    x = spans(spark, sf_dir).select("id", F.col("doc").alias("conv_id"), "s", "e")
    pages = page_bases(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "base", (F.col("base") + F.col("n")).alias("stop"))
    hit = iv.overlap_pairs(x, pages, ["conv_id"], right_span=("base", "stop")).where("base <= s and e <= stop")
    return x.select("id").join(hit.select("id", F.col("turn").alias("page"), (F.col("s") - F.col("base")).alias("page_s"), (F.col("e") - F.col("base")).alias("page_e")), "id", "left")


_STRUCT = f"(SELECT doc, id AS sid, CASE id % 3 WHEN 0 THEN 'heading' WHEN 1 THEN 'cell' ELSE 'value' END AS kind, s AS s2, e AS e2 FROM {SPANS} WHERE type = 'signup')"


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spans(spark, sf_dir).where("type = 'signup'")
    kind = F.when(F.col("id") % 3 == 0, "heading").when(F.col("id") % 3 == 1, "cell").otherwise("value")
    return x.select("doc", F.col("id").alias("sid"), kind.alias("kind"), F.col("s").alias("s2"), F.col("e").alias("e2"))


@register("structural_validation", f"""SELECT x.id, CASE WHEN bool_or(kind = 'heading' AND s2 <= s AND e <= e2) THEN 'heading_rejected' WHEN min(CASE WHEN kind = 'value' AND s < s2 THEN s2 END) IS NOT NULL THEN 'trimmed_to_value'
  WHEN max(CASE WHEN kind = 'cell' AND s2 <= s AND s < e2 AND e > e2 THEN e2 END) IS NOT NULL THEN 'clipped_to_cell' ELSE 'kept' END AS outcome,
  CASE WHEN bool_or(kind = 'heading' AND s2 <= s AND e <= e2) THEN s WHEN min(CASE WHEN kind = 'value' AND s < s2 THEN s2 END) IS NOT NULL THEN min(CASE WHEN kind = 'value' AND s < s2 THEN s2 END) ELSE s END AS new_s,
  CASE WHEN bool_or(kind = 'heading' AND s2 <= s AND e <= e2) OR min(CASE WHEN kind = 'value' AND s < s2 THEN s2 END) IS NOT NULL THEN e ELSE coalesce(max(CASE WHEN kind = 'cell' AND s2 <= s AND s < e2 AND e > e2 THEN e2 END), e) END AS new_e
  FROM (SELECT x.id, x.s, x.e, t.* EXCLUDE (doc) FROM {SPANS} x LEFT JOIN {_STRUCT} t ON t.doc = x.doc AND t.sid != x.id AND t.s2 < x.e AND x.s < t.e2) x GROUP BY x.id, s, e""")
def structural_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rule that holds: inside a heading, reaching into a value from its label, running out of its cell."""
    x = spans(spark, sf_dir).select("doc", "id", "s", "e")
    met = iv.overlap_pairs(x, _structures(spark, sf_dir), ["doc"]).where("sid != id")
    found = met.groupBy("id").agg(F.expr("bool_or(kind = 'heading' and s2 <= s and e <= e2)").alias("head"), F.expr("min(case when kind = 'value' and s < s2 then s2 end)").alias("v"), F.expr("max(case when kind = 'cell' and s2 <= s and s < e2 and e > e2 then e2 end)").alias("c"))
    j = x.join(found, "id", "left")
    head, v, c = F.coalesce("head", F.lit(False)), F.col("v"), F.col("c")
    outcome = F.when(head, "heading_rejected").when(v.isNotNull(), "trimmed_to_value").when(c.isNotNull(), "clipped_to_cell").otherwise("kept")
    return j.select("id", outcome.alias("outcome"), F.when(head | v.isNull(), F.col("s")).otherwise(v).alias("new_s"), F.when(head | v.isNotNull(), F.col("e")).otherwise(F.coalesce(c, F.col("e"))).alias("new_e"))


@register("segment_projection", f"""SELECT x.id, count(t.sid) AS n_segments, CASE WHEN count(t.sid) = 0 THEN 'unmapped' WHEN bool_or(t.s2 <= x.s AND x.e <= t.e2) THEN 'exact' ELSE 'partial' END AS status, min(t.s2)::BIGINT AS first_start
  FROM {SPANS} x LEFT JOIN {_STRUCT} t ON t.doc = x.doc AND t.s2 < x.e AND x.s < t.e2 GROUP BY x.id""")
def segment_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans against map segments: exact inside one, partial across several, unmapped."""
    x = spans(spark, sf_dir).select("doc", "id", "s", "e")
    met = iv.overlap_pairs(x, _structures(spark, sf_dir), ["doc"]).groupBy("id").agg(F.count("*").alias("n_segments"), F.bool_or(F.expr("s2 <= s and e <= e2")).alias("inside"), F.min("s2").alias("first_start"))
    j = x.select("id").join(met, "id", "left")
    status = F.when(F.col("n_segments").isNull(), "unmapped").when(F.col("inside"), "exact").otherwise("partial")
    return j.select("id", F.coalesce("n_segments", F.lit(0)).alias("n_segments"), status.alias("status"), "first_start")


@register("highlight_segments", f"""WITH b AS (SELECT DISTINCT doc, s AS p FROM {SPANS} UNION SELECT doc, e FROM {SPANS}), g AS (SELECT doc, p AS a, lead(p) OVER (PARTITION BY doc ORDER BY p) AS z FROM b)
  SELECT doc, a::BIGINT AS seg_start, z::BIGINT AS seg_end, arg_min(id, (-score, s - e, s, type, id)) AS top_id, count(*) AS members FROM (SELECT g.doc, a, z, x.* EXCLUDE (doc) FROM g JOIN {SPANS} x ON x.doc = g.doc AND x.s < z AND a < x.e WHERE z IS NOT NULL) GROUP BY doc, a, z""")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch between span borders with its first span: score, length, start, type, id."""
    order = [F.col("score").desc(), (F.col("s") - F.col("e")).asc(), F.col("s"), F.col("type"), F.col("id")]
    return iv.segments(spans(spark, sf_dir), ["doc"], order)


@register("highlight_selection")
def highlight_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy choice of spans that do not overlap, by priority; order-dependent, so one document is one group."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        import bisect

        starts, ends, chosen = [], [], []
        for row in pdf.assign(n=-(pdf.e - pdf.s), q=-pdf.score).sort_values(["q", "n", "s", "type", "id"]).itertuples():
            i = bisect.bisect_left(starts, row.e)
            if not i or ends[i - 1] <= row.s:
                starts.insert(i, row.s)
                ends.insert(i, row.e)
                chosen.append(row.id)
        return pdf[pdf.id.isin(chosen)][["doc", "id", "s", "e"]]

    return spans(spark, sf_dir).groupBy("doc").applyInPandas(choose, "doc long, id long, s long, e long")


# Ground truth against detections: what recognizer r0 found is truth, shifted; the others are detections.
_TRUTH = f"(SELECT id AS gid, doc, type, s + id % 7 AS gs, e + id % 7 AS ge FROM {SPANS} WHERE recognizer = 'r0')"
_FOUND = f"(SELECT id, doc, type, s, e FROM {SPANS} WHERE recognizer != 'r0')"
_IOU = "CASE WHEN greatest(e, ge) > least(s, gs) THEN greatest(0, least(e, ge) - greatest(s, gs)) / ((e - s) + (ge - gs) - greatest(0, least(e, ge) - greatest(s, gs))) ELSE 0.0 END"
_CANDS = f"(SELECT d.*, g.gid, g.gs, g.ge, {_IOU} AS iou FROM {_FOUND} d JOIN {_TRUTH} g ON d.doc = g.doc AND d.type = g.type WHERE greatest(0, least(e, ge) - greatest(s, gs)) >= 0.5 * least(e - s, ge - gs) OR abs(s - gs) <= 10)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = spans(spark, sf_dir)
    truth = x.where("recognizer = 'r0'").select(F.col("id").alias("gid"), "doc", "type", (F.col("s") + F.col("id") % 7).alias("gs"), (F.col("e") + F.col("id") % 7).alias("ge"))
    return truth, x.where("recognizer != 'r0'").select("id", "doc", "type", "s", "e")


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _sides(spark, sf_dir)
    # Starts may lie ten apart without overlap: truth reaches out by ten on both sides for the join.
    wide = truth.withColumn("ws", F.col("gs") - 11).withColumn("we", F.col("ge") + 11)
    met = iv.overlap_pairs(found, wide, ["doc", "type"], right_span=("ws", "we"))
    args = F.col("s"), F.col("e"), F.col("gs"), F.col("ge")
    return met.where(scores.lenient(*args)).withColumn("iou", scores.iou(*args)).drop("ws", "we")


@register("match_candidates", f"SELECT id, gid, round_even(iou, 6) AS iou, iou >= 0.8 AS strict FROM {_CANDS}")
def match_candidates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_candidates(spark, sf_dir).select("id", "gid", F.bround("iou", 6).alias("iou"), (F.col("iou") >= 0.8).alias("strict"))


@register("boundary_accuracy", f"SELECT type, count(*) AS pairs, round_even(sum(iou) / count(*), 6) AS mean_iou, count(*) FILTER (s = gs AND e = ge) AS n_exact, count(*) FILTER (iou >= 0.8) AS n_near FROM {_CANDS} GROUP BY type")
def boundary_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums that merge; means follow them."""
    return match_candidates(spark, sf_dir).groupBy("type").agg(F.count("*").alias("pairs"), F.bround(F.sum("iou") / F.count("*"), 6).alias("mean_iou"), F.count_if(F.expr("s = gs and e = ge")).alias("n_exact"), F.count_if(F.col("iou") >= 0.8).alias("n_near"))


def greedy_match(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Truth in order takes the unused detection with the nearest start (first on ties); one document and type a group."""

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        right = right.sort_values(["s", "e", "id"]).reset_index(drop=True)
        for g in left.sort_values(["gs", "ge", "gid"]).itertuples():
            best = None
            for d in right.itertuples():
                shared = max(0, min(d.e, g.ge) - max(d.s, g.gs))
                if d.Index not in used and (shared >= 0.5 * min(d.e - d.s, g.ge - g.gs) or abs(d.s - g.gs) <= 10):
                    key = (abs(d.s - g.gs), d.Index)
                    if best is None or key < best[0]:
                        best = (key, d.id, d.Index)
            rows.append((g.doc, g.type, g.gid, best[1] if best else None))
            if best:
                used.add(best[2])
        return pd.DataFrame(rows, columns=["doc", "type", "gid", "id"])

    keys = ["doc", "type"]
    return truth.groupBy(keys).cogroup(found.groupBy(keys)).applyInPandas(assign, "doc long, type string, gid long, id long")


@register("greedy_match")
def greedy_match_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_match(*_sides(spark, sf_dir))


_COUNTS = f"(SELECT coalesce(g.doc, d.doc) AS doc, coalesce(g.type, d.type) AS type, coalesce(g.n, 0) AS want, coalesce(d.n, 0) AS got FROM (SELECT doc, type, count(*) AS n FROM {_TRUTH} GROUP BY ALL) g FULL JOIN (SELECT doc, type, count(*) AS n FROM {_FOUND} GROUP BY ALL) d ON g.doc = d.doc AND g.type = d.type)"


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, found = _sides(spark, sf_dir)
    both = truth.groupBy("doc", "type").agg(F.count("*").alias("want")).join(found.groupBy("doc", "type").agg(F.count("*").alias("got")), ["doc", "type"], "full").fillna(0, ["want", "got"])
    tp = F.least("want", "got")
    return both.select("doc", "type", tp.alias("tp"), (F.col("got") - tp).alias("fp"), (F.col("want") - tp).alias("fn"))


@register("document_level_match", f"SELECT doc, type, least(want, got) AS tp, got - least(want, got) AS fp, want - least(want, got) AS fn FROM {_COUNTS}")
def document_level_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_counts(spark, sf_dir)


@register("score_rollup", f"""SELECT doc, type, tp, fp, fn, round_even(p, 6) AS precision_score, round_even(r, 6) AS recall_score, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM (
  SELECT doc, type, sum(least(want, got))::BIGINT AS tp, sum(got - least(want, got))::BIGINT AS fp, sum(want - least(want, got))::BIGINT AS fn FROM {_COUNTS} GROUP BY GROUPING SETS ((doc, type), (doc), (type), ())))""")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_counts(spark, sf_dir)
    d, t = F.col("doc"), F.col("type")
    sums = c.groupingSets([[d, t], [d], [t], []], d, t).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    return scores.precision_recall_f1(sums)


# Aliases of entity types (a type without one stands for itself), and the groups of types.
ALIASES = {
    "EMAIL": "EMAIL_ADDRESS",
    "PHONE": "PHONE_NUMBER",
    "IBAN": "IBAN_CODE",
    "IP": "IP_ADDRESS",
    "PERSON_NAME": "PERSON",
    "ORG": "ORGANIZATION",
    "LOC": "LOCATION",
    "DATE": "DATE_TIME",
    "STEUERNUMMER": "TAX_ID_AT",
    "TAX_ID": "TAX_ID_AT",
    "POLIZZENUMMER": "POLICY_NUMBER",
    "SCHADENNUMMER": "CLAIM_NUMBER",
    "VERTRAGSNUMMER": "CONTRACT_NUMBER",
    "AKTENZEICHEN": "CASE_NUMBER",
    "RECHNUNGSNUMMER": "INVOICE_NUMBER",
    "ANGEBOTSNUMMER": "OFFER_NUMBER",
    "KUNDENNUMMER": "CUSTOMER_NUMBER",
    "KFZ_KENNZEICHEN": "LICENSE_PLATE_AT",
    "LICENSE_PLATE": "LICENSE_PLATE_AT",
    "REISEPASS": "PASSPORT_NUMBER",
    "PERSONALAUSWEIS": "ID_CARD_NUMBER",
    "BERICHTSNUMMER": "REPORT_NUMBER",
    "GUTACHTENNUMMER": "ASSESSMENT_NUMBER",
}
GROUPS = {
    "structured_types": ["EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE", "CREDIT_CARD", "IP_ADDRESS", "URL"],
    "ner_types": ["PERSON", "ORGANIZATION", "LOCATION", "DATE_TIME"],
    "domain_sensitive_types": ["UID_AT", "FN_AT", "SVNR_AT", "TAX_ID_AT", "POLICY_NUMBER", "CLAIM_NUMBER", "CONTRACT_NUMBER", "CASE_NUMBER", "INVOICE_NUMBER", "OFFER_NUMBER", "CUSTOMER_NUMBER", "LICENSE_PLATE_AT", "PASSPORT_NUMBER", "ID_CARD_NUMBER", "BIC", "FILE_REFERENCE", "REPORT_NUMBER", "ASSESSMENT_NUMBER", "PROJECT_ID", "TRANSACTION_ID", "USER_ID"],
    "address_contact_types": ["ADDRESS", "CONTACT_LINE", "CUSTOMER_LINE"],
}


def canonical(raw: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), raw), raw)


def type_group(canonical_type: Column) -> Column:
    out = F.lit("other_types")
    for name, members in GROUPS.items():
        out = F.when(canonical_type.isin(members), name).otherwise(out)
    return out


_RAW = ", ".join(f"('{t}')" for t in [*ALIASES, *(t for members in GROUPS.values() for t in members), "BIRTH_DATE", "BIRTH_PLACE", "SOMETHING"])
_ALIAS_ROWS = ", ".join(f"('{a}', '{c}')" for a, c in ALIASES.items())
_GROUP_ROWS = ", ".join(f"('{g}', '{t}')" for g, members in GROUPS.items() for t in members)


@register("canonical_types", f"SELECT raw, coalesce(a.canonical, raw) AS canonical, coalesce(g.name, 'other_types') AS type_group FROM (VALUES {_RAW}) r(raw) LEFT JOIN (VALUES {_ALIAS_ROWS}) a(alias, canonical) ON a.alias = r.raw LEFT JOIN (VALUES {_GROUP_ROWS}) g(name, member) ON g.member = coalesce(a.canonical, raw)")
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = values(spark, _RAW, "raw").withColumn("canonical", canonical(F.col("raw")))
    return named.withColumn("type_group", type_group(F.col("canonical")))
