"""Review entries, ground truth and the benchmark run, on spans made from the events table.

Roles follow from the id: of every user's spans, those with id modulo 7 equal to 3 are manual additions, the others are
detections; a decision on a span stands in the log under the id that follows it by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions.scores import precision_recall_f1
from ..sources.tables import SPANS, spans, table

_DEC = "(SELECT event_id - 1 AS id, CASE WHEN event_type = 'click' THEN 'keep' WHEN event_type = 'error' THEN 'false_positive' ELSE 'pseudonymize' END AS decision FROM events WHERE event_type IN ('click', 'error', 'purchase'))"
_STATUS = "CASE coalesce(d.decision, 'none') WHEN 'keep' THEN 'kept' WHEN 'false_positive' THEN 'rejected' ELSE 'accepted' END"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with kind and effective status: accepted unless the latest decision says otherwise."""
    x = spans(spark, sf_dir)
    log = table(spark, sf_dir, "events").where("event_type in ('click', 'error', 'purchase')")
    decision = F.when(F.col("event_type") == "click", "keep").when(F.col("event_type") == "error", "false_positive").otherwise("pseudonymize")
    latest = log.select((F.col("event_id") - 1).alias("id"), "event_id", decision.alias("decision")).groupBy("id").agg(F.max_by("decision", "event_id").alias("decision"))
    status = F.when(F.col("decision") == "keep", "kept").when(F.col("decision") == "false_positive", "rejected").otherwise("accepted")
    return x.join(latest, "id", "left").withColumn("status", status).withColumn("kind", F.when(F.col("id") % 7 == 3, "manual").otherwise("detected"))


_ENTRIES = f"(SELECT x.*, CASE WHEN x.id % 7 = 3 THEN 'manual' ELSE 'detected' END AS kind, {_STATUS} AS status FROM {SPANS} x LEFT JOIN {_DEC} d USING (id))"


@register("review_entries", f"SELECT id, doc, kind, status, CASE WHEN kind = 'manual' AND doc % 5 = 0 THEN 'incompatible' WHEN s % 6 = 0 THEN 'unresolved' ELSE 'resolved' END AS identity_status FROM {_ENTRIES}")
def review_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected and manual entries in one list; what cannot be identified says so."""
    identity = F.when((F.col("kind") == "manual") & (F.col("doc") % 5 == 0), "incompatible").when(F.col("s") % 6 == 0, "unresolved").otherwise("resolved")
    return decided(spark, sf_dir).select("id", "doc", "kind", "status", identity.alias("identity_status"))


@register("review_summary", f"SELECT doc, kind, status, count(*) AS n, count(DISTINCT type) AS n_types FROM {_ENTRIES} GROUP BY GROUPING SETS ((doc, status), (kind, status), (status), ())")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k, s = F.col("doc"), F.col("kind"), F.col("status")
    return decided(spark, sf_dir).groupingSets([[d, s], [k, s], [s], []], d, k, s).agg(F.count("*").alias("n"), F.countDistinct("type").alias("n_types"))


@register("highlight_summary", f"SELECT doc, count(*) AS n, count(DISTINCT type) AS n_types, min(s)::BIGINT AS first_start FROM {_ENTRIES} WHERE status != 'rejected' GROUP BY doc")
def highlight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).where("status != 'rejected'").groupBy("doc").agg(F.count("*").alias("n"), F.countDistinct("type").alias("n_types"), F.min("s").alias("first_start"))


_GT = f"(SELECT DISTINCT doc, type, s, e, channel FROM (SELECT doc, type, s, e, 'review' AS channel FROM {_ENTRIES} WHERE status IN ('accepted', 'kept') AND kind = 'detected' AND id % 3 != 2 UNION ALL SELECT doc, type, s, e, 'manual' FROM {_ENTRIES} WHERE kind = 'manual'))"
_COVER = f"(SELECT DISTINCT doc, type, s, e, 'feedback' AS channel FROM {_ENTRIES} f WHERE id % 3 = 2 AND kind = 'detected' AND status = 'accepted' AND NOT EXISTS (SELECT 1 FROM {_GT} g WHERE g.doc = f.doc AND g.type = f.type AND g.s = f.s AND g.e = f.e))"


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed and manual spans, and feedback's spans where no stronger channel covers the place."""
    x = decided(spark, sf_dir)
    place = ["doc", "type", "s", "e"]
    review = x.where("status in ('accepted', 'kept') and kind = 'detected' and id % 3 != 2").select(*place, F.lit("review").alias("channel"))
    manual = x.where("kind = 'manual'").select(*place, F.lit("manual").alias("channel"))
    strong = review.unionByName(manual).distinct()
    feedback = x.where("id % 3 = 2 and kind = 'detected' and status = 'accepted'").select(*place, F.lit("feedback").alias("channel")).distinct()
    return strong.unionByName(feedback.join(strong.select(*place).distinct(), place, "left_anti"))


@register("ground_truth", f"SELECT * FROM {_GT} UNION ALL SELECT * FROM {_COVER}")
def ground_truth_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth(spark, sf_dir)


@register("ground_truth_totals", f"SELECT type, channel, count(*) AS n, count(DISTINCT doc) AS n_docs FROM (SELECT * FROM {_GT} UNION ALL SELECT * FROM {_COVER}) GROUP BY ROLLUP (type, channel)")
def ground_truth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground_truth(spark, sf_dir).rollup("type", "channel").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("n_docs"))


@register("proposal", f"SELECT id, doc, type, s, e FROM {SPANS} WHERE (score >= 0.4 OR score IS NULL) AND type IN ('click', 'view', 'error')")
def proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as proposed ground truth: profile, least score, unknown scores pass."""
    return spans(spark, sf_dir).where("(score >= 0.4 or score is null) and type in ('click', 'view', 'error')").select("id", "doc", "type", "s", "e")


_RUN = f"(SELECT type, g.doc IS NOT NULL AS want, f.doc IS NOT NULL AS got FROM (SELECT DISTINCT doc, type, s, e FROM {_GT}) g FULL JOIN (SELECT DISTINCT doc, type, s, e FROM {SPANS} WHERE score >= 0.5) f USING (doc, type, s, e))"


@register("benchmark_run", f"""SELECT type, tp, fp, fn, round_even(p, 6) AS precision_score, round_even(r, 6) AS recall_score, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
  FROM (SELECT type, count(*) FILTER (want AND got) AS tp, count(*) FILTER (got AND NOT want) AS fp, count(*) FILTER (want AND NOT got) AS fn FROM {_RUN} GROUP BY ROLLUP (type)))""")
def benchmark_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections above the threshold against ground truth, exact places, by type and in all."""
    place = ["doc", "type", "s", "e"]
    x = decided(spark, sf_dir)
    want = x.where("(status in ('accepted', 'kept') and kind = 'detected' and id % 3 != 2) or kind = 'manual'").select(*place).distinct().withColumn("want", F.lit(True))
    got = x.where("score >= 0.5").select(*place).distinct().withColumn("got", F.lit(True))
    both = want.join(got, place, "full").fillna(False, ["want", "got"])
    counts = both.rollup("type").agg(F.count_if(F.expr("want and got")).alias("tp"), F.count_if(F.expr("got and not want")).alias("fp"), F.count_if(F.expr("want and not got")).alias("fn"))
    return precision_recall_f1(counts)
