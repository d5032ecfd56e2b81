"""Review and feedback logs, artifacts and the job queue, on the events and orders tables.

An event is a log record: its user is the document, its type the target, its id the place in the log. Event types stand
for job states: click pending, view running, purchase succeeded, error failed, anything else canceled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators.latest import first_rank, latest
from ..sources.tables import table

STATES = {"click": "pending", "view": "running", "purchase": "succeeded", "error": "failed"}
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " ELSE 'canceled' END"
#: Seconds after which a lease has run out or a heartbeat is stale, attempts of a job, and the moment of the queries.
LEASE, STALE, ATTEMPTS = 3600, 86400, 3
_NOW = "(SELECT max(ts) FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _now(events: DataFrame) -> DataFrame:
    return events.agg(F.max("ts").alias("now"))


@register("latest_per_key", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY ALL")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


@register("latest_by_log_order", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_by_log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line wins, whatever its time."""
    return latest(_events(spark, sf_dir).select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


@register("latest_artifact", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate, count(*) AS versions FROM orders GROUP BY o_custkey")
def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.max("o_orderdate").alias("o_orderdate"), F.count("*").alias("versions"))


@register("latest_artifact_by_profile", "SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def latest_artifact_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


_DECIDE = "CASE WHEN event_id % 3 = 0 THEN 'accepted' WHEN event_id % 3 = 1 THEN 'kept' ELSE 'rejected' END"
_OCC = f"(SELECT user_id, value_key, arg_max({_DECIDE}, event_id) AS d FROM (SELECT *, event_id % 11 AS value_key FROM events WHERE event_type = 'click') GROUP BY ALL)"
_GRP = f"(SELECT user_id, arg_max({_DECIDE}, event_id) AS d FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


@register("decision_precedence", f"""SELECT t.user_id, t.value_key, coalesce(o.d, g.d, 'accepted') AS status, CASE WHEN o.d IS NOT NULL THEN 'occurrence' WHEN g.d IS NOT NULL THEN 'group' ELSE 'default' END AS scope
  FROM (SELECT DISTINCT user_id, event_id % 11 AS value_key FROM events) t LEFT JOIN {_OCC} o USING (user_id, value_key) LEFT JOIN {_GRP} g USING (user_id)""")
def decision_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The occurrence's decision, else its group's, else accepted."""
    e = _events(spark, sf_dir).withColumn("value_key", F.col("event_id") % 11)
    decided = e.withColumn("d", F.expr(_DECIDE))
    occurrence = decided.where("event_type = 'click'").groupBy("user_id", "value_key").agg(F.max_by("d", "event_id").alias("own"))
    group = decided.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("d", "event_id").alias("grp"))
    joined = e.select("user_id", "value_key").distinct().join(occurrence, ["user_id", "value_key"], "left").join(group, "user_id", "left")
    scope = F.when(F.col("own").isNotNull(), "occurrence").when(F.col("grp").isNotNull(), "group").otherwise("default")
    return joined.select("user_id", "value_key", F.coalesce("own", "grp", F.lit("accepted")).alias("status"), scope.alias("scope"))


@register("stale_decisions", "SELECT l.user_id, l.event_type, l.event_id, l.event_id % 5 AS artifact, c.current FROM (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) l JOIN (SELECT user_id, max(event_id) % 5 AS current FROM events GROUP BY user_id) c USING (user_id) WHERE l.event_id % 5 != c.current AND l.event_type != 'signup'")
def stale_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest records that rest on an artifact other than the current one; one kind of record survives re-runs."""
    e = _events(spark, sf_dir)
    last = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    current = e.groupBy("user_id").agg((F.max("event_id") % 5).alias("current"))
    return last.join(current, "user_id").withColumn("artifact", F.col("event_id") % 5).where("artifact != current and event_type != 'signup'").select("user_id", "event_type", "event_id", "artifact", "current")


@register("target_exists", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def target_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return _events(spark, sf_dir).select("event_id", "user_id").join(known, "user_id", "left_semi")


@register("tombstones", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id) WHERE last = 'error') GROUP BY user_id")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion is terminal: nothing of a deleted document shows. A user whose last event is an error is one."""
    e = _events(spark, sf_dir)
    gone = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).where("last = 'error'").select("user_id")
    return e.join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


_FB = "(SELECT user_id, event_type, event_id % 3 AS rec, event_id % 20 AS ent, arg_max(CASE WHEN event_id % 4 = 0 THEN 'false_positive' WHEN event_id % 4 = 1 THEN 'wrong_type' ELSE 'correct' END, (ts, event_id)) AS verdict, count(*) AS n FROM events GROUP BY ALL)"


@register("feedback_taxonomy", f"SELECT event_type, 'r' || rec AS recognizer, count(*) AS entities, count(*) FILTER (verdict != 'correct') AS issues, count(*) FILTER (verdict = 'false_positive') AS false_positives, count(*) FILTER (n > 1) AS revised, round_even(count(*) FILTER (verdict != 'correct') / count(*), 3) AS issue_rate, count(DISTINCT user_id) AS documents FROM {_FB} GROUP BY GROUPING SETS ((event_type), (rec), ())")
def feedback_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest verdict of each entity, by type, by recognizer and in all."""
    e = _events(spark, sf_dir)
    verdict = F.when(F.col("event_id") % 4 == 0, "false_positive").when(F.col("event_id") % 4 == 1, "wrong_type").otherwise("correct")
    keyed = e.select("user_id", "event_type", F.concat(F.lit("r"), F.col("event_id") % 3).alias("recognizer"), (F.col("event_id") % 20).alias("ent"), "ts", "event_id", verdict.alias("v"))
    last = keyed.groupBy("user_id", "event_type", "recognizer", "ent").agg(F.max_by("v", F.struct("ts", "event_id")).alias("verdict"), F.count("*").alias("n"))
    issue = F.count_if(F.col("verdict") != "correct")
    t, r = F.col("event_type"), F.col("recognizer")
    return last.groupingSets([[t], [r], []], t, r).agg(F.count("*").alias("entities"), issue.alias("issues"), F.count_if(F.col("verdict") == "false_positive").alias("false_positives"), F.count_if(F.col("n") > 1).alias("revised"), F.bround(issue / F.count("*"), 3).alias("issue_rate"), F.countDistinct("user_id").alias("documents"))


@register("job_states", f"SELECT {_STATE} AS status, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy(F.expr(_STATE).alias("status")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@register("state_transitions", f"SELECT was, status, count(*) AS n, was IS NULL OR (was = 'pending' AND status IN ('running', 'canceled')) OR (was = 'running' AND status IN ('succeeded', 'failed', 'canceled', 'pending')) AS allowed FROM (SELECT {_STATE} AS status, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) GROUP BY ALL")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("status", F.expr(_STATE))
    moved = e.withColumn("was", F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    allowed = F.expr("was is null or (was = 'pending' and status in ('running', 'canceled')) or (was = 'running' and status in ('succeeded', 'failed', 'canceled', 'pending'))")
    return moved.groupBy("was", "status").agg(F.count("*").alias("n")).withColumn("allowed", allowed)


_LAST = f"(SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS status, max(ts) AS ts, count(*) FILTER ({_STATE} = 'running') AS attempts FROM events GROUP BY user_id)"


def _last(e: DataFrame) -> DataFrame:
    s = e.withColumn("status", F.expr(_STATE))
    return s.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts"), F.count_if(F.col("status") == "running").alias("attempts"))


@register("job_recovery", f"SELECT user_id, status, attempts, CASE WHEN status = 'running' AND ts + INTERVAL {LEASE} SECOND <= {_NOW} THEN CASE WHEN attempts < {ATTEMPTS} THEN 'requeue' ELSE 'fail_interrupted' END ELSE 'leave' END AS action FROM {_LAST}")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs whose lease has run out go back to the queue while attempts are left, else they fail."""
    e = _events(spark, sf_dir)
    lapsed = (F.col("status") == "running") & (F.col("ts") + F.make_dt_interval(secs=F.lit(LEASE)) <= F.col("now"))
    action = F.when(lapsed, F.when(F.col("attempts") < ATTEMPTS, "requeue").otherwise("fail_interrupted")).otherwise("leave")
    return _last(e).join(F.broadcast(_now(e)), F.lit(True)).select("user_id", "status", "attempts", action.alias("action"))


@register("job_claim", f"SELECT k, arg_min(user_id, (ts, user_id)) AS user_id, min(ts) AS ts, count(*) AS waiting FROM (SELECT *, user_id % 4 AS k FROM {_LAST}) WHERE status = 'pending' AND attempts < 100 GROUP BY k")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending job of each kind."""
    waiting = _last(_events(spark, sf_dir)).withColumn("k", F.col("user_id") % 4).where("status = 'pending' and attempts < 100")
    return waiting.groupBy("k").agg(F.min_by("user_id", F.struct("ts", "user_id")).alias("user_id"), F.min("ts").alias("ts"), F.count("*").alias("waiting"))


@register("jobs_newest", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def jobs_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 newest jobs of each document."""
    return first_rank(_events(spark, sf_dir).select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)


@register("fenced_writes", f"SELECT event_id, a.attempt = b.attempts AS accepted FROM (SELECT event_id, user_id, count(*) FILTER ({_STATE} = 'running') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, {_STATE} AS status FROM events) a JOIN {_LAST} b USING (user_id) WHERE a.status IN ('succeeded', 'failed')")
def fenced_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A terminal write counts only if it carries the job's current attempt."""
    e = _events(spark, sf_dir).withColumn("status", F.expr(_STATE))
    attempt = F.sum((F.col("status") == "running").cast("long")).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    writes = e.withColumn("attempt", attempt).where("status in ('succeeded', 'failed')")
    return writes.join(_last(_events(spark, sf_dir)).select("user_id", "attempts"), "user_id").select("event_id", (F.col("attempt") == F.col("attempts")).alias("accepted"))


@register("worker_staleness", f"SELECT user_id % 10 AS worker, max(ts) AS last_seen, date_diff('second', max(ts), {_NOW}) AS age, date_diff('second', max(ts), {_NOW}) > {STALE} AS stale FROM events GROUP BY 1")
def worker_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    seen = e.groupBy((F.col("user_id") % 10).alias("worker")).agg(F.max("ts").alias("last_seen"))
    age = F.unix_timestamp("now") - F.unix_timestamp("last_seen")
    return seen.join(F.broadcast(_now(e)), F.lit(True)).select("worker", "last_seen", age.alias("age"), (age > STALE).alias("stale"))


@register("analysis_state", f"SELECT user_id, CASE WHEN bool_or({_STATE} IN ('pending', 'running') AND ts > {_NOW} - INTERVAL 15 MINUTE) THEN 'running' WHEN bool_or({_STATE} = 'succeeded') THEN 'analyzed' ELSE 'none' END AS state FROM events GROUP BY user_id")
def analysis_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    s = e.join(F.broadcast(_now(e)), F.lit(True)).withColumn("status", F.expr(_STATE))
    fresh = F.bool_or(F.expr("status in ('pending', 'running') and ts > now - interval 15 minutes"))
    return s.groupBy("user_id").agg(F.when(fresh, "running").when(F.bool_or(F.expr("status = 'succeeded'")), "analyzed").otherwise("none").alias("state"))


@register("job_metadata_json", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_keys(props) IS NOT NULL AS parsed FROM events")
def job_metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A safe path read gives null where the path or the JSON is missing."""
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"), F.from_json("props", "map<string,string>").isNotNull().alias("parsed"))


@register("missing_artifacts", "SELECT c_custkey, array_to_string(list_filter([CASE WHEN o.k IS NULL THEN 'orders' END, CASE WHEN e.k IS NULL THEN 'events' END, CASE WHEN d.k IS NULL THEN 'documents' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey LEFT JOIN (SELECT DISTINCT user_id AS k FROM events) e ON e.k = c_custkey LEFT JOIN (SELECT DISTINCT doc_id AS k FROM documents) d ON d.k = c_custkey WHERE o.k IS NULL OR e.k IS NULL OR d.k IS NULL")
def missing_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = lambda name, key: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("c_custkey")).distinct().withColumn(name, F.lit(True))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    for name, key in (("orders", "o_custkey"), ("events", "user_id"), ("documents", "doc_id")):
        c = c.join(have(name, key), "c_custkey", "left")
    lacking = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("orders", "events", "documents")]))
    return c.select("c_custkey", lacking.alias("m")).where(F.size("m") > 0).select("c_custkey", F.array_join("m", ",").alias("missing"))
