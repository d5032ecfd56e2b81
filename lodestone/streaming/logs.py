"""Streaming forms of the log folds and the job queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def latest_stream(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current state of each key, for update mode. No watermark: a late record must never be dropped."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour", keys: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling event-time windows behind a watermark (an addition to the log folds)."""
    stream = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
    return stream.select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of a key (an addition to the log folds)."""
    stream = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return stream.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def without_tombstones(stream: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Deletion is terminal: a stream-static anti-join."""
    return stream.join(gone.select(key).distinct(), key, "left_anti")


def dual_append(stream: DataFrame, per_document: str, archive: str, checkpoint: str) -> DataStreamWriter:
    """Every record goes to the documents' logs and to the archive that survives deletion."""

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        batch.write.mode("append").partitionBy("doc").json(per_document)
        batch.write.mode("append").json(archive)
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def recover(jobs: DataFrame, now, lease_seconds: int, attempts: int) -> DataFrame:
    """Running jobs whose lease ran out return to the queue while attempts are left, else fail; others stay."""
    lapsed = (F.col("status") == "running") & (F.col("leased_at").isNull() | (F.col("leased_at") + F.make_dt_interval(secs=F.lit(lease_seconds)) <= now))
    status = F.when(lapsed & (F.col("attempts") < attempts), "pending").when(lapsed, "failed").otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "error": F.when(lapsed & (F.col("attempts") >= attempts), "interrupted")})
