"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table below which it may come in fewer pieces than there are cores.
SMALL = 1 << 28


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents`` for work on whole texts. A small table, which may be a single row group of one file, is
    dealt out to all cores first: the work costs more than the move. A large one has pieces enough and stays as read."""
    df = table(spark, sf_dir, "documents").select(*columns)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(spark.sparkContext.defaultParallelism) if size < SMALL else df


#: SQL of values(): the same literals for both engines.
def values_sql(rows: str, columns: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) AS fixture({columns}))"


def values(spark: SparkSession, rows: str, columns: str) -> DataFrame:
    """A literal relation."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS fixture({columns})")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans made from the events table: id, doc, type, s, e, score, recognizer. A user is a document."""
    e = table(spark, sf_dir, "events")
    start = (F.col("event_id") * 37) % 400
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("doc"),
        F.col("event_type").alias("type"),
        start.alias("s"),
        (start + 1 + (F.col("event_id") * 13) % 40).alias("e"),
        ((F.col("event_id") % 97) / 97.0).alias("score"),
        F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("recognizer"),
    )


#: DuckDB's form of spans().
SPANS = """(SELECT event_id AS id, user_id AS doc, event_type AS type, (event_id * 37) % 400 AS s,
  (event_id * 37) % 400 + 1 + (event_id * 13) % 40 AS e, (event_id % 97) / 97.0::DOUBLE AS score, 'r' || (event_id % 3) AS recognizer FROM events)"""
