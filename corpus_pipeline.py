"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, sentencepiece, simhash, substring_dedup
from lodestone.llm.common import Stash, table
from lodestone.llm.queries import tokenizer, toxicity_verdicts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic, as they stand."""
    judged = toxicity_verdicts(spark, docs.select(COLUMNS), sf_dir, COLUMNS)
    return judged.where("not toxic").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more (five-word shingles) the row with the least id stays.

    Rows without an id come after those with one; of rows that share an id and a group the one whose text has the least
    hash stays. Rows are told apart by a number written with them, so that rows that share an id but no group all count.
    Null and blank texts are alike and form one group; an empty table gives an empty one.
    """
    stash = Stash(spark)
    named = stash.save(docs.select(F.monotonically_increasing_id().alias("at"), *COLUMNS))
    found = simhash.similar_groups(named.select("at", "doc_id", F.xxhash64("text").alias("hash"), "text"), stash)
    least = F.min(F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "row.hash", "row.at"))
    kept = found.groupBy("component").agg(least.getField("at").alias("at"))
    return named.join(kept.select("at"), "at").select(COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that windows shared with another place cover; those that lose all words go."""
    out = substring_dedup.remove_repeated_windows(docs.select(COLUMNS), Stash(spark), rejoin=False)
    text = F.col("kept").cast("string")
    return out.where("n_removed = 0 or n_removed < n_words").select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("row.n_chars")).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    out = mixing.mix(docs.select(COLUMNS), Stash(spark), keep=COLUMNS)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens and round_trip, a row for each copy."""
    out = sentencepiece.encode(docs.select(COLUMNS), tokenizer(), keep=["doc_id", "source"])
    return out.select("row.doc_id", "row.source", "ids", "n_tokens", "round_trip")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("mix_sources", mix_sources), ("sentencepiece", tokenize)]

#: The learned classifier and the fingerprints cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written to the shared folder and read again as the next one's input."""
    stash, docs = Stash(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stash.save(stage(spark, docs, sf_dir))
    return docs
