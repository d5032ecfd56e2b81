"""The queries opN_<name> and pipeline over whole tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, lsh, mixing, pivot_index, sentencepiece, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from .common import Stash, table

#: Production parameters.
SHARDS = [f"shard-{i:03d}" for i in range(96)]

CATEGORIES = ["low_quality", "toxic"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), Stash(spark))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), Stash(spark), keep=["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return lsh.nearest(rows, rows.where("vec_id % 20 = 0"), Stash(spark)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), Stash(spark))
    return out.select("row.doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), Stash(spark))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def tokenizer() -> bytes:
    """The public vocabulary's bytes, from the path in LODESTONE_TOKENIZER or the installed files."""
    return sentencepiece.read_model(os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model"))


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.train(docs, labels, CATEGORIES)


def toxicity_verdicts(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str]) -> DataFrame:
    """row, probabilities and toxic: whether the last category of the chain holds."""
    chain = toxicity_chain(spark, docs, sf_dir)
    return toxicity.score(docs, chain, keep=keep).withColumn("toxic", F.element_at("probabilities", -1) >= chain.thresholds[-1])


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_verdicts(spark, table(spark, sf_dir, "documents"), sf_dir, ["doc_id"])
    return out.select("row.doc_id", *[F.col("probabilities")[i].alias(f"p_{c}") for i, c in enumerate(CATEGORIES)], "toxic")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer())
    return out.select("row.doc_id", "ids", "n_tokens", "round_trip")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"), Stash(spark))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS)


def op10_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(table(spark, sf_dir, "embeddings"), Stash(spark))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: By brute force: every window against every other.
_OP8 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS v FROM w, range(1, len(ws) - 33) t(i)),
  dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY v) AS n FROM win) WHERE n > 1),
  gone AS (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(0, 35) t(j)),
  word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
  SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
_OP10 = """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id != b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
  r(vec_id, c) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
  n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
  SELECT r.vec_id, coalesce(max(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express an operator on whole tables; the others are held against brute force in the tests."""
    return {"op8_substring_dedup": _OP8, "op10_pivot_near_dedup": _OP10}
