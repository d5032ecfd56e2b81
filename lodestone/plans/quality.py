"""Text quality, routing and quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import quality as q
from ..sources.tables import table, values, values_sql, texts

_RATIO = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0.0 END"


def verdict_sql(source: str, key: str) -> str:
    """The verdict in DuckDB, written apart from the expressions."""
    return f"""
    WITH tok AS (SELECT {key}, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '\\S+') AS toks FROM {source}),
    cores AS (SELECT *, list_transform(toks, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS cs FROM tok),
    words AS (SELECT *, list_filter(cs, lambda x: length(x) >= 2 AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) >= 2
        AND length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) / length(x) >= {q.WORD_LETTER_RATIO} AND regexp_matches(lower(x), '[{q.VOWELS}]')) AS ws FROM cores),
    n AS (SELECT {key}, greatest(length(regexp_replace(t, '\\s', '', 'g')), 1) AS non_space, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters,
        length(regexp_replace(t, '[^\\p{{Nd}}]', '', 'g')) AS digits,
        length(regexp_replace(regexp_replace(t, '\\s', '', 'g'), '[^\\p{{Cc}}\\p{{Cf}}\\p{{Co}}\\x{{FFFD}}]', '', 'g')) AS control,
        length(regexp_replace(replace(t, chr(65533), ''), '[^\\p{{P}}\\p{{S}}]', '', 'g')) AS punct,
        len(toks) AS tokens, len(ws) AS words,
        len(list_filter(cs, lambda x: regexp_matches(x, '^[0-9][0-9.,:/\\- ]*$') AND NOT list_contains(ws, x))) AS numbers,
        length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS stripped FROM words),
    r AS (SELECT *, letters / non_space AS lr, digits / non_space AS dr, punct / non_space AS pr, control / non_space AS cr,
        {_RATIO.format('words', 'tokens')} AS wr, {_RATIO.format('numbers', 'tokens')} AS nr FROM n),
    f AS (SELECT *, stripped = 0 AS empty, cr >= 0.1 AND non_space >= 20 AS ctl, non_space >= 50 AND lr < 0.15 AS low, non_space >= 50 AND dr + pr > 0.5 AS sym,
        non_space >= 50 AND wr < 0.3 AS few,
        CASE WHEN stripped = 0 THEN 0 ELSE round_even(greatest(0.0, least(1.0, 0.5 * least(lr / 0.5, 1.0) + 0.5 * least(1.0, wr + CASE WHEN wr >= 0.1 THEN nr ELSE 0.0 END) - least(cr * 2.0, 0.5))) * 100, 0) END::BIGINT AS sc FROM r),
    b AS (SELECT *, NOT empty AND (ctl OR (sym AND (low OR (lr < 0.35 AND few)))) AS broken FROM f),
    p AS (SELECT *, NOT empty AND NOT broken AND (stripped < 45 OR tokens < 8) AS sparse FROM b)
    SELECT {key}, sc AS quality_score,
        CASE WHEN empty THEN 'EMPTY_TEXT_LAYER' WHEN broken THEN 'BROKEN_TEXT_LAYER' WHEN NOT sparse AND sc >= 80 THEN 'GOOD_TEXT_LAYER' ELSE 'LOW_CONFIDENCE_TEXT_LAYER' END AS quality_status,
        CASE WHEN empty OR broken THEN 'ocr' ELSE 'text_layer' END AS text_source, empty OR broken AS needs_ocr,
        array_to_string(list_filter([CASE WHEN empty THEN 'empty_text_layer' END, CASE WHEN NOT empty AND ctl THEN 'high_control_char_ratio' END,
          CASE WHEN NOT empty AND low THEN 'very_low_letter_ratio' END, CASE WHEN NOT empty AND sym THEN 'high_symbol_or_digit_ratio' END,
          CASE WHEN NOT empty AND few THEN 'few_word_tokens' END, CASE WHEN sparse THEN 'sparse_text' END,
          CASE WHEN NOT empty AND NOT broken AND NOT sparse AND sc < 80 THEN 'mixed_quality_signals' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM p"""


_VERDICT = ["quality_score", "quality_status", "text_source", "needs_ocr"]


@register("text_quality", verdict_sql("documents", "doc_id"))
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.verdict(texts(spark, sf_dir, "doc_id", "text")).select("doc_id", *_VERDICT, F.array_join("reasons", ",").alias("reasons"))


_PAGES = """(1, ''), (2, '  \n '), (3, 'Invoice no 42'), (4, '12 34 ## 99 %% 11 ++ 22 33 44 55 66 77 88 99 00 !! 12 34 56 78 90 11 22 33 44 55'), (5, repeat('#', 60)),
 (6, 'Dies ist eine lange und gut lesbare Zeile mit vielen Wörtern und 3 Zahlen 12,50 im Text'), (7, 'xkcd bcdf ghjk lmnp qrst vwxz bcdf ghjk lmnp qrst vwxz')"""


@register("text_quality_cases", verdict_sql(values_sql(_PAGES, "page, text"), "page"))
def text_quality_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.verdict(values(spark, _PAGES.replace("\n '", "\\n '").replace("),\n", "),"), "page, text")).select("page", *_VERDICT, F.array_join("reasons", ",").alias("reasons"))


@register("quality_by_source", f"""SELECT source, lang, quality_status, count(*) AS n, sum(CASE WHEN needs_ocr THEN 1 ELSE 0 END)::BIGINT AS n_ocr, round_even(avg(quality_score), 4) AS mean_score
  FROM ({verdict_sql('documents', 'doc_id, source, lang')}) GROUP BY GROUPING SETS ((source, lang, quality_status), (source, quality_status), (lang, quality_status), (quality_status))""")
def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = q.verdict(texts(spark, sf_dir, "doc_id", "text", "source", "lang"))
    source, lang, status = F.col("source"), F.col("lang"), F.col("quality_status")
    sets = [[source, lang, status], [source, status], [lang, status], [status]]
    return judged.groupingSets(sets, source, lang, status).agg(F.count("*").alias("n"), F.sum(F.col("needs_ocr").cast("long")).alias("n_ocr"), F.bround(F.avg("quality_score"), 4).alias("mean_score"))


@register("quality_against_labels", f"""WITH j AS (SELECT v.quality_status = 'GOOD_TEXT_LAYER' AS said, l.quality = 1 AS want FROM ({verdict_sql('documents', 'doc_id')}) v JOIN labels l USING (doc_id)),
  c AS (SELECT count(*) FILTER (said AND want) AS tp, count(*) FILTER (said AND NOT want) AS fp, count(*) FILTER (NOT said AND want) AS fn FROM j),
  m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)
  SELECT tp, fp, fn, round_even(p, 6) AS precision_score, round_even(r, 6) AS recall_score, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM m""")
def quality_against_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = q.verdict(texts(spark, sf_dir, "doc_id", "text")).select("doc_id", "quality_status")
    both = judged.join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("quality_status") == q.GOOD).alias("said"), (F.col("quality") == 1).alias("want"))
    from ..functions.scores import precision_recall_f1

    return precision_recall_f1(both.agg(F.count_if(F.expr("said and want")).alias("tp"), F.count_if(F.expr("said and not want")).alias("fp"), F.count_if(F.expr("not said and want")).alias("fn")))


_REPORT = """SELECT source, count(*) AS pages, count(*) FILTER (needs_ocr) AS ocr_pages, CASE WHEN bool_and(NOT needs_ocr) THEN 'direct_text' WHEN bool_and(needs_ocr) THEN 'ocr_all' ELSE 'mixed' END AS routing,
  round_even(avg(quality_score / 100.0) FILTER (NOT needs_ocr), 6) AS mean_confidence, min(quality_score / 100.0) FILTER (NOT needs_ocr) AS min_confidence, max(quality_score / 100.0) FILTER (NOT needs_ocr) AS max_confidence FROM ({0}) GROUP BY source"""


@register("quality_report", _REPORT.format(verdict_sql("documents", "doc_id, source")))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = q.verdict(texts(spark, sf_dir, "doc_id", "text", "source"))
    sure = F.when(~F.col("needs_ocr"), F.col("quality_score") / 100.0)
    routing = F.when(F.bool_and(~F.col("needs_ocr")), "direct_text").when(F.bool_and("needs_ocr"), "ocr_all").otherwise("mixed")
    return judged.groupBy("source").agg(F.count("*").alias("pages"), F.count_if("needs_ocr").alias("ocr_pages"), routing.alias("routing"), F.bround(F.avg(sure), 6).alias("mean_confidence"), F.min(sure).alias("min_confidence"), F.max(sure).alias("max_confidence"))


@register("corpus_confidence", f"""SELECT sum(pages)::BIGINT AS pages, sum(ocr_pages)::BIGINT AS ocr_pages, round_even(sum(m * k) / sum(k), 6) AS mean_confidence, min(lo) AS min_confidence, max(hi) AS max_confidence FROM
  (SELECT source, count(*) AS pages, count(*) FILTER (needs_ocr) AS ocr_pages, avg(quality_score / 100.0) AS m, count(*) AS k, min(quality_score / 100.0) AS lo, max(quality_score / 100.0) AS hi FROM ({verdict_sql('documents', 'doc_id, source')}) GROUP BY source)""")
def corpus_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count-weighted mean of the sources' means, least of the least and largest of the largest."""
    c = F.col("quality_score") / 100.0
    per = q.verdict(texts(spark, sf_dir, "doc_id", "text", "source")).groupBy("source").agg(F.count("*").alias("k"), F.count_if("needs_ocr").alias("o"), F.avg(c).alias("m"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    return per.agg(F.sum("k").alias("pages"), F.sum("o").alias("ocr_pages"), F.bround(F.sum(F.col("m") * F.col("k")) / F.sum("k"), 6).alias("mean_confidence"), F.min("lo").alias("min_confidence"), F.max("hi").alias("max_confidence"))
