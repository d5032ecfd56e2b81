"""Noise, readable text, structure and lineage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import intervals as iv
from ..sources.tables import table, values, texts

# Thresholds and reason codes of OCR noise.
RUN, RUN_STRONG, RUN_NON_STRUCTURAL = 5, 12, 3
STRUCTURAL = r"|+=\-_.:/"


def tokens(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Runs of non-space characters with code-point offsets: adds token, s, e, ordinal.

    Texts are cut at single spaces, so that offsets are running sums of lengths; empty pieces and line breaks fall out.
    """
    flat = df.select(*keys, F.posexplode(F.split(F.translate(text, "\n\t\r", "   "), " ")).alias("i", "token"))
    order = Window.partitionBy(*keys).orderBy("i")
    start = F.coalesce(F.sum(F.length("token") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = flat.withColumn("s", start).withColumn("e", F.col("s") + F.length("token")).where("token != ''")
    return placed.withColumn("ordinal", F.row_number().over(order))


_FLAT = "(SELECT {k}, i, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY {k} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM (SELECT {k}, unnest(string_split(translate({t}, chr(10) || chr(9) || chr(13), '   '), ' ')) AS token, generate_subscripts(string_split(translate({t}, chr(10) || chr(9) || chr(13), '   '), ' '), 1) AS i FROM {src}))"
_TOKENS = f"(SELECT *, s + length(token) AS e FROM {_FLAT.format(k='doc_id', t='text', src='documents')} WHERE token != '')"


@register("token_spans", f"SELECT doc_id, count(*) AS n, sum(s)::BIGINT AS sum_s, sum(e)::BIGINT AS sum_e, max(e)::BIGINT AS last_e FROM {_TOKENS} GROUP BY doc_id")
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens(texts(spark, sf_dir, "doc_id", "text"), ["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("s").alias("sum_s"), F.sum("e").alias("sum_e"), F.max("e").alias("last_e"))


_RUNS = "unnest(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]{5,}'))"


@register("noise_symbol_runs", f"SELECT doc_id, run, CASE WHEN length(run) >= 12 THEN 'non_text_artifact' ELSE 'low_information_symbol_run' END AS noise_type, CASE WHEN regexp_matches(run, '^(\\.+|-+|=+|_+|\\*+|#+|!+)$') THEN 'repeated_punctuation' ELSE 'symbol_run' END AS reason, count(*) AS n FROM (SELECT doc_id, {_RUNS} AS run FROM documents) WHERE length(regexp_replace(run, '[|+=\\-_.:/]', '', 'g')) >= 3 GROUP BY ALL")
def noise_symbol_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(rf"[^\p{{L}}\p{{N}}\s]{{{RUN},}}"), F.lit(0))).alias("run"))
    kept = runs.where(F.length(F.regexp_replace("run", f"[{STRUCTURAL}]", "")) >= RUN_NON_STRUCTURAL)
    kind = F.when(F.length("run") >= RUN_STRONG, "non_text_artifact").otherwise("low_information_symbol_run")
    reason = F.when(F.col("run").rlike(r"^(\.+|-+|=+|_+|\*+|#+|!+)$"), "repeated_punctuation").otherwise("symbol_run")
    return kept.groupBy("doc_id", "run", kind.alias("noise_type"), reason.alias("reason")).agg(F.count("*").alias("n"))


# Written for both engines: {m} is the regular expression test, {r} a replacement of all matches, {c} a count of matches.
_SHAPE = """CASE WHEN length(token) < 4 OR {m}(token, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,}$') OR {m}(token, '^([0-9]+|[A-Za-z]+)([-_./:]([0-9]+|[A-Za-z]+))+$') OR {m}(token, '^[|+=_.:/-]+$') THEN NULL
  WHEN length({r}(token, '[\\p{L}\\p{N}]', ''{g})) > 0.5 * length(token) THEN 'high_symbol_ratio'
  WHEN {m}(token, '\\p{L}') AND length({r}(token, '[^\\p{L}]', ''{g})) < 0.3 * length(token) THEN 'low_letter_ratio'
  WHEN length(token) >= 3 AND ({m}(token, '[oO][0-9]*0|0[0-9]*[oO]') OR ({m}(token, '[iIl][0-9]*1|1[0-9]*[iIl]') AND {m}(token, '[0-9]'))) THEN 'character_confusion'
  WHEN length(token) <= 6 AND {m}(token, 'rn') AND {m}(token, '[0-9]') THEN 'character_confusion'
  WHEN {m}(token, '^\\p{L}{10,}$') AND {m}(token, '^\\p{Lu}?\\p{Ll}{3,}\\p{Lu}\\p{Ll}{3,}$') THEN 'joined_words' END"""


def _shape(match: str, replace: str, flag: str) -> str:
    return _SHAPE.replace("{m}", match).replace("{r}", replace).replace("{g}", flag)


@register("noise_token_shapes", f"SELECT doc_id, reason, count(*) AS n FROM (SELECT doc_id, {_shape('regexp_matches', 'regexp_replace', ', ' + chr(39) + 'g' + chr(39))} AS reason FROM {_TOKENS}) WHERE reason IS NOT NULL GROUP BY ALL")
def noise_token_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("token"))
    reason = F.expr(_shape("regexp_like", "regexp_replace", "").replace("\\", "\\\\"))
    return words.select("doc_id", reason.alias("reason")).where("reason is not null").groupBy("doc_id", "reason").agg(F.count("*").alias("n"))


_NOISE = f"(SELECT *, regexp_matches(token, '[0-9]') AND regexp_matches(token, '\\p{{L}}') AS bad FROM {_TOKENS})"


@register("noise_summary", f"SELECT doc_id, sum(CASE WHEN bad THEN e - s ELSE 0 END)::BIGINT AS suspicious, sum(e - s)::BIGINT AS non_space, round_even(least(1.0, sum(CASE WHEN bad THEN e - s ELSE 0 END) / sum(e - s)), 6) AS noise_ratio FROM {_NOISE} GROUP BY doc_id")
def noise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters under suspicion over characters that are not white space."""
    found = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("token"))
    bad = F.col("token").rlike("[0-9]") & F.col("token").rlike(r"\p{L}")
    n = F.length("token")
    suspicious, whole = F.sum(F.when(bad, n).otherwise(0)), F.sum(n)
    return found.groupBy("doc_id").agg(suspicious.alias("suspicious"), whole.alias("non_space"), F.bround(F.least(F.lit(1.0), suspicious / whole), 6).alias("noise_ratio"))


@register("spaced_letters", f"SELECT doc_id, count(*) AS runs, max(n) AS longest, count(*) FILTER (n >= 5) AS split_words FROM (SELECT doc_id, grp, count(*) AS n FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM {_TOKENS} WHERE regexp_matches(token, '^\\p{{L}}$')) GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc_id")
def spaced_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of single letters: gaps and islands over token places."""
    singles = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(F.split(F.translate("text", "\n\t\r", "   "), " ")).alias("i", "token")).where(F.col("token").rlike(r"^\p{L}$"))
    group = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    runs = singles.withColumn("grp", group).groupBy("doc_id", "grp").agg(F.count("*").alias("n")).where("n >= 2")
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"), F.count_if(F.col("n") >= 5).alias("split_words"))


def readable(text):
    """Lines trimmed and squeezed, words rejoined at hyphens, lines joined into paragraphs, blank lines between them."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    clean = F.regexp_replace(clean, "(?m)^ | $", "")
    clean = F.regexp_replace(clean, r"([A-Za-zÀ-ÿ]{2})-\n([A-Za-zÀ-ÿ])", "$1$2")
    blocks = F.transform(F.split(clean, "\n\n+"), lambda b: F.trim(F.regexp_replace(b, "\n", " ")))
    return F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n")


_READ = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '([A-Za-zÀ-ÿ]{{2}})-\\n([A-Za-zÀ-ÿ])', '\\1\\2', 'g')"
_BLOCKS = f"array_to_string(list_filter(list_transform(regexp_split_to_array({_READ.format('text')}, '\\n\\n+'), lambda b: trim(replace(b, chr(10), ' '))), lambda b: b != ''), chr(10) || chr(10))"


@register("readable_text", f"SELECT doc_id, md5(v) AS digest, length(v)::BIGINT AS n FROM (SELECT doc_id, {_BLOCKS} AS v FROM documents)")
def readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = texts(spark, sf_dir, "doc_id", "text").select("doc_id", readable(F.col("text")).alias("v"))
    return v.select("doc_id", F.md5(F.col("v").cast("binary")).alias("digest"), F.length("v").cast("long").alias("n"))


@register("layout_text_markers", "SELECT conv_id, md5(string_agg('----- page ' || (turn + 1) || ' -----' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS pages FROM conversations GROUP BY conv_id")
def layout_text_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("----- page "), (F.col("turn") + 1).cast("string"), F.lit(" -----\n"), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"])
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(parts, "\n\n").cast("binary")).alias("digest"), F.count("*").alias("pages"))


_LINES = "(SELECT doc_id, i, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return flat.select("doc_id", (F.col("i") + 1).alias("i"), F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line"))


@register("repeated_margins", "SELECT conv_id, line, count(DISTINCT turn) AS pages, min(turn) AS first_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS up, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) AS down FROM (SELECT conv_id, turn, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS line, i FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS line, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS i FROM conversations)) WHERE line != '') WHERE up <= 3 OR down <= 3 GROUP BY conv_id, line HAVING count(DISTINCT turn) >= 2")
def repeated_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand among the first or last three of two pages or more."""
    flat = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"[.!?\n]")).alias("i", "raw"))
    flat = flat.select("conv_id", "turn", "i", F.lower(F.trim(F.regexp_replace("raw", r"\s+", " "))).alias("line")).where("line != ''")
    page = Window.partitionBy("conv_id", "turn")
    ranked = flat.withColumn("up", F.row_number().over(page.orderBy("i"))).withColumn("down", F.row_number().over(page.orderBy(F.desc("i"))))
    return ranked.where("up <= 3 or down <= 3").groupBy("conv_id", "line").agg(F.countDistinct("turn").alias("pages"), F.min("turn").alias("first_turn")).where("pages >= 2")


@register("supplement_antijoin", f"SELECT doc_id, count(*) AS kept, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM {_LINES} l WHERE line != '' AND NOT EXISTS (SELECT 1 FROM (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM benchmark) b WHERE b.k = lower(l.line)) GROUP BY doc_id")
def supplement_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not among the known ones, in their order."""
    own = lines(spark, sf_dir).where("line != ''").withColumn("k", F.lower("line"))
    known = table(spark, sf_dir, "benchmark").select(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("k")).distinct()
    kept = own.join(known, "k", "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.md5(text.cast("binary")).alias("digest"))


@register("repeated_lines", f"SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM {_LINES} WHERE line != '' GROUP BY line HAVING count(*) > 1")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("line != ''").groupBy("line").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).where("n > 1")


@register("pipe_tables", f"SELECT doc_id, min(i)::BIGINT AS first_line, count(*) AS n_rows, max(cells)::BIGINT AS max_cells, min(cells) != max(cells) AS partial FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM (SELECT doc_id, i, len(string_split(line, '|')) AS cells FROM {_LINES} WHERE line LIKE '%|%')) GROUP BY doc_id, grp")
def pipe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of delimited lines as tables."""
    rows = lines(spark, sf_dir).where(F.col("line").contains("|")).withColumn("cells", F.size(F.split("line", r"\|")))
    grp = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return rows.withColumn("grp", grp).groupBy("doc_id", "grp").agg(F.min("i").cast("long").alias("first_line"), F.count("*").alias("n_rows"), F.max("cells").cast("long").alias("max_cells"), (F.min("cells") != F.max("cells")).alias("partial")).drop("grp")


_FORM = "(1, 1, 'Kunde: Maria Muster'), (1, 2, 'Betrag - 12,50'), (1, 3, 'ANGEBOT'), (1, 4, 'Datum:'), (1, 5, '01.02.2020'), (1, 6, 'Ein ganzer Satz ohne Feld'), (2, 1, 'Rechnung Nr: 17'), (2, 2, 'SUMMEN'), (2, 3, 'Pos; Menge; Preis')"


@register("inline_fields", f"SELECT doc, i, label, value, method FROM (SELECT doc, i, CASE WHEN regexp_matches(line, '^[^:]+: \\S') THEN trim(split_part(line, ':', 1)) WHEN regexp_matches(line, '^[^:]+:$') THEN trim(split_part(line, ':', 1)) WHEN regexp_matches(line, '^\\p{{L}}+ - \\S') THEN trim(split_part(line, ' - ', 1)) END AS label, CASE WHEN regexp_matches(line, '^[^:]+: \\S') THEN trim(split_part(line, ':', 2)) WHEN regexp_matches(line, '^[^:]+:$') THEN nxt WHEN regexp_matches(line, '^\\p{{L}}+ - \\S') THEN trim(split_part(line, ' - ', 2)) END AS value, CASE WHEN regexp_matches(line, '^[^:]+: \\S') THEN 'colon' WHEN regexp_matches(line, '^[^:]+:$') THEN 'next_line' ELSE 'dash' END AS method FROM (SELECT *, lead(line) OVER (PARTITION BY doc ORDER BY i) AS nxt FROM (VALUES {_FORM}) t(doc, i, line))) WHERE label IS NOT NULL AND value IS NOT NULL")
def inline_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and value on one line, or the value on the next."""
    form = values(spark, _FORM, "doc, i, line").withColumn("nxt", F.lead("line").over(Window.partitionBy("doc").orderBy("i")))
    line = F.col("line")
    colon, below, dash = line.rlike(r"^[^:]+: \S"), line.rlike(r"^[^:]+:$"), line.rlike(r"^\p{L}+ - \S")
    label = F.when(colon | below, F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).when(dash, F.trim(F.split_part(line, F.lit(" - "), F.lit(1))))
    value = F.when(colon, F.trim(F.split_part(line, F.lit(":"), F.lit(2)))).when(below, F.col("nxt")).when(dash, F.trim(F.split_part(line, F.lit(" - "), F.lit(2))))
    return form.select("doc", "i", label.alias("label"), value.alias("value"), F.when(colon, "colon").when(below, "next_line").otherwise("dash").alias("method")).where("label is not null and value is not null")


_HEAD = "length(line) <= 80 AND len(string_split(line, ' ')) <= 8 AND NOT regexp_matches(line, '[0-9:|;]') AND line != '' AND regexp_matches(line, '^\\p{Lu}[\\p{L} .]*$')"


@register("headings_sections", f"SELECT doc_id, i::BIGINT AS heading_line, (coalesce(nxt, last + 1) - i - 1)::BIGINT AS body_lines FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt, max(last) OVER (PARTITION BY doc_id) AS last FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM {_LINES}) WHERE {_HEAD})")
def headings_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading owns the lines up to the next heading."""
    own = lines(spark, sf_dir).withColumn("last", F.max("i").over(Window.partitionBy("doc_id")))
    line = F.col("line")
    heading = (F.length(line) <= 80) & (F.size(F.split(line, " ")) <= 8) & ~line.rlike("[0-9:|;]") & (line != "") & line.rlike(r"^\p{Lu}[\p{L} .]*$")
    nxt = F.lead("i").over(Window.partitionBy("doc_id").orderBy("i"))
    return own.where(heading).withColumn("nxt", nxt).select("doc_id", F.col("i").cast("long").alias("heading_line"), (F.coalesce("nxt", F.col("last") + 1) - F.col("i") - 1).cast("long").alias("body_lines"))


_READING = f"(SELECT *, s + length(token) AS e FROM {_FLAT.format(k='doc_id', t='v', src='(SELECT doc_id, lower(text) AS v FROM documents)')} WHERE token != '')"


@register("unique_token_map", f"SELECT r.doc_id, count(*) AS mapped, sum(r.e - r.s)::BIGINT AS chars, sum(w.s)::BIGINT AS sum_reading FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, lower(token)) AS n FROM {_TOKENS}) r JOIN (SELECT *, count(*) OVER (PARTITION BY doc_id, token) AS n FROM {_READING}) w ON r.doc_id = w.doc_id AND lower(r.token) = w.token AND r.n = 1 AND w.n = 1 GROUP BY r.doc_id")
def unique_token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that occur once on both sides map raw text onto reading text."""
    docs = table(spark, sf_dir, "documents")
    once = lambda df: df.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "k"))).where("n = 1").drop("n")
    raw = once(tokens(docs.select("doc_id", "text"), ["doc_id"]).withColumn("k", F.lower("token")))
    reading = once(tokens(docs.select("doc_id", F.lower("text").alias("text")), ["doc_id"]).withColumn("k", F.col("token")).select("doc_id", "k", F.col("s").alias("rs")))
    return raw.join(reading, ["doc_id", "k"]).groupBy("doc_id").agg(F.count("*").alias("mapped"), F.sum(F.col("e") - F.col("s")).alias("chars"), F.sum("rs").alias("sum_reading"))


@register("unique_line_projection", f"SELECT a.doc_id, count(*) FILTER (a.n = 1 AND b.n = 1) AS exact, count(*) FILTER (a.n > 1 OR b.n > 1) AS ambiguous, count(*) FILTER (b.n IS NULL) AS missing FROM (SELECT doc_id, line, count(*) AS n FROM {_LINES} WHERE line != '' GROUP BY ALL) a LEFT JOIN (SELECT doc_id, trim(regexp_replace(line, '[a-z]?,', ',', 'g')) AS line, count(*) AS n FROM {_LINES} WHERE line != '' GROUP BY ALL) b USING (doc_id, line) GROUP BY a.doc_id")
def unique_line_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand once on both sides project exactly; others are ambiguous or missing, never guessed. The other
    side lost the letter before each comma."""
    own = lines(spark, sf_dir).where("line != ''")
    a = own.groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    b = own.withColumn("line", F.trim(F.regexp_replace("line", "[a-z]?,", ","))).groupBy("doc_id", "line").agg(F.count("*").alias("m"))
    j = a.join(b, ["doc_id", "line"], "left")
    return j.groupBy("doc_id").agg(F.count_if(F.expr("n = 1 and m = 1")).alias("exact"), F.count_if(F.expr("n > 1 or m > 1")).alias("ambiguous"), F.count_if(F.col("m").isNull()).alias("missing"))


@register("lineage_coverage", f"SELECT doc_id, sum(e - s)::BIGINT AS covered, round_even(sum(e - s) / max(n), 6) AS coverage FROM (SELECT t.doc_id, t.s, t.e, length(d.text) AS n FROM {_TOKENS} t JOIN documents d USING (doc_id) WHERE length(t.token) > 3) GROUP BY doc_id")
def lineage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a text that attributed ranges cover."""
    docs = texts(spark, sf_dir, "doc_id", "text")
    spans = tokens(docs, ["doc_id"]).where("length(token) > 3")
    covered = iv.union(spans.select("doc_id", "s", "e"), ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    return covered.join(docs.select("doc_id", F.length("text").alias("n")), "doc_id").select("doc_id", "covered", F.bround(F.col("covered") / F.col("n"), 6).alias("coverage"))


_CHARS = "(SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split({t}, '')) AS c FROM documents) WHERE c NOT IN (' ', chr(10)) GROUP BY ALL)"


_WITHOUT_E = "replace(text, chr(101), '')"


@register("char_coverage", f"SELECT r.doc_id, bool_and(coalesce(s.n, 0) >= r.n) AS covered, count(*) FILTER (coalesce(s.n, 0) < r.n) AS short FROM {_CHARS.format(t='text')} r LEFT JOIN {_CHARS.format(t=_WITHOUT_E)} s USING (doc_id, c) GROUP BY r.doc_id")
def char_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source holds every character of the raw text at least as often."""
    docs = table(spark, sf_dir, "documents")
    count = lambda t, n: docs.select("doc_id", F.explode(F.split(t, "")).alias("c")).where("c not in (' ', '\\n', '')").groupBy("doc_id", "c").agg(F.count("*").alias(n))
    j = count(F.col("text"), "n").join(count(F.replace("text", F.lit("e")), "m"), ["doc_id", "c"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return j.groupBy("doc_id").agg(F.bool_and(F.col("m") >= F.col("n")).alias("covered"), F.count_if(F.col("m") < F.col("n")).alias("short"))


@register("page_text", "SELECT page_id, md5(v) AS digest, length(v)::BIGINT AS n FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS v FROM pages)")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", F.md5(F.col("v").cast("binary")).alias("digest"), F.length("v").cast("long").alias("n"))


_FILES = "('Rechnung (1).pdf', 10), ('Rechnung.pdf', 10), (' Angebot - Kopie.docx', 20), ('scan.PNG', 0), ('notes.txt', 5), ('..hidden.pdf', 7), ('a/b/c.jpg', 9)"
_STRIP = "trim(regexp_replace({0}, '( - Kopie|\\s*\\([0-9]+\\))(\\.[A-Za-z]+)$', '{1}2'))"


@register("upload_checks", f"SELECT name, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS extension, CASE WHEN lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) NOT IN ('pdf', 'docx', 'png', 'jpg', 'jpeg') THEN 415 WHEN size = 0 THEN 400 ELSE 202 END AS status, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '^\\.+', '') AS display_name, {_STRIP.format('name', chr(92))} AS match_name FROM (VALUES {_FILES}) t(name, size)")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension whitelist, emptiness, display name and the name without a copy suffix."""
    f = values(spark, _FILES, "name, size")
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    status = F.when(~ext.isin("pdf", "docx", "png", "jpg", "jpeg"), 415).when(F.col("size") == 0, 400).otherwise(202)
    shown = F.regexp_replace(F.regexp_extract("name", "([^/]*)$", 1), r"^\.+", "")
    return f.select("name", ext.alias("extension"), status.alias("status"), shown.alias("display_name"), F.trim(F.regexp_replace("name", r"( - Kopie|\s*\([0-9]+\))(\.[A-Za-z]+)$", "$2")).alias("match_name"))
