"""Operators against plain Python, on random and literal cases."""

import random
import time
import zipfile
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import anchors, quality, recognizers
from lodestone.operators import intervals as iv
from lodestone.operators import layout
from lodestone.operators.latest import first_rank, latest
from lodestone.plans import spans as sp
from lodestone.sources import files
from lodestone.streaming import logs as st


def random_spans(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randint(0, 900)
        rows.append((i, i % 4, "ab"[i % 2], s, s + rng.randint(1, 400 if i % 9 == 0 else 30), rng.random(), f"r{i % 3}"))
    return rows


SPANS = "id long, doc long, type string, s long, e long, score double, recognizer string"


def test_overlap_pairs(spark):
    a, b = random_spans(1), random_spans(2)
    left = spark.createDataFrame(a, SPANS).select("id", "doc", "s", "e")
    right = spark.createDataFrame(b, SPANS).select(F.col("id").alias("id2"), "doc", F.col("s").alias("s2"), F.col("e").alias("e2"))
    got = sorted((r.id, r.id2) for r in iv.overlap_pairs(left, right, ["doc"]).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[3] < y[4] and y[3] < x[4])


def test_union_and_gaps(spark):
    rows = random_spans(3, 60)
    df = spark.createDataFrame(rows, SPANS)
    covered = {(r.doc, i) for r in iv.union(df, ["doc"]).collect() for i in range(r.s, r.e)}
    assert covered == {(x[1], i) for x in rows for i in range(x[3], x[4])}
    gaps = {(r.doc, i) for r in iv.gaps(df, ["doc"]).collect() for i in range(r.gap_start, r.gap_end)}
    for doc in range(4):
        own = [x for x in rows if x[1] == doc]
        whole = set(range(min(x[3] for x in own), max(x[4] for x in own)))
        assert {i for d, i in gaps if d == doc} == whole - {i for d, i in covered if d == doc}


def test_containment_equals_the_greedy_rule(spark):
    rows = [(i, d, t, s, e, q, r) for i, d, t, s, e, q, r in random_spans(4)]
    df = spark.createDataFrame(rows, SPANS)
    got = {(r.doc, r.type, r.s, r.e) for r in sp.same_type_kept(df).collect()}
    left = sorted({(d, t, s, e) for _, d, t, s, e, _, _ in rows}, key=lambda x: (-(x[3] - x[2]), x))
    kept = []
    for x in left:  # strongest first; only spans strictly inside a longer one go
        if not any(k[:2] == x[:2] and k[2] <= x[2] and x[3] <= k[3] and k[3] - k[2] > x[3] - x[2] for k in kept):
            kept.append(x)
    assert got == set(kept)


def test_segments_cover_what_spans_cover(spark):
    rows = random_spans(5, 80)
    out = iv.segments(spark.createDataFrame(rows, SPANS), ["doc"], [F.col("score").desc(), F.col("id")]).collect()
    at = {(r.doc, i): (r.top_id, r.members) for r in out for i in range(r.seg_start, r.seg_end)}
    want = {}
    for x in rows:
        for i in range(x[3], x[4]):
            want.setdefault((x[1], i), []).append(x)
    assert at == {k: (max(v, key=lambda x: (x[5], -x[0]))[0], len(v)) for k, v in want.items()}


def test_greedy_match(spark):
    truth = spark.createDataFrame([(1, 1, "t", 0, 10), (2, 1, "t", 5, 15), (3, 1, "t", 100, 110), (4, 2, "t", 0, 5)], "gid long, doc long, type string, gs long, ge long")
    found = spark.createDataFrame([(11, 1, "t", 4, 12), (12, 1, "t", 0, 9), (13, 1, "t", 109, 119), (14, 1, "u", 0, 5)], "id long, doc long, type string, s long, e long")
    assert {r.gid: r.id for r in sp.greedy_match(truth, found).collect()} == {1: 12, 2: 11, 3: 13, 4: None}


def test_latest_and_rank(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c"), (1, 2, "z")], "k long, t long, v string")
    assert {(r.k, r.v) for r in latest(df, ["k"], ["t", "v"]).collect()} == {(1, "z"), (2, "c")}
    assert first_rank(df, ["k"], [F.desc("t"), "v"], 2).count() == 3


@pytest.mark.parametrize(("text", "status", "reasons"), [("", "EMPTY_TEXT_LAYER", ["empty_text_layer"]), (None, "EMPTY_TEXT_LAYER", ["empty_text_layer"]), ("Invoice no 42", "LOW_CONFIDENCE_TEXT_LAYER", ["sparse_text"]), ("�" * 40 + " ein zwei drei", "BROKEN_TEXT_LAYER", None), ("12#4 " * 20, "BROKEN_TEXT_LAYER", ["very_low_letter_ratio", "high_symbol_or_digit_ratio", "few_word_tokens"]), ("Dies ist eine gut lesbare Zeile mit vielen ganz normalen Worten darin", "GOOD_TEXT_LAYER", [])])
def test_quality(spark, text, status, reasons):
    r = quality.verdict(spark.createDataFrame([(text,)], "text string")).first()
    assert r.quality_status == status and (reasons is None or r.reasons == reasons)


def test_labelled_recognizers(spark):
    found = {(r.page, r.entity_type, r.match) for r in catalog.queries()["detect_labelled"](spark, "").collect()}
    assert {(1, "SVNR_AT", "1234 010180"), (2, "LICENSE_PLATE_AT", "W-12345X"), (3, "BIRTH_DATE", "01.02.1980"), (5, "ADDRESS", "Musterstraße 12/3, 8010 Graz"), (6, "CUSTOMER_LINE", "Maria Muster"), (8, "BIRTH_PLACE", "Bad Ischl"), (9, "PASSPORT_NUMBER", "P1234567")} <= found
    assert not any(p == 7 for p, _, _ in found)


def test_detection_offsets_are_code_points(spark):
    text = "😀 mail a.b@c.example.at und +43 316 123456, IBAN AT611904300234573201"
    df = spark.createDataFrame([(1, text), (2, None)], "doc long, text string")
    rows = recognizers.detect(df, ["doc"]).collect()
    assert {"EMAIL_ADDRESS", "PHONE_NUMBER", "IBAN_CODE"} <= {r.entity_type for r in rows}
    assert all(text[r.s : r.e] == r.match for r in rows)


def test_anchor_tokens():
    kinds = lambda t: [(k, t[s:e]) for k, s, e in anchors.tokenize(t)]
    assert kinds("a@b.at +43 316 123456 AB-12 Haus 12,50 !") == [("email", "a@b.at"), ("phone", "+43 316 123456"), ("identifier", "AB-12"), ("word", "Haus"), ("number", "12,50"), ("symbol", "!")]
    assert kinds("well-known 12345 A1B2C3") == [("word", "well"), ("symbol", "-"), ("word", "known"), ("number", "12345"), ("identifier", "A1B2C3")]


def test_binding(spark):
    x = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 3, 12), (3, 1, 50, 60), (4, 2, 0, 9)], "id long, doc long, s long, e long")
    t = spark.createDataFrame([(1, 0, 4), (1, 5, 10), (1, 11, 14), (2, 0, 5), (2, 3, 8)], "doc long, s2 long, e2 long")
    assert {r.id: (r.binding, r.n_tokens) for r in anchors.bind(x, t, ["doc"]).collect()} == {1: ("exact", 2), 2: ("partial", 3), 3: ("missing", 0), 4: ("ambiguous", 2)}


def test_layout(spark):
    rows = [(1, "Title", 0.1, 0.2, 0.5, 0.23, 20.0), (1, "left", 0.1, 0.5, 0.2, 0.52, 10.0), (1, "right", 0.5, 0.501, 0.6, 0.521, 10.0), (1, "below", 0.1, 0.53, 0.2, 0.55, 10.0), (1, "foot", 0.1, 0.95, 0.2, 0.97, 10.0)]
    f = spark.createDataFrame(rows, "page long, text string, x0 double, y0 double, x1 double, y1 double, font_size double")
    assert {r.text: r.line for r in layout.lines(f, ["page"]).collect()} == {"Title": 0, "left": 1, "right": 1, "below": 2, "foot": 3}
    got = [(r.block_type, r.text) for r in layout.blocks(f, ["page"]).orderBy("band").collect()]
    assert got == [("heading", "Title"), ("body", "left right\nbelow"), ("footer", "foot")]
    assert layout.reading_text(f, ["page"]).first().reading_text == "Title\nleft right\nbelow\nfoot"


def test_uploads_and_docx(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('eins')}{table}{p('zwei')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {ns}>{p('kopf')}</w:hdr>")
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "bad.pdf").write_bytes(b"MZ")
    (tmp_path / "none.png").write_bytes(b"")
    (tmp_path / "n.txt").write_bytes(b"x")
    up = files.read_uploads(spark, str(tmp_path))
    assert {r.display_name: r.status for r in up.collect()} == {"x.docx": 202, "ok.pdf": 202, "bad.pdf": 415, "n.txt": 415}
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in files.read_docx(up).collect()}
    assert texts["x.docx"] == "kopf\neins\na\tb\nzwei" and texts["n.txt"] is None


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1, "d": "keep"}\n\n{"id": 2, "d": "x"}\n{torn')
    schema = spark.createDataFrame([], "id long, d string").schema
    assert files.read_log(spark, str(tmp_path), schema, strict=False).count() == 2
    with pytest.raises(Exception, match="bad log line"):
        files.read_log(spark, str(tmp_path), schema, strict=True).collect()


def test_reports_carry_no_text(spark, tmp_path):
    df = spark.createDataFrame([(1, ("x", 2))], "n long, s struct<text: string, k: int>")
    assert files.forbidden_fields(df.schema) == ["$.s.text"]
    with pytest.raises(ValueError):
        files.write_report(df, str(tmp_path / "r"))
    files.write_report(df.select("n"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "json")).first().n == 1 and files.markdown(df.select("n")).endswith("| 1 |\n")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, df, mode in (("fold", st.latest_stream(stream, ["user_id", "event_type"], ["ts", "event_id"]), "complete"), ("hours", st.windowed_counts(stream, late="60 days"), "complete"), ("alive", st.without_tombstones(stream, events.where("user_id = 1"), "user_id"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = latest(events, ["user_id", "event_type"], ["ts", "event_id"])
    assert sorted(map(str, spark.table("fold").select("user_id", "event_type", "event_id").collect())) == sorted(map(str, want.select("user_id", "event_type", "event_id").collect()))
    assert spark.table("hours").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("alive").count() == events.where("user_id != 1").count()


def test_job_recovery(spark):
    jobs = spark.sql("select * from values (1, 'running', timestamp'2024-01-01 00:00:00', 1), (2, 'running', timestamp'2024-01-01 00:00:00', 3), (3, 'pending', null, 0), (4, 'running', timestamp'2024-01-01 10:00:00', 1) as t(id, status, leased_at, attempts)")
    out = {r.id: (r.status, r.error) for r in st.recover(jobs, F.lit("2024-01-01 10:30:00").cast("timestamp"), 3600, 3).collect()}
    assert out == {1: ("pending", None), 2: ("failed", "interrupted"), 3: ("pending", None), 4: ("running", None)}


def test_line_stretches(spark):
    from lodestone.plans import ordering

    rows = [(1, "a" * 700 + "\n" + "b" * 700 + "\n"), (2, "x" * 3000 + "\nshort\n"), (3, ""), (4, None), (5, "\r\n".join(f"line {i}" for i in range(500)))]
    out = ordering.stretches(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    for k, text in rows:
        own = sorted((r.start, r.stretch) for r in out if r.id == k)
        assert "".join(t for _, t in own) == (text or "") and [s for s, _ in own] == [sum(len(t) for _, t in own[:i]) for i in range(len(own))]
        assert all(len(t) <= 1200 or len(t.splitlines()) == 1 for _, t in own) and all(len(a) + len(b.splitlines(keepends=True)[0]) > 1200 for (_, a), (_, b) in zip(own, own[1:], strict=False))


def test_domain_identifiers(spark):
    """Prefixes in any case, as many segments as the type takes, and labels before identifiers without a prefix."""
    from lodestone.functions import recognizers as r

    texts = ["pol-2024-17 and POL-9", "Sch/1/2", "Polizzennummer: A123", "polizzennr.: 77-b", "user-ab.c@x", "Projekt Alpha", "Projekt: 12/34", "GUT-1-2-3-4-5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(x.id, x.entity_type, x.match) for x in r.detect(df, ["id"], types=list(r.PREFIXES)).collect()}
    assert got == {(0, "POLICY_NUMBER", "pol-2024-17"), (1, "CLAIM_NUMBER", "Sch/1/2"), (2, "POLICY_NUMBER", "A123"), (3, "POLICY_NUMBER", "77-b"), (4, "USER_ID", "user-ab.c@x"), (6, "PROJECT_ID", "12/34"), (7, "ASSESSMENT_NUMBER", "GUT-1-2-3-4-5")}
    strong = df.select("id", F.explode(r.matches(F.col("text"))).alias("x")).select("id", "x.entity_type", "x.match")
    assert {tuple(x) for x in strong.collect()} == {x for x in got if x[0] in (0, 1, 4, 7)}


#: Borders beside letters that are not ASCII, letters that fold to ASCII ones, and the matches that the SQL finds.
BORDERS = [
    ("äFN 123 a, FN 12 bä", [("FN_AT", "FN 12 b"), ("FN_AT", "FN 123 a")]),
    ("éVER-1 VER-2é ①VER-3", [("CONTRACT_NUMBER", "VER-1"), ("CONTRACT_NUMBER", "VER-2"), ("CONTRACT_NUMBER", "VER-3")]),
    ("\u017fCH-1 x\u017fCH-12 POL-1-2\u017f \u212aD-5 x\u212aD-6/9 gut-\u01313", [("CLAIM_NUMBER", "\u017fCH-12"), ("CUSTOMER_NUMBER", "\u212aD-6/9"), ("POLICY_NUMBER", "POL-1-2")]),
    ("é1.2.3.4 üwww.graz.at ATU12345678ö", [("IP_ADDRESS", "1.2.3.4"), ("UID_AT", "ATU12345678"), ("URL", "www.graz.at")]),
]


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    """BORDERS under ids 0 to 3, then a repeated id, null ids and a null text."""
    rows = [(i, t, "a", "de") for i, (t, _) in enumerate(BORDERS)]
    rows += [(3, "RE-5 x@y.com", "b", None), (None, "RE-5 a@b.at", "a", "de"), (None, "RE-5 a@b.at", None, "de"), (9, None, "a", "de"), (10, "SB-1 \u00fcRE-5", "b", "at")]
    at = tmp_path_factory.mktemp("odd")
    names = ("doc_id", "text", "source", "lang")
    pq.write_table(pa.table(dict(zip(names, (list(c) for c in zip(*rows)))), pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in names[1:])])), at / "documents.parquet")
    return str(at)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def rows_of_sql(name, at):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS FROM '{at}/documents.parquet'")
        return Counter(c.execute(catalog.oracle_sql()[name]).fetchall())


def test_detect_entities_at_borders_and_folded_letters(spark, odd_documents):
    got = rows_of(catalog.queries()["detect_entities"](spark, odd_documents))
    for i, (_, want) in enumerate(BORDERS[:3]):
        assert sorted((r[1], r[2]) for r in got if r[0] == i) == want
    assert got == rows_of_sql("detect_entities", odd_documents)


def test_entities_across_documents_at_borders(spark, odd_documents):
    got = rows_of(catalog.queries()["entities_across_documents"](spark, odd_documents))
    assert ("INVOICE_NUMBER", 2) in {(r[1], r[2]) for r in got}  # RE-5 in 3 and, after a letter that is not ASCII, in 10
    assert got == rows_of_sql("entities_across_documents", odd_documents)


def test_entity_groups_at_borders(spark, odd_documents):
    got = rows_of(catalog.queries()["entity_groups"](spark, odd_documents))
    assert sorted((r[1], r[3]) for r in got if r[0] == 1) == [("CONTRACT_NUMBER", 1)] * 3
    assert got == rows_of_sql("entity_groups", odd_documents)


def test_detect_spans_with_repeated_and_null_ids(spark, odd_documents):
    got = rows_of(catalog.queries()["detect_spans"](spark, odd_documents))
    assert got[(None, "INVOICE_NUMBER", "RE-5", 2)] == 1
    assert got == rows_of_sql("detect_spans", odd_documents)


def test_spans_lie_where_they_say(spark, odd_documents):
    docs = spark.read.parquet(odd_documents + "/documents.parquet").where("doc_id < 3").withColumn("text", F.concat(F.lit("\U0001f600 ́"), "text"))
    found = recognizers.detect(docs, ["doc_id"]).join(docs, "doc_id")
    assert found.count() > 5 and not found.where("match != substring(text, s + 1, e - s)").count()


def test_entity_counts_with_odd_ids_and_without_matches(spark, odd_documents, tmp_path):
    counts = catalog.queries()["entity_counts"]
    assert rows_of(counts(spark, odd_documents)) == rows_of_sql("entity_counts", odd_documents)
    spark.read.parquet(odd_documents + "/documents.parquet").where("doc_id = 9").coalesce(1).write.parquet(str(tmp_path / "none"))
    next((tmp_path / "none").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows_of(counts(spark, str(tmp_path))) == rows_of_sql("entity_counts", str(tmp_path)) == Counter([(None, None, None, 0, 0)])


def test_anchors_pass_tokens_on_in_pieces(spark):
    n = 3 * 32768 + 5
    batch = pa.RecordBatch.from_pydict({"doc_id": [7, None, 8], "text": ["ab-1 " * n, None, "x"]})
    found = list(anchors.pieces(["doc_id"])(iter([batch])))
    assert [x.num_rows for x in found] == [32768] * 3 + [6]
    rows = pa.Table.from_batches(found).to_pylist()
    assert rows[n - 1 :] == [{"doc_id": d, "ordinal": o, "kind": k, "s": s, "e": s + len(t), "token": t} for d, o, k, s, t in ((7, n - 1, "identifier", 5 * n - 5, "ab-1"), (8, 0, "word", 0, "x"))]
    df = spark.createDataFrame([(7, "ab-1 " * n), (None, None), (8, "x")], "doc_id long, text string")
    assert anchors.anchors(df, ["doc_id"]).count() == n + 1


def documents_of(at, texts):
    at.mkdir()
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), at / "documents.parquet")
    return str(at)


def test_entities_across_documents_with_hosts_of_many_labels(spark, tmp_path):
    """Java's stack must not grow with the labels; what an e-mail address gives back stays as it was."""
    host = "ab." * 5000 + "de"
    texts = [f"x@{host}1.c. www.{host}/a RE-5", f"X@{host}1, www.{host}/a", "a@b.com1x@y.de a@b..com a@.b.com a@b.c a@b.co.1 a@-.de www.a..b", "1x@y.de a@b.com www.a.b www.a.b."]
    at = documents_of(tmp_path / "many", texts)
    got = rows_of(catalog.queries()["entities_across_documents"](spark, at))
    assert sorted((r[1], r[2]) for r in got) == [("EMAIL_ADDRESS", 2)] * 3 + [("URL", 2)]
    assert got == rows_of_sql("entities_across_documents", at)


def test_entity_groups_with_long_runs(spark, tmp_path):
    """Time in proportion to a run without an at sign; a square of it is minutes here."""
    run = "aB1.-" * 60000
    at = documents_of(tmp_path / "runs", [run, f"{run} x@y.de {run}", f"{run}@y.de1x@y.com.1-a@b.at", "a@b.com1x@y.de%@b.at\u00e9x@y.de x@y.d1 x@@y.de a@b@y.de"])
    began = time.monotonic()
    got = rows_of(catalog.queries()["entity_groups"](spark, at))
    assert time.monotonic() - began < 60
    assert sorted((r[0], r[1], r[3]) for r in got) == [(i, "EMAIL_ADDRESS", 1) for i in [1, *[2] * 3, *[3] * 5]]
    assert got == rows_of_sql("entity_groups", at)
