"""Sources and sinks beside Parquet: uploads, DOCX, JSON lines and reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# First bytes of the formats, by extension, and their media types.
SIGNATURES = {"pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "docx": "504B0304"}
MEDIA = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def signature_matches(ext: Column, content: Column) -> Column:
    """Unknown extensions pass; the whitelist turns them away."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.lit(True)
    for e, magic in SIGNATURES.items():
        found = F.when(ext == e, head.startswith(magic)).otherwise(found)
    return found


def read_uploads(spark: SparkSession, path: str, most: int = 50 << 20) -> DataFrame:
    """path, display_name, extension, media_type, size, sha256, status (202 accepted, 400, 413 or 415) and content.

    Spark does not list files of no bytes; the status 400 is for content that a caller brings along.
    """
    raw = spark.read.format("binaryFile").load(path)
    ext, size = extension(F.col("path")), F.length("content")
    status = F.when(~ext.isin(*SIGNATURES), 415).when(size == 0, 400).when(size > most, 413).when(~signature_matches(ext, F.col("content")), 415).otherwise(202)
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])[ext]
    return raw.select("path", display_name(F.col("path")).alias("display_name"), ext.alias("extension"), media.alias("media_type"), size.alias("size"), F.sha2("content", 256).alias("sha256"), status.alias("status"), "content")


def display_name(path: Column) -> Column:
    """Last part of the path without control characters, squeezed, without leading dots, 255 characters at most."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(name, r"\p{C}", ""), r"\s+", " "))
    name = F.substring(F.regexp_replace(name, r"^\.+", ""), 1, 255)
    return F.when(name == "", "upload").otherwise(name)


def verified(originals: DataFrame, metadata: DataFrame) -> DataFrame:
    """Originals whose hash is the stored one (409 otherwise); both have id and sha256."""
    stored = metadata.select("id", F.col("sha256").alias("stored"))
    return originals.join(stored, "id").withColumn("status", F.when(F.col("sha256") == F.col("stored"), 200).otherwise(409)).drop("stored")


def docx_text(content: bytes) -> str | None:
    """Headers, then paragraphs and tables of the body in order, then footers; None if it is no such file."""

    def paragraph(node) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(x.tag.removeprefix(_W), "") for x in node.iter())

    def body(root) -> Iterator[str]:
        for node in root:
            if node.tag == f"{_W}p":
                yield paragraph(node)
            elif node.tag == f"{_W}tbl":
                yield "\n".join("\t".join("\n".join(paragraph(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr"))

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            if "[Content_Types].xml" not in names or "word/document.xml" not in names:
                return None
            parts = [*sorted(n for n in names if n.startswith("word/header")), "word/document.xml", *sorted(n for n in names if n.startswith("word/footer"))]
            out: list[str] = []
            for name in parts:
                root = ElementTree.fromstring(z.read(name))
                out += body(root.find(f"{_W}body") if name == "word/document.xml" else root)
    except (zipfile.BadZipFile, ElementTree.ParseError):
        return None
    text = "\n".join(out)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip("\n")


def read_docx(uploads: DataFrame) -> DataFrame:
    """uploads: path, content. Returns path and text, null where the file cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch.path, "text": [docx_text(bytes(c)) for c in batch.content]})

    return uploads.select("path", "content").mapInPandas(run, "path string, text string")


def read_log(spark: SparkSession, path: str, schema: StructType, strict: bool) -> DataFrame:
    """JSON lines. Lenient: bad lines fall out. Strict: a bad line fails the query; blank lines never count."""
    lines = spark.read.text(path).where("trim(value) != ''")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_variant_get(F.try_parse_json("value"), "$", "string").isNotNull().alias("good"))
    if strict:
        checked = F.when(F.col("good"), F.col("r")).otherwise(F.raise_error(F.concat(F.lit("bad log line: "), F.substring("value", 1, 80))))
        return parsed.select(checked.alias("r")).select("r.*")
    return parsed.where("good").select("r.*")


#: Keys that a report may never hold.
FORBIDDEN = {"text", "value", "raw_text", "content", "context", "snippet", "comment", "normalized_value", "original_text", "match", "note"}


def forbidden_fields(schema: StructType, at: str = "$") -> list[str]:
    """Paths of fields, at any depth, that would carry document text."""
    found = []
    for f in schema.fields:
        here, kind = f"{at}.{f.name}", f.dataType
        while hasattr(kind, "elementType"):
            kind = kind.elementType
        if f.name.lower() in FORBIDDEN:
            found.append(here)
        if isinstance(kind, StructType):
            found += forbidden_fields(kind, here)
    return found


def write_report(report: DataFrame, path: str) -> None:
    """JSON and CSV of a report that holds counts, codes and offsets only."""
    if bad := forbidden_fields(report.schema):
        raise ValueError(f"the report would carry text: {bad[:20]}")
    report.write.mode("overwrite").json(f"{path}/json")
    flat = report.select(*[F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in report.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A table of the report's first rows."""
    rows = report.limit(most).collect()
    head = f"| {' | '.join(report.columns)} |\n|{'---|' * len(report.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows)
