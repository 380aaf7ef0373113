"""Scans: manifests, registries, pages, chunks, indexes, evaluation questions, uploads.

Every reader has a fixed schema, so nothing is inferred; a missing table is an empty one where that has a meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators.chunking import CHUNK_SCHEMA
from lexweave.operators.ingest import RegistryError, duplicate_keys, duplicate_sources, undated

REGISTRY_SCHEMA = "document_id string, corpus_id string, source_type string, title string, source_url string, document_version int, source_date date, ingestion_date timestamp, file_sha256 string, replaced_by string"
PAGE_SCHEMA = "corpus_id string, document_id string, document_version int, page_number int, text string, is_empty boolean, page_label string, extraction_error string"
MANIFEST_SCHEMA = "file string, source_type string, title string, source_url string, source_date date"
QUESTION_SCHEMA = "id string, kind string, question string, relevant_documents array<string>, relevant_articles array<string>, note string"
SOURCE_TYPES = ("constitutional_text", "amendment", "judgment", "user_document")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


class ManifestError(Exception):
    """The manifest cannot be read or breaks a rule."""


def read_or_empty(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(schema)
    try:
        return (reader.option("mode", "FAILFAST") if fmt == "json" else reader).format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def load_registry(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The registry; a version that stands twice is an error, a missing file an empty registry."""
    df = read_or_empty(spark, path, REGISTRY_SCHEMA, fmt)
    twice = duplicate_keys(df).limit(1).collect()
    if twice:
        raise RegistryError(f"{path}: {twice[0]['document_id']}@v{twice[0]['document_version']} stands twice")
    return df


def parse_manifest(text: str) -> list[dict]:
    """Entries of a manifest in the plain subset of YAML that manifests use, or in JSON."""
    import json

    if text.lstrip().startswith(("{", "[")):
        data = json.loads(text)
        return data["documents"] if isinstance(data, dict) else data
    entries: list[dict] = []
    for number, line in enumerate(text.splitlines(), 1):
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare or bare.strip() == "documents:":
            continue
        m = re.fullmatch(r"\s*(-\s+)?([a-z_]+):\s*(.*)", bare)
        if not m or (not m[1] and not entries):
            raise ManifestError(f"line {number}: not an entry")
        if m[1]:
            entries.append({})
        entries[-1][m[2]] = m[3].strip("\"'") or None
    return entries


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest entries, checked: known kinds, dates where they are needed, no source twice."""
    try:
        rows = parse_manifest(Path(path).read_text(encoding="utf-8"))
    except OSError as e:
        raise ManifestError(f"{path}: {e}") from e
    names = [x.split()[0] for x in MANIFEST_SCHEMA.split(", ")]
    for r in rows:
        if set(r) - set(names):
            raise ManifestError(f"{path}: unknown keys {sorted(set(r) - set(names))}")
        if r.get("source_type") not in SOURCE_TYPES:
            raise ManifestError(f"{path}: unknown source_type {r.get('source_type')!r}")
    df = spark.createDataFrame([[r.get(n) for n in names] for r in rows], ", ".join(f"{n} string" for n in names)).withColumn("source_date", F.col("source_date").cast("date"))
    if not duplicate_sources(df).isEmpty():
        raise ManifestError(f"{path}: a source stands twice")
    if not undated(df).isEmpty():
        raise ManifestError(f"{path}: judgments and constitutional texts need a source_date")
    return df


PdfParser = Callable[[bytes], list[tuple[str, str | None]]]


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files of a directory in order of name: path, bytes and their hash."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select("path", "length", "content", F.sha2("content", 256).alias("file_sha256"))


def expand_ligatures(text: str) -> str:
    return text.translate(str.maketrans(LIGATURES))


def scan_pages(files: DataFrame, parser: PdfParser) -> DataFrame:
    """A row for each page.  A page that cannot be read has its error beside the other pages; a file that cannot be parsed gives one row with its error and never fails the task.

    ``parser`` maps bytes to (text, label) of each page, or to an exception in the place of a page; no PDF library is assumed.
    """
    schema = "path string, file_sha256 string, page_number int, text string, is_empty boolean, page_label string, extraction_error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content, digest in zip(pdf["path"], pdf["content"], pdf["file_sha256"], strict=True):
                try:
                    pages = parser(bytes(content))
                    if not pages:
                        raise ValueError("the file has no pages")
                    for n, page in enumerate(pages, 1):
                        text, label, error = ("", None, f"{type(page).__name__}: {page}") if isinstance(page, Exception) else (expand_ligatures(page[0] or ""), page[1], None)
                        rows.append((path, digest, n, text, not text.strip(), label, error))
                except Exception as e:  # noqa: BLE001 - whatever a parser raises is a property of the file
                    rows.append((path, digest, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return files.select("path", "content", "file_sha256").mapInPandas(run, schema)


def text_pages(content: bytes) -> list[tuple[str, str | None]]:
    """A parser for plain text with form feeds between pages."""
    return [(p, None) for p in content.decode("utf-8").split("\f")]


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_or_empty(spark, path, PAGE_SCHEMA, fmt)


def load_chunks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_or_empty(spark, path, CHUNK_SCHEMA + ", row long", fmt)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions, one JSON object a line; invalid ones are an error."""
    from lexweave.operators.evaluation import question_problems

    df = spark.read.schema(QUESTION_SCHEMA).option("mode", "FAILFAST").json(path)
    bad = question_problems(df).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return df


def load_cached_vectors(spark: SparkSession, path: str, model: str, dim: int) -> DataFrame:
    """Vectors of a model; empty if there are none that fit."""
    df = read_or_empty(spark, path, "chunk_id string, embedding array<float>, model string")
    return df.where((F.col("model") == model) & (F.size("embedding") == dim))


def inspect_pdf(content: bytes, max_pages: int = 500) -> str | None:
    """Why a file is no acceptable PDF, as far as its plain bytes say; None if nothing is wrong."""
    if not content[:1024].lstrip().startswith(b"%PDF-"):
        return "The file is not a PDF."
    if re.search(rb"/Encrypt\b", content):
        return "The file is encrypted."
    pages = len(re.findall(rb"/Type\s*/Page\b(?!s)", content))
    if pages > max_pages:
        return f"The file has {pages} pages; at most {max_pages} are accepted."
    return None


def accept_uploads(files: DataFrame, existing_hashes: DataFrame, max_bytes: int = 20 << 20, extensions: tuple[str, ...] = (".pdf",)) -> DataFrame:
    """accepted, unchanged or rejected for each file (filename, length, file_sha256), the first failing rule as the reason."""
    known = existing_hashes.select("file_sha256", F.lit(True).alias("_known")).distinct()
    suffix = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    reason = (
        F.when(~suffix.isin(*extensions), F.concat(F.lit("Files of type "), suffix, F.lit(" are not accepted.")))
        .when(F.col("length") == 0, F.lit("The file is empty."))
        .when(F.col("length") > max_bytes, F.lit(f"The file is larger than {max_bytes} bytes."))
    )
    out = files.join(known, "file_sha256", "left").withColumn("reason", reason)
    return out.withColumn("status", F.when(F.col("reason").isNotNull(), "rejected").when(F.col("_known"), "unchanged").otherwise("accepted")).drop("_known")


def within_limits(files: list[dict], documents: int, total_bytes: int, max_documents: int = 20, max_total: int = 200 << 20) -> list[dict]:
    """Count and size limits in upload order; a refused file takes no room, so this is a loop on the driver over one request."""
    out = []
    for f in files:
        reason = f.get("reason")
        if f["status"] == "accepted" and documents + 1 > max_documents:
            reason = f"The corpus already has {max_documents} documents."
        elif f["status"] == "accepted" and total_bytes + f["length"] > max_total:
            reason = f"The corpus would exceed {max_total} bytes."
        elif f["status"] == "accepted":
            documents, total_bytes = documents + 1, total_bytes + f["length"]
        out.append(f | {"reason": reason, "status": "rejected" if reason else f["status"]})
    return out
