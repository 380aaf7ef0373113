"""Registry and versioned ingest as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X

PREFIXES = {"constitutional_text": "CONST", "judgment": "JUDG", "amendment": "AMEND", "user_document": "UDOC"}
KEY = ["document_id", "document_version"]


class RegistryError(Exception):
    """The registry breaks one of its rules."""


def document_id(corpus: Column, source_type: Column, url: Column) -> Column:
    prefix = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[source_type]
    return F.concat(F.coalesce(prefix, F.lit("DOC")), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", corpus, source_type, X.normalize_url(url)), 256), 1, 12))


def version_key(document: Column, version: Column) -> Column:
    return F.concat(document, F.lit("@v"), version.cast("string"))


def chunk_id(document: Column, version: Column, index: Column, text: Column) -> Column:
    return F.concat(version_key(document, version), F.lit(":"), F.format_string("%04d", index.cast("int")), F.lit(":"), F.substring(F.sha2(text, 256), 1, 8))


def current_versions(registry: DataFrame) -> DataFrame:
    return registry.where("replaced_by IS NULL")


def latest_versions(registry: DataFrame) -> DataFrame:
    """The row of the highest version of each document."""
    rest = [c for c in registry.columns if c != "document_id"]
    return registry.groupBy("document_id").agg(F.max_by(F.struct(*rest), "document_version").alias("_r")).select("document_id", "_r.*")


def relinked(registry: DataFrame) -> DataFrame:
    """``replaced_by`` rebuilt from the versions themselves."""
    following = F.lead("document_version").over(Window.partitionBy("document_id").orderBy("document_version"))
    return registry.withColumn("_next", following).withColumn("replaced_by", F.when(F.col("_next").isNotNull(), version_key(F.col("document_id"), F.col("_next")))).drop("_next").select(*registry.columns)


def duplicate_keys(registry: DataFrame) -> DataFrame:
    return registry.groupBy(*KEY).count().where("count > 1").select(*KEY)


def duplicate_sources(manifest: DataFrame) -> DataFrame:
    """Sources that a manifest names more than once, however they are spelt."""
    return manifest.withColumn("source", X.normalize_url(F.col("source_url"))).groupBy("source_type", "source").count().where("count > 1").select("source_type", "source")


def undated(manifest: DataFrame) -> DataFrame:
    """Judgments and constitutional texts must have a source date."""
    return manifest.where(F.col("source_type").isin("judgment", "constitutional_text") & F.col("source_date").isNull())


def plan_ingest(registry: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each incoming document: added, new_version, unchanged or failed, with its version.

    ``incoming``: document_id, file_sha256, title, source_date, error.  A document is unchanged if bytes, title and date equal
    the latest version's; a failed file changes nothing.
    """
    latest = latest_versions(registry).select("document_id", F.col("document_version").alias("_v"), F.col("file_sha256").alias("_hash"), F.col("title").alias("_title"), F.col("source_date").alias("_date"))
    both = incoming.join(latest, "document_id", "left")
    same = F.col("file_sha256").eqNullSafe(F.col("_hash")) & F.col("title").eqNullSafe(F.col("_title")) & F.col("source_date").eqNullSafe(F.col("_date"))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("_v").isNull(), "added").when(same, "unchanged").otherwise("new_version")
    version = F.when(F.col("error").isNotNull() | (outcome == "unchanged"), F.col("_v")).otherwise(F.coalesce("_v", F.lit(0)) + 1)
    return both.withColumns({"outcome": outcome, "document_version": version.cast("int")}).drop("_v", "_hash", "_title", "_date")


def apply_ingest(registry: DataFrame, planned: DataFrame) -> DataFrame:
    """The registry with the new versions in it; predecessors point at them."""
    new = planned.where("outcome IN ('added', 'new_version')")
    for c in registry.columns:
        if c not in new.columns:
            new = new.withColumn(c, F.lit(None).cast(registry.schema[c].dataType))
    return relinked(registry.unionByName(new.select(*registry.columns)))


def keep_registered(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Drop document rows whose version the registry does not know."""
    return documents.join(registry.select(*KEY), KEY, "left_semi")


def missing_versions(registry: DataFrame, documents: DataFrame) -> DataFrame:
    return registry.select(*KEY).join(documents.select(*KEY), KEY, "left_anti")


def page_problems(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose pages are not 1..N, whose pages name another corpus, or whose empty flags are wrong."""
    counted = pages.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("page_number").alias("lo"), F.max("page_number").alias("hi"), F.countDistinct("page_number").alias("d"), F.count_if(F.col("is_empty") != (F.trim(F.col("text")) == "")).alias("flags"))
    joined = documents.select(*KEY, "page_count", "corpus_id").join(counted, KEY, "left")
    other = pages.select(*KEY, F.col("corpus_id").alias("_c")).join(documents.select(*KEY, "corpus_id"), KEY).where("_c <> corpus_id").select(*KEY).distinct().withColumn("_other", F.lit(True))
    problem = F.when(~(F.coalesce((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n")) & (F.col("n") == F.col("page_count")), F.lit(False))), "pages are not numbered 1 to N").when(F.col("flags") > 0, "wrong empty flag").when(F.col("_other"), "provenance differs")
    return joined.join(other, KEY, "left").select(*KEY, problem.alias("problem")).where("problem IS NOT NULL")


def foreign_rows(df: DataFrame, corpus: str) -> DataFrame:
    """Rows of another corpus; must be empty."""
    return df.where(~F.col("corpus_id").eqNullSafe(F.lit(corpus)))


def corpus_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.where("replaced_by IS NULL").groupBy("corpus_id").agg(F.count("*").alias("documents"))
    c = chunks.groupBy("corpus_id").agg(F.count("*").alias("chunks"))
    return d.join(c, "corpus_id", "full").fillna(0, ["documents", "chunks"])


def title_texts(pages: DataFrame) -> DataFrame:
    """The first 1000 characters of each document's first page."""
    return pages.where("page_number = 1").select(*KEY, F.substring("text", 1, 1000).alias("title_text"))
