"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
All but the last return the columns of ``docs``, whatever further ones it has and whatever their names; rows that stay
are unchanged but for the text that line dedup cleans.  Defined results at every stage: no row fails it, whatever is
null; repeated rows are decided alike and stay or go together; texts are read whole, however long; an empty table gives
an empty result.  What else a stage defines stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontamination, language_id, line_dedup, ngram_jaccard, sentencepiece_codec
from lexweave.llm._common import materialize, quoted, read_table, whole_row
from lexweave.llm.queries import default_model_path


#: Ids (16 bytes each) are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is rejected: no letters, or a margin too narrow.

    A null or empty text goes, and a text whose two best languages tie; a null ``lang`` is not learned from and decides
    nothing.  With no label at all every document goes, as no language is known.
    """
    model = language_id.fit(docs)
    judged = language_id.predict(docs.select("text", whole_row(docs).alias("row")), model)
    return judged.where(~F.col("rejected")).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated lines; a document that loses lines and keeps no more than white space goes.

    A text that is null, empty or blank to begin with loses nothing and stays.  Of equal lines the one of the smallest
    doc_id stays, at its first place; a null doc_id is later than any other.  ``n_chars`` follows the text.
    """
    cleaned = line_dedup.dedup_lines(docs.select("doc_id", "text", whole_row(docs).alias("row")))
    kept = cleaned.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("lines_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    return kept.select(*[(changed[c].cast(docs.schema[c].dataType) if changed.get(c) is not None else F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents of the smallest id of each group of linked documents.

    Line dedup leaves of a near copy only the lines in which it differs, and such a remnant resembles nothing; of other
    texts it cuts what kept them apart.  So a row is compared by its own text and, where that is not what ``documents``
    has under its doc_id, by the whole texts there as well: it goes if either is not first in its group.  A text without
    words links with nothing and stays; a null doc_id goes if its text links with one that has an id.  Rows with one
    doc_id and text stay or go together; of several whole texts under one doc_id it is enough that one is first.
    """
    texts = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = [F.col("doc_id").alias("own"), F.xxhash64("text").alias("own_text")]
    here = F.col("doc_id").eqNullSafe(F.col("own"))
    this = here & (F.col("text_hash") == F.col("own_text"))
    known = texts.select(F.col("doc_id").alias("known"), F.xxhash64("text").alias("known_text")).distinct()
    same = F.col("own").eqNullSafe(F.col("known")) & (F.col("own_text") == F.col("known_text"))
    cut = materialize(docs.select(*hashed).distinct().join(known, same, "left_anti"), "texts-cut")
    left = materialize(docs.select("doc_id").distinct().select(F.col("doc_id").alias("own")), "ids-left")
    few = left.count() <= BROADCAST_IDS and cut.count() <= BROADCAST_IDS
    near = F.broadcast if few else lambda table: table
    whole = texts.join(near(left), here, "left_semi")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(near(cut), this, "left_semi").drop("text_hash")
    # the join reads the texts several times: what a broadcast filters needs no table of its own
    both = whole.unionByName(own)
    both = both if few else materialize(both, "compared-texts")
    first = ngram_jaccard.first_of_each(both).select(F.col("id").alias("known"), F.col("text_hash").alias("known_text"))
    gone = cut.join(first, same, "left_anti")
    elsewhere = left.join(known.select("known").distinct(), F.col("own").eqNullSafe(F.col("known")), "left_anti")
    stay = first.join(cut, same, "left_anti").select(F.col("known").alias("own")).union(elsewhere).distinct()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), whole_row(docs).alias("row"))
    return rows.join(near(stay), here, "left_semi").join(near(gone), this, "left_anti").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item: four fifths of its shingles.

    A null, empty or blank text contains none and stays, as does every text if no item has words; of rows with one
    doc_id only those whose own text holds an item go.
    """
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``token_ids``, ``ids_sha256`` and ``decoded_sha256`` (of what the ids decode to) of every row; a null text is the empty one."""
    return sentencepiece_codec.encode_texts(docs, default_model_path(), ids=True, digests=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", tokens_stage),
]

#: zstandard sizes and SentencePiece ids have no SQL; tests compare each stage with a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
