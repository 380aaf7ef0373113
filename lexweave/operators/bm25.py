"""BM25 as tables: postings, and a batch search over any number of queries.

``postings`` has a row for each (row, term) with its frequency and the chunk's length, so scoring needs no second
join.  Corpus statistics are one aggregate; document frequency is map-side combined.  A search joins the distinct
query terms, broadcast when their number is checked to be small, to the postings and keeps the best rows of each query
with a window that Spark prunes before the shuffle (WindowGroupLimit).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X
from lexweave.operators.tables import snapshot

BROADCAST_TERMS = 1_000_000


def count_rows(row: pa.Array, lists: pa.ListArray) -> list[pa.Array]:
    """row, term, tf and len of the terms of a few rows."""
    sizes = np.diff(lists.offsets.to_numpy())
    named = lists.flatten().dictionary_encode()
    n = max(len(named.dictionary), 1)
    met, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * n + named.indices.to_numpy(), return_counts=True)
    of, term = met // n, named.dictionary.take(pa.array(met % n))
    return [row.take(pa.array(of)), term, pa.array(tf.astype(np.int32)), pa.array(sizes[of].astype(np.int32))]


def _counts(own: DataFrame, marked: bool) -> DataFrame:
    """row, term, tf and len of each row's terms ``_t``, counted where they are: a batch of rows needs no shuffle.  ``marked``: an empty term for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            yield pa.RecordBatch.from_arrays(count_rows(batch.column("row"), batch.column("_t")), ["row", "term", "tf", "len"])
            if marked:
                sizes = np.diff(batch.column("_t").offsets.to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([""] * len(sizes), pa.string()), pa.array(np.ones(len(sizes), np.int32)), pa.array(sizes.astype(np.int32))], ["row", "term", "tf", "len"])

    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, term string, tf int, len int")


def _tokenised(chunks: DataFrame, row: str, text: str) -> DataFrame:
    return chunks.select(F.col(row).alias("row"), X.tokens(F.col(text)).alias("_t"))


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("row", "len", "term").agg(F.sum("tf").cast("int").alias("tf")).select("row", "term", "tf", "len")


def term_frequencies(chunks: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """row, term, tf and len (terms of the chunk, repeated ones included).

    Rows are counted each by itself; only if one stands in the table twice, which its column alone tells, are counts added up in a shuffle.
    """
    counts = _counts(_tokenised(chunks, row, text), False)
    twice = chunks.groupBy(row).agg(F.count("*").alias("n")).where("n > 1")
    return counts if twice.isEmpty() else _added_up(counts)


def chunk_lengths(chunks: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    return chunks.select(F.col(row).alias("row"), F.size(X.tokens(F.col(text))).alias("len"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def statistics(chunks: DataFrame, tf: DataFrame) -> DataFrame:
    """One row: n and avgdl.  Chunks without terms count in both."""
    total = tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_all"))  # lengths add up to all occurrences
    return chunks.agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("n", F.try_divide(F.col("_all"), F.col("n")).alias("avgdl"))


def build(chunks: DataFrame, row: str = "row", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings with df, and the one-row statistics (n, avgdl).  Chunks without terms count in both statistics.

    The texts are read once: frequencies are a table that both start from.
    """
    tf = snapshot(term_frequencies(chunks, row, text), "frequencies")
    return tf.join(document_frequency(tf), "term"), statistics(chunks, tf)


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    return queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col(query)))).alias("term"))


def broadcast_terms(terms: DataFrame) -> DataFrame:
    """``terms``, marked for a broadcast if their number is checked to be small."""
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def score(postings: DataFrame, stats: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, row, score of every chunk that holds a query term."""
    terms = broadcast_terms(terms)
    matched = postings.join(terms, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return matched.groupBy("query_id", "row").agg(F.sum(weight).alias("score"))


def ranked(scores: DataFrame, top_n: int, by: str = "score", decimals: int = 9) -> DataFrame:
    """The best rows of each query with their rank; equal scores go by row.

    Scores are rounded for the order, as sums over shuffled parts may differ in the last bit from run to run.
    """
    own = Window.partitionBy("query_id").orderBy(F.round(by, decimals).desc(), "row")
    return scores.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top_n)


def question_counts(chunks: DataFrame, terms: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """row, term, tf and len of the questions' terms alone, as a table for any number of searches; the texts are read once.

    No term is empty: an empty one stands for the chunk itself.
    """
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    found = _counts(_tokenised(chunks, row, text), True).join(broadcast_terms(wanted), "term", "left_semi")
    return snapshot(_added_up(found), "frequencies")


def search_counts(tf: DataFrame, terms: DataFrame, top_n: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """A search in ``question_counts``: blocks of postings are scored as arrays, so no posting becomes a row of a join with the questions.

    Rows that are no numbers, or null, are in no block; with any of them postings are joined as rows.
    """
    from lexweave.operators import bm25_blocks

    stats = tf.where("term = ''").agg(F.sum("tf").alias("n"), F.try_divide(F.sum((F.col("len") * F.col("tf")).cast("long")), F.sum("tf")).alias("avgdl"))
    postings = tf.where("term <> ''")
    if tf.schema["row"].dataType.simpleString() not in ("int", "bigint") or not tf.where("row IS NULL").isEmpty():
        return ranked(score(postings.join(document_frequency(postings), "term"), stats, terms, k1, b), top_n)
    asked = terms.join(document_frequency(postings), "term")
    best = bm25_blocks.best_of_ranges(bm25_blocks.blocked(postings), stats, asked, top_n, k1, b)
    return ranked(best.withColumn("row", F.col("row").cast(tf.schema["row"].dataType)), top_n)


def search(chunks: DataFrame, queries: DataFrame, top_n: int = 20, k1: float = 1.5, b: float = 0.75, row: str = "row", text: str = "text") -> DataFrame:
    """A search without a saved index: only the questions' terms leave the texts, so only they are joined."""
    terms = query_terms(queries)
    return search_counts(question_counts(chunks, terms, row, text), terms, top_n, k1, b)
