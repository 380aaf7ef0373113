"""Reciprocal rank fusion and the hybrid retriever."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 60, weights: list[float] | None = None, top_n: int | None = None) -> DataFrame:
    """Fuse ranked lists (query_id, row, rank): the sum of weight / (k + rank), one shuffle for all lists.

    A list of weight 0 gives no score, but its ranks still count in ``best_rank``; rows found there alone are absent.
    Order: score, best rank, row.
    """
    weights = weights or [1.0] * len(lists)
    if k < 1 or len(weights) != len(lists):
        raise ValueError("k must be at least 1, and each list needs a weight")
    parts = [df.select("query_id", "row", F.col("rank").cast("int").alias("_rank"), F.lit(float(w)).alias("_w")) for df, w in zip(lists, weights, strict=True)]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "row").agg(
        F.sum(F.when(F.col("_w") > 0, F.col("_w") / (k + F.col("_rank")))).alias("score"), F.min("_rank").alias("best_rank")
    ).where(F.col("score").isNotNull())
    own = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "best_rank", "row")
    out = fused.withColumn("rank", F.row_number().over(own))
    return out if top_n is None else out.where(F.col("rank") <= top_n)


def hybrid(bm25_hits: DataFrame, dense_hits: DataFrame, top_n: int = 20, k: int = 60, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Fused rows with both component ranks and scores."""
    fused = reciprocal_rank_fusion([bm25_hits, dense_hits], k, list(weights), top_n)
    one = bm25_hits.select("query_id", "row", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    two = dense_hits.select("query_id", "row", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    return fused.join(one, ["query_id", "row"], "left").join(two, ["query_id", "row"], "left")


def materialize_hits(hits: DataFrame, chunks: DataFrame, row: str = "row") -> DataFrame:
    """Late materialisation: chunk columns join the few rows that are left."""
    return hits.join(chunks, row)


def rank_scores(reranked: DataFrame, k: int = 60) -> DataFrame:
    """A reranked order in the unit of fusion scores."""
    return reranked.withColumn("score", 1 / (F.lit(k) + F.col("rank")))
