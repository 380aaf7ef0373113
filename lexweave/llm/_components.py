"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm._common import materialize

MAX_ROUNDS = 60


def _smallest(edges: DataFrame) -> DataFrame:
    """Each vertex with the smallest of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    low = _smallest(edges)
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # each vertex b ties its smaller neighbours, and itself, to the smallest of them
    low = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    tied = edges.join(low, F.col("b") == F.col("u")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
    return tied.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (its smallest id) for every id in ``links`` (columns ``a``, ``b``).

    Only minima are aggregated, so a vertex with very many links needs no more memory than any other.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    state = None
    for _ in range(MAX_ROUNDS):
        edges = materialize(_small_star(_large_star(edges)), "edges")
        row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == (row["n"], row["x"]):
            break
        state = (row["n"], row["x"])
        if not row["n"]:
            break
    else:
        raise RuntimeError("components did not settle")
    heads = edges.select(F.col("a").alias("id")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(heads.select("id", F.col("id").alias("component")))
