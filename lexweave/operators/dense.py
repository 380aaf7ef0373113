"""Dense retrieval: embedding, exact inner products of unit vectors (in blocks, see ``dense_blocks``), reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X
from lexweave.operators import dense_blocks

class Embedder(Protocol):
    name: str
    dim: int

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """A stand-in without a model: words counted in md5 buckets, at unit length; a text without words is zero."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hashing-{dim}", dim

    def embed_documents(self, texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest(), 16) % self.dim] += 1
        return unit_rows(out)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_documents([text])[0]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay; values that are not finite are refused."""
    if not np.isfinite(vectors).all():
        raise ValueError("embeddings must be finite")
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return X.let(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def embed(chunks: DataFrame, embedder: Embedder, row: str = "row", text: str = "text") -> DataFrame:
    """row and embedding; the model is loaded once for each Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit_rows(np.asarray(embedder.embed_documents([t or "" for t in batch.column(1).to_pylist()]), np.float32))
            offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["row", "embedding"])

    return chunks.select(F.col(row).alias("row"), F.col(text)).mapInArrow(run, f"row {chunks.schema[row].dataType.simpleString()}, embedding array<float>")


def embed_queries(queries: DataFrame, embedder: Embedder, instruction: str = "") -> DataFrame:
    """query_id and embedding of each question, by the model's own way for questions and behind its instruction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            vectors = unit_rows(np.asarray([embedder.embed_query(instruction + (t or "")) for t in texts], np.float32).reshape(len(texts), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors.tolist(), pa.list_(pa.float32()))], ["query_id", "embedding"])

    return queries.select("query_id", "query").mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, embedding array<float>")


def embed_missing(chunks: DataFrame, cached: DataFrame, embedder: Embedder, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Vectors of all chunks: cached ones of the same model and size are used again, the rest computed."""
    own = cached.where((F.col("model") == embedder.name) & (F.size("embedding") == embedder.dim)).select(F.col(key).alias("row"), "embedding")
    known = own.join(chunks.select(F.col(key).alias("row")), "row", "left_semi")
    missing = chunks.join(own.select(F.col("row").alias(key)), key, "left_anti")
    both = known.unionByName(embed(missing, embedder, key, text))
    return both.select(F.col("row").alias(key), "embedding", F.lit(embedder.name).alias("model"))


def top_rows(vectors: DataFrame, queries: DataFrame, top_n: int = 20, dim: int | None = None) -> DataFrame:
    """query_id, row, score, rank of the nearest rows of each query (columns row/query_id and embedding); a null vector is near nothing.

    For vectors without a saved index: all of them meet all queries, block by block.
    """
    dense_blocks.check_dimensions(queries.where("embedding IS NOT NULL"), dim)
    return dense_blocks.search_all(dense_blocks.blocked(vectors), queries, top_n)


def best_similarity(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Largest cosine of each query to its own passages (both with query_id and unit embedding)."""
    joined = queries.select("query_id", F.col("embedding").alias("_q")).join(passages.select("query_id", F.col("embedding").alias("_p")), "query_id")
    return joined.groupBy("query_id").agg(F.max(inner_product(F.col("_q"), F.col("_p"))).alias("score"))


def rerank(candidates: DataFrame, scorer, top_n: int | None = None) -> DataFrame:
    """Order candidates (query_id, row, rank, query, text) by a pair scorer; equal scores keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scorer.score(list(zip(batch.column("query").to_pylist(), batch.column("text").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("row"), batch.column("rank"), pa.array(np.asarray(scores, np.float64))], ["query_id", "row", "before", "score"])

    types = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "row")}
    scored = candidates.select("query_id", "row", F.col("rank").cast("int").alias("rank"), "query", "text").mapInArrow(run, f"query_id {types['query_id']}, row {types['row']}, before int, score double")
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "before")
    out = scored.withColumn("rank", F.row_number().over(own))
    return out if top_n is None else out.where(F.col("rank") <= top_n)


class OverlapScorer:
    """A pair scorer without a model: shared words over the query's words."""

    name = "overlap"

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for query, text in pairs:
            q = set((query or "").lower().split())
            out.append(len(q & set((text or "").lower().split())) / len(q) if q else 0.0)
        return out
