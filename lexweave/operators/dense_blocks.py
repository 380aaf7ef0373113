"""Exact vector search over blocks that a bound can skip.

Vectors are put with their nearest of some centroids, and a centroid's vectors are split into blocks of about
``BLOCK_ROWS``, whatever share of all vectors it draws.  A block has its vectors as one array, their mean ``center``, and
``radius``, the largest distance of one of them from it.  As v = center + (v - center), no inner product with a query q
exceeds q . center + |q| * radius (triangle inequality).

A search takes two steps.  The first bounds every block from the narrow columns, multiplies the few blocks of the highest
bounds, and so learns a score that ``top_n`` rows reach; the second multiplies the blocks whose bound reaches it.  The
result is that of all blocks, ties included.  Where vectors lie all around, as random ones do, every bound is reached and
nothing is skipped; ``blocks_read`` says how many were.

Queries are a table throughout: packed in chunks, they meet the blocks in a join, and a task holds one block and one chunk
of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.operators.bm25 import ranked
from lexweave.operators.tables import snapshot

BLOCK_ROWS = 2048

#: Queries of a chunk.
CHUNK = 1024

#: Chunks are broadcast up to so many bytes together, and copied to each block's place by a shuffle beyond.
BROADCAST_BYTES = 64 << 20

OPENING = 4

#: Products added up in another order differ by less.
SLACK = 1e-9

#: Centroids are fitted to so many vectors each, those of the least hashes.
SAMPLE = 64


def _matrix(values: pa.Array, rows: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def fit_centroids(vectors: DataFrame, k: int, rounds: int = 5) -> np.ndarray:
    """At most ``k`` centroids, fitted on the driver to a bounded sample: ``SAMPLE`` vectors for each, of least hashed rows."""
    sample = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("row"), "row").limit(k * SAMPLE).select("embedding").toPandas()["embedding"]
    if not len(sample):
        return np.zeros((0, 0))
    own = np.stack(sample).astype(np.float64)
    centroids = own[:k].copy()
    for _ in range(rounds):
        nearest = (own @ centroids.T - (centroids**2).sum(1) / 2).argmax(1)
        sums, n = np.zeros_like(centroids), np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, own)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def _celled(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """row, embedding and ``cell``, the nearest centroid."""
    shipped = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shipped.value
        for batch in batches:
            if batch.num_rows:
                own = _matrix(batch.column(1).flatten(), batch.num_rows)
                cell = (own @ c.T - (c**2).sum(1) / 2).argmax(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], ["row", "embedding", "cell"])

    schema = f"row {vectors.schema['row'].dataType.simpleString()}, embedding {vectors.schema['embedding'].dataType.simpleString()}, cell long"
    return vectors.select("row", "embedding").mapInArrow(run, schema)


def blocked(vectors: DataFrame, centroids: np.ndarray | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``block``, ``held``, ``center``, ``radius``, ``rows`` and ``values`` (all vectors in one array) of vectors (row, embedding); null vectors are in none."""
    own = vectors.where("embedding IS NOT NULL")
    celled = own.select("row", "embedding", F.lit(0).cast("long").alias("cell")) if centroids is None or not len(centroids) else _celled(own, centroids)
    # a row for each centroid
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    placed = celled.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    entries = placed.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("row", "embedding"))).alias("e"))
    packed = entries.select((F.col("cell") * (1 << 32) + F.col("part")).alias("block"), F.col("e.row").alias("rows"), F.flatten("e.embedding").cast("array<float>").alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                held = len(one.column(1).flatten())
                v = _matrix(one.column(2).flatten(), held)
                center = v.mean(0)
                radius = float(np.sqrt(((v - center) ** 2).sum(1).max()))
                yield pa.RecordBatch.from_arrays(
                    [one.column(0), pa.array([held], pa.int32()), pa.array([center.tolist()], pa.list_(pa.float64())), pa.array([radius]), one.column(1), one.column(2)], ["block", "held", "center", "radius", "rows", "values"]
                )

    return packed.mapInArrow(run, f"block long, held int, center array<double>, radius double, rows array<{vectors.schema['row'].dataType.simpleString()}>, values array<float>")


def unpacked(blocks: DataFrame) -> DataFrame:
    """row and embedding of every vector in the blocks."""
    size = F.floor(F.size("values") / F.size("rows")).cast("int")
    each = F.transform("rows", lambda r, i: F.struct(r.alias("row"), F.slice("values", i * size + 1, size).alias("embedding")))
    return blocks.select(F.inline(each))


def _chunks(queries: DataFrame) -> DataFrame:
    """Queries (query_id, embedding, reached) packed in chunks: ``ids``, ``vectors`` (one array), ``reached``."""
    n = -(-queries.count() // CHUNK) or 1
    packed = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("query_id", "embedding", "reached"))).alias("e"))
    return packed.select("chunk", F.col("e.query_id").alias("ids"), F.flatten("e.embedding").cast("array<double>").alias("vectors"), F.col("e.reached").alias("reached"))


def _each_with(chunks: DataFrame, many: DataFrame) -> DataFrame:
    """Every chunk with every row of ``many``: a stated set of queries against all rows, in blocks."""
    size = chunks.agg(F.sum(8 * F.size("vectors"))).first()[0] or 0
    return many.crossJoin(F.broadcast(chunks) if size <= BROADCAST_BYTES else chunks)


def _bounds(heads: DataFrame, queries: DataFrame, best: int | None) -> DataFrame:
    """query_id, block, bound: the ``best`` of each task's blocks for each query, or (None) those that reach its score."""
    n = -(-heads.count() // CHUNK) or 1
    packed = heads.groupBy(F.pmod(F.xxhash64("block"), F.lit(n)).alias("part")).agg(F.collect_list(F.struct("block", "center", "radius")).alias("e"))
    packed = packed.select(F.col("e.block").alias("blocks"), F.flatten("e.center").alias("centers"), F.col("e.radius").alias("radii"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blocks, centers, radii, ids, vectors, reached = (c.slice(i, 1).flatten() for c in batch.columns)
                q, c = _matrix(vectors, len(ids)), _matrix(centers, len(blocks))
                bound = q @ c.T + np.linalg.norm(q, axis=1)[:, None] * radii.to_numpy() + SLACK
                if best is None:
                    a, b = np.nonzero(bound >= np.nan_to_num(reached.to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)[:, None] - SLACK)
                else:
                    b = np.argsort(-bound, axis=1, kind="stable")[:, :best]
                    a, b = np.repeat(np.arange(len(q)), b.shape[1]), b.ravel()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), blocks.take(pa.array(b)), pa.array(bound[a, b])], ["query_id", "block", "bound"])

    joined = _each_with(_chunks(queries), packed).select("blocks", "centers", "radii", "ids", "vectors", "reached")
    return joined.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, block long, bound double")


def _products(joined: DataFrame, top_n: int) -> DataFrame:
    """query_id, row, score of each row's best (columns ids, vectors of queries; rows, values of a block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vectors, rows, values = (c.slice(i, 1).flatten() for c in batch.columns)
                products = _matrix(vectors, len(ids)) @ _matrix(values, len(rows)).T
                edge = -np.inf
                if len(rows) > top_n:  # what reaches the n-th best stays, ties included
                    edge = np.partition(products, len(rows) - top_n, axis=1)[:, len(rows) - top_n, None] - SLACK
                a, b = np.nonzero(products >= edge)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), rows.take(pa.array(b)), pa.array(products[a, b])], ["query_id", "row", "score"])

    kinds = [joined.schema[c].dataType.elementType.simpleString() for c in ("ids", "rows")]
    return joined.select("ids", "vectors", "rows", "values").mapInArrow(run, f"query_id {kinds[0]}, row {kinds[1]}, score double")


def _chosen(blocks: DataFrame, queries: DataFrame, pairs: DataFrame, top_n: int) -> DataFrame:
    """Products of pairs of query and block only."""
    n = -(-queries.count() // CHUNK) or 1
    asked = pairs.select("query_id", "block").join(queries, "query_id").groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "embedding")).alias("e"))
    asked = asked.select("block", F.col("e.query_id").alias("ids"), F.flatten("e.embedding").cast("array<double>").alias("vectors"))
    return _products(blocks.join(asked, "block"), top_n)


def check_dimensions(queries: DataFrame, dim: int | None) -> None:
    sizes = queries.select(F.size("embedding").alias("d")).distinct().limit(2).collect()
    if len(sizes) > 1 or (dim is not None and sizes and sizes[0]["d"] != dim):
        raise ValueError("queries and index differ in dimension")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.where("embedding IS NOT NULL").select("query_id", "embedding", F.lit(None).cast("double").alias("reached"))


def search_all(blocks: DataFrame, queries: DataFrame, top_n: int) -> DataFrame:
    """query_id, row, score, rank of the nearest rows, every block multiplied: for vectors without centroids."""
    return ranked(_products(_each_with(_chunks(_asked(queries)), blocks), top_n), top_n)


def choose_blocks(blocks: DataFrame, queries: DataFrame, top_n: int, opening: int = OPENING) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first step: best rows of the opening blocks, their pairs (query_id, block), and the further pairs whose bound reaches the threshold."""
    heads, asked = blocks.select("block", "center", "radius"), _asked(queries)
    own = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    begun = snapshot(_bounds(heads, asked, opening).withColumn("k", F.row_number().over(own)).where(F.col("k") <= opening).select("query_id", "block"), "opening-blocks")
    first = snapshot(ranked(_chosen(blocks, asked, begun, top_n), top_n), "opening-rows")
    reached = first.where(F.col("rank") == top_n).select("query_id", F.col("score").alias("reached"))
    further = _bounds(heads, asked.drop("reached").join(reached, "query_id", "left"), None).join(begun, ["query_id", "block"], "left_anti")
    return first.drop("rank"), begun, further


def search(blocks: DataFrame, queries: DataFrame, top_n: int = 20, dim: int | None = None, opening: int = OPENING) -> DataFrame:
    """query_id, row, score, rank of the nearest rows of each query (query_id, embedding); a null vector is near nothing."""
    check_dimensions(queries.where("embedding IS NOT NULL"), dim)
    if blocks.count() <= opening:
        return search_all(blocks, queries, top_n)
    first, _, further = choose_blocks(blocks, queries, top_n, opening)
    return ranked(first.unionByName(_chosen(blocks, _asked(queries), further, top_n)), top_n)


def blocks_read(blocks: DataFrame, queries: DataFrame, top_n: int = 20, opening: int = OPENING) -> tuple[int, int]:
    """Pairs of query and block that ``search`` multiplies, and all pairs."""
    _, begun, further = choose_blocks(blocks, queries, top_n, opening)
    return begun.count() + further.count(), blocks.count() * queries.where("embedding IS NOT NULL").count()
