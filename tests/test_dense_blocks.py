import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import dense, dense_blocks


def _table(spark, own, name):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v]) for i, v in own], f"{name} long, embedding array<float>")


def _plain(own, asked, top_n):
    out = []
    for q, a in asked:
        scores = sorted(((round(float(np.float32(a).astype(float) @ np.float32(v).astype(float)), 9), -i) for i, v in own if v is not None), reverse=True)[:top_n]
        out += [(q, k, -i, s) for k, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def _rows(found):
    return sorted((r["query_id"], r["rank"], r["row"], round(r["score"], 9)) for r in found.collect())


def _clusters(n, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 8))
    v = centers[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.05
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(("k", "block_rows", "opening"), [(12, 20, 2), (3, 5, 1), (40, 1000, 4)])
def test_equals_all_products(spark, k, block_rows, opening):
    v = _clusters(300)
    own = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[5]) for i in range(60)] + [(2000, None)]
    asked = [(i, x) for i, x in enumerate(_clusters(9, 2))] + [(50, v[5])]
    vectors, queries = _table(spark, own, "row"), _table(spark, asked, "query_id")
    blocks = dense_blocks.blocked(vectors, dense_blocks.fit_centroids(vectors, k), block_rows).cache()
    assert blocks.agg(F.sum("held")).first()[0] == 360
    assert sorted(map(tuple, dense_blocks.unpacked(blocks).collect())) == sorted(map(tuple, vectors.where("embedding IS NOT NULL").collect()))
    assert _rows(dense_blocks.search(blocks, queries, 7, 8, opening)) == _rows(dense.top_rows(vectors, queries, 7, 8)) == _plain(own, asked, 7)


def test_far_blocks_are_skipped_and_one_hot_vector_is_split(spark):
    v = _clusters(600)
    own = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[5]) for i in range(300)]
    vectors, queries = _table(spark, own, "row"), _table(spark, [(i, x) for i, x in enumerate(v[:20])], "query_id")
    blocks = dense_blocks.blocked(vectors, dense_blocks.fit_centroids(vectors, 12), 50).cache()
    assert blocks.agg(F.max("held")).first()[0] < 120
    read, all_ = dense_blocks.blocks_read(blocks, queries, 5, 2)
    assert read < all_ / 3


def test_nothing_indexed_or_asked(spark):
    none = _table(spark, [], "row")
    queries = _table(spark, [(1, [0.0, 1.0])], "query_id")
    blocks = dense_blocks.blocked(none, dense_blocks.fit_centroids(none, 4))
    assert dense_blocks.search(blocks, queries).collect() == [] and dense.top_rows(none, queries).collect() == []
    some = _table(spark, [(1, [1.0, 0.0])], "row")
    assert dense.top_rows(some, _table(spark, [(1, None)], "query_id")).collect() == []
