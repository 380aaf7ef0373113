import math

from lexweave.plans import registry


def test_small_negative_numbers_keep_their_sign(spark, tmp_path):
    """SQL rounds -1e-8 to -0.0."""
    rows = [(0, [1.0, -1e-8, 0.0]), (1, [-0.0, 3.0, -4.0]), (2, [0.0, -0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.unit for r in registry.normalized_vectors(spark, str(tmp_path)).collect()}
    signs = {k: [math.copysign(1, x) for x in v] for k, v in got.items()}
    assert got == {0: [1.0, 0.0, 0.0], 1: [0.0, 0.6, -0.8], 2: [0.0, 0.0, 0.0]}
    assert signs == {0: [1, -1, 1], 1: [-1, 1, -1], 2: [1, -1, 1]}
