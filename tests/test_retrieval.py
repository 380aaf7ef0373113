import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import bm25, dense, dense_blocks, evaluation, fusion

CHUNKS = [(0, "equality before the law"), (1, "liberty of the person"), (2, "equality of opportunity equality"), (3, ""), (4, "liberty of the person"), (5, "the the")]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "row long, text string")


def test_bm25_equals_the_formula(spark):
    got = bm25.search(chunks(spark), spark.createDataFrame([(1, "Equality equality LAW unknown")], "query_id long, query string")).collect()
    terms = [[w for w in t.split() if w not in ("the", "of", "before")] if t != CHUNKS[0][1] else ["equality", "before", "law"] for _, t in CHUNKS]
    n, avg = len(terms), sum(map(len, terms)) / len(terms)

    def score(ws):
        out = 0.0
        for q in ("equality", "law"):
            df = sum(q in t for t in terms)
            tf = ws.count(q)
            out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg)) if tf else 0
        return out

    want = sorted(((score(t), i) for i, t in enumerate(terms) if score(t) > 0), key=lambda x: (-x[0], x[1]))
    assert [r.row for r in sorted(got, key=lambda r: r.rank)] == [i for _, i in want]
    assert all(abs(r.score - score(terms[r.row])) < 1e-9 for r in got)


def test_twins_go_by_row_and_nothing_matches_nothing(spark):
    q = spark.createDataFrame([(1, "liberty"), (2, "zebra"), (3, "the")], "query_id long, query string")
    got = bm25.search(chunks(spark), q, top_n=5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.row) for r in got] == [(1, 1), (1, 4)]


def test_composed_questions_find_decomposed_texts(spark):
    own = spark.createDataFrame([(0, "the cafe\u0301 act"), (1, "other words"), (2, "more words")], "row long, text string")
    q = spark.createDataFrame([(1, "café"), (2, "ＯＴＨＥＲ")], "query_id long, query string")
    assert sorted((r.query_id, r.row) for r in bm25.search(own, q).collect()) == [(1, 0), (2, 1)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, row long, rank int, score double")


def test_rrf_values(spark):
    one = ranked(spark, [(1, 10, 1, 0.0), (1, 20, 2, 0.0), (1, 30, 3, 0.0)])
    two = ranked(spark, [(1, 30, 1, 0.0), (1, 40, 2, 0.0)])
    got = {r.row: r for r in fusion.reciprocal_rank_fusion([one, two]).collect()}
    assert got[30].score == pytest.approx(1 / 63 + 1 / 61) and got[30].rank == 1 and got[30].best_rank == 1
    half = fusion.reciprocal_rank_fusion([one, two], weights=[1.0, 0.0]).collect()
    assert {r.row for r in half} == {10, 20, 30} and next(r for r in half if r.row == 30).best_rank == 1
    tied = fusion.reciprocal_rank_fusion([ranked(spark, [(1, 9, 1, 0.0)]), ranked(spark, [(1, 5, 1, 0.0)])]).orderBy("rank").collect()
    assert [r.row for r in tied] == [5, 9]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([one], k=0)


def test_dense_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense_blocks, "CHUNK", 3)
    r = np.random.default_rng(1)
    v = r.normal(size=(200, 8)).astype(np.float32)
    v[50] = v[60] = v[70]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(i, v[i * 10].tolist()) for i in range(8)], "query_id long, embedding array<float>")
    got = {}
    for x in dense.top_rows(vectors, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append(x.row)
    for i in range(8):
        scores = v.astype(float) @ v[i * 10].astype(float)
        assert got[i] == sorted(range(200), key=lambda j: (-round(scores[j], 9), j))[:5]
    with pytest.raises(ValueError):
        dense.top_rows(vectors, queries, 5, dim=9)


def test_embeddings_are_reused(spark):
    class Counting(dense.HashingEmbedder):
        pass

    e = Counting()
    table = spark.createDataFrame([("a", "x y"), ("b", "z"), ("c", "")], "chunk_id string, text string")
    own = dense.embed(table, e, "chunk_id").withColumnRenamed("row", "chunk_id").withColumn("model", F.lit(e.name))
    cached = own.where("chunk_id <> 'b'").withColumn("embedding", F.transform("embedding", lambda x: x * 0))
    got = {r.chunk_id: r.embedding for r in dense.embed_missing(table, cached, e).collect()}
    assert sum(got["a"]) == 0 and sum(got["b"]) != 0 and len(got) == 3
    assert len(dense.embed_missing(table, cached.withColumn("model", F.lit("other")), e).where("aggregate(embedding, 0D, (s, x) -> s + x) <> 0").collect()) == 2
    with pytest.raises(ValueError):
        dense.unit_rows(np.array([[np.nan]]))


def test_rerank_keeps_order_at_ties(spark):
    rows = [(1, 5, 1, "a b", "b"), (1, 6, 2, "a b", "a b"), (1, 7, 3, "a b", "a")]
    got = dense.rerank(spark.createDataFrame(rows, "query_id long, row long, rank int, query string, text string"), dense.OverlapScorer()).orderBy("rank").collect()
    assert [r.row for r in got] == [6, 5, 7]


def test_metrics(spark):
    ranks = spark.createDataFrame([("a", "case", 1), ("b", "case", 4), ("c", "provision", None), ("d", "out_of_scope", None), ("e", "provision", 12)], "query_id string, kind string, first_rank int")
    got = {r.group: r for r in evaluation.summary(ranks).collect()}
    assert (got["all"].n, got["all"].hit_at_1, got["all"].hit_at_5, got["all"].mrr_at_10) == (4, 0.25, 0.5, round((1 + 0.25) / 4, 3))
    assert got["case"].hit_at_10 == 1.0 and got["provision"].hit_at_10 == 0.0
    sep = evaluation.score_separation(spark.createDataFrame([("case", 0.7), ("provision", 0.9), ("out_of_scope", 0.6), ("out_of_scope", 0.8)], "kind string, score double")).first()
    assert (sep.answerable_min, sep.out_of_scope_max, sep.separated_share) == (0.7, 0.8, 0.5)
    bad = spark.createDataFrame([("a", "case", ["d"], None), ("a", "case", ["d"], None), ("b", "provision", None, None), ("c", "x", None, None)], "id string, kind string, relevant_documents array<string>, relevant_articles array<string>")
    assert {(r.id, r.problem) for r in evaluation.question_problems(bad).collect()} == {("a", "duplicate id"), ("b", "no relevant articles"), ("c", "unknown kind")}
