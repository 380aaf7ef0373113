import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.operators import bm25, bm25_blocks
from lexweave.operators.tables import run_dir
from lexweave.plans import registry


def _rows(found):
    return sorted((r["query_id"], r["rank"], r["row"], round(r["score"], 9)) for r in found.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    texts = [(i * 3, " ".join(r.choices(words, [1 / (k + 1) for k in range(80)], k=r.randrange(0, 40)))) for i in range(400)]
    texts += [(2000 + i, texts[7][1]) for i in range(30)] + [(5000, "rare rare unheard"), (5001, ""), (5002, None)]
    chunks = spark.createDataFrame(texts, "row long, text string")
    postings, stats = bm25.build(chunks)
    return words, postings.cache(), stats.cache()


@pytest.mark.parametrize(("width", "opening"), [(1, 1), (16, 2), (64, 4), (4096, 4)])
def test_equals_the_plain_search(spark, corpus, width, opening):
    words, postings, stats = corpus
    r = random.Random(width)
    queries = spark.createDataFrame([(f"q{i}", " ".join(r.choices(words, k=r.randrange(1, 12)))) for i in range(12)] + [("rare", f"rare {words[0]}"), ("none", "nowhere"), ("empty", "")], "query_id string, query string")
    terms = bm25.query_terms(queries)
    blocks = bm25_blocks.blocked(postings, width).cache()
    assert blocks.where(F.size("rows") > width).isEmpty() and blocks.agg(F.sum("held")).first()[0] == postings.count()
    for top_n, k1, b in ((3, 1.5, 0.75), (500, 1.2, 0.0)):
        assert _rows(bm25_blocks.search(blocks, stats, terms, top_n, k1, b, opening)) == _rows(bm25.ranked(bm25.score(postings, stats, terms, k1, b), top_n))


def test_ranges_that_cannot_reach_the_threshold_stay_unread(spark, corpus):
    words, postings, stats = corpus
    terms = bm25.query_terms(spark.createDataFrame([(1, f"rare unheard {words[0]} {words[1]}")], "query_id long, query string"))
    read = bm25_blocks.postings_read(bm25_blocks.blocked(postings, 16), stats, terms, 1, opening=1).first()
    assert read["needed"] == 1 and read["read"] <= 4 < read["all"]


def test_nothing_indexed(spark):
    postings, stats = bm25.build(spark.createDataFrame([], "row long, text string"))
    terms = bm25.query_terms(spark.createDataFrame([(1, "word")], "query_id long, query string"))
    assert bm25_blocks.search(bm25_blocks.blocked(postings), stats, terms).collect() == []


def test_rows_that_are_null_or_stand_twice(spark):
    rows = [(1, "air air ship"), (1, "air ship"), (1, "ship air"), (2, None), (7, "ship"), (8, "hull"), (None, "air"), (None, "keel"), (9, "keel keel ship")]
    chunks = spark.createDataFrame(rows, "row long, text string").repartition(3)
    plain, stats = bm25.build(chunks)
    plain = plain.where("row IS NOT NULL")
    blocks, own = bm25_blocks.build(chunks, 2)
    held = blocks.where("block IS NOT NULL")
    assert sorted(map(str, held.collect())) == sorted(map(str, bm25_blocks.blocked(plain, 2).select(*blocks.columns).collect()))
    assert own.collect() == stats.collect()
    terms = bm25.query_terms(spark.createDataFrame([(1, "air keel"), (2, "ship"), (3, "hull none")], "query_id long, query string"))
    for opening in (1, 4):
        assert _rows(bm25_blocks.search(blocks, own, terms, 3, opening=opening)) == _rows(bm25.ranked(bm25.score(plain, stats, terms), 3))


def test_packed_arrays_are_read_back(spark):
    rows = spark.createDataFrame([(0, "a", [1.0], 1.5, 2.0, [3, 2**40], [1, 70000], [900, 2]), (0, "b", [2.0], 0.5, 2.0, [5], [2], [7])], "block long, term string, queries array<double>, idf double, avgdl double, rows array<long>, tfs array<int>, lens array<int>")
    found = rows.drop("term").coalesce(1).mapInArrow(bm25_blocks._packed, "block long, queries array<double>, idf double, avgdl double, held int, pack binary").toArrow()
    assert [x.tolist() for x in bm25_blocks._unpacked(found.column("pack"), found.column("held").to_numpy())] == [[3, 2**40, 5], [1, 70000, 2], [900, 2, 7]]


def test_a_search_sends_only_blocks_of_its_terms(spark, corpus):
    words, postings, stats = corpus
    terms = bm25.query_terms(spark.createDataFrame([(1, f"rare {words[0]}")], "query_id long, query string"))
    blocks = bm25_blocks.blocked(postings, 16).cache()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bm25_blocks.search(blocks, stats, terms, 2, opening=1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"BroadcastHashJoin \[term", plan) and not re.search(r"SortMergeJoin \[term", plan)


def test_a_saved_index_leaves_no_other_table(spark, tiny, tmp_path):
    before = set(os.listdir(run_dir(spark).removeprefix("file:")))
    registry.save_index(spark, tiny, str(tmp_path / "index"))
    assert set(os.listdir(run_dir(spark).removeprefix("file:"))) <= before
