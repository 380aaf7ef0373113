from pyspark.sql import functions as F

from lexweave.operators import bm25, bm25_blocks


def chunks(spark, kind="long"):
    rows = [(1, "the court held a court"), (2, None), (3, "article 19(1)(g) court"), (5000, "held held held"), (5001, "")]
    return spark.createDataFrame(rows, "row long, text string").withColumn("row", F.col("row").cast(kind)).coalesce(2)


def test_terms_are_counted_without_a_shuffle(spark):
    tf = bm25.term_frequencies(chunks(spark))
    assert "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
    found = {(r.row, r.term): (r.tf, r.len) for r in tf.collect()}
    assert found[(1, "court")] == (2, 3) and found[(5000, "held")] == (3, 3) and found[(3, "19(1)(g)")][0] == 1
    assert {r for r, _ in found} == {1, 3, 5000}


def test_a_row_that_stands_twice_is_counted_together(spark):
    twice = chunks(spark).unionByName(chunks(spark))
    found = [(r.row, r.term, r.tf, r.len) for r in bm25.term_frequencies(twice).collect()]
    assert len({x[:2] for x in found}) == len(found) and (1, "court", 4, 3) in found


def test_blocks_are_those_of_the_postings(spark):
    postings, stats = bm25.build(chunks(spark))
    blocks, own = bm25_blocks.build(chunks(spark))
    assert sorted(map(str, blocks.collect())) == sorted(map(str, bm25_blocks.blocked(postings).select(*blocks.columns).collect()))
    assert own.collect() == stats.collect()


def test_search_in_arrays_is_the_search_in_rows(spark):
    terms = bm25.query_terms(spark.createDataFrame([(1, "court held"), (2, "nothing here"), (3, "held")], "query_id long, query string"))
    found = {}
    for kind in ("long", "string"):  # rows that are no numbers are joined as rows
        counts = bm25.question_counts(chunks(spark, kind), terms)
        found[kind] = sorted((r.query_id, str(r.row), round(r.score, 9), r["rank"]) for r in bm25.search_counts(counts, terms, 2).collect())
    assert found["long"] == found["string"] and len(found["long"]) == 4
