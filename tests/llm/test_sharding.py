import hashlib
import math
import zlib
from collections import Counter

import pytest

from lexweave.llm import queries, sharding
from tests.llm.conftest import EDGE

WEIGHTS = [1.0, 2.0, 1.0, 0.5]


def plain(key, weights):
    def score(s):
        return -weights[s] / math.log((int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52)

    return max(range(len(weights)), key=lambda s: (score(s), -s))


def test_against_plain_scores(spark, docs):
    rows = EDGE + [(100 + i, f"text {i % 3}") for i in range(300)]
    for slice_rows in (7, 100_000):
        narrow = sharding.assign(docs(rows).selectExpr("doc_id", "text", "1 AS shard", "2 AS GROWN_SHARD", "3 AS row"), WEIGHTS, "doc_id", 1.5)
        got = sharding.number_rows(narrow, ["doc_id", "text"], slice_rows=slice_rows).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        for r in got:
            key = "" if r["doc_id"] is None else str(r["doc_id"])
            assert (r["shard"], r["grown_shard"], r["row"]) == (plain(key, WEIGHTS), plain(key, [*WEIGHTS, 1.5]), 3)
        for s in range(len(WEIGHTS)):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
        placed = {(r["doc_id"], r["text"]): r["slot"] for r in got if r["doc_id"] != 6}
        assert placed == (before if slice_rows > 7 else placed)  # slices do not show in the result
        before = placed


def test_one_row_very_often(spark):
    many = spark.range(30_000).selectExpr("0 AS shard", "'same' AS key").unionByName(spark.createDataFrame([(0, "other"), (0, None)], "shard int, key string"))
    got = sharding.number_rows(many, ["key"], slice_rows=1000).collect()
    assert sorted(r["slot"] for r in got) == list(range(30_002)) and sum(r["key"] == "same" for r in got) == 30_000


def test_shares_follow_weights_and_few_rows_move(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id")
    got = sharding.assign(rows, WEIGHTS, "doc_id", 0.5).collect()
    share = Counter(r["shard"] for r in got)
    assert all(abs(share[s] / 20_000 - w / 4.5) < 0.02 for s, w in enumerate(WEIGHTS))
    moved = [r for r in got if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {4} and abs(len(moved) / 20_000 - 0.1) < 0.02
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(rows.repartition(7), [*WEIGHTS, 0.5]).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in got)


def test_query(spark, tiny):
    got = queries.op13_sharding(spark, tiny).collect()
    texts = dict(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "key", plain(r["doc_id"], [1] * 16), plain(r["doc_id"], [1] * 17))


def test_empty_table_and_odd_weights(spark, docs):
    assert sharding.shard_documents(docs([]), WEIGHTS).collect() == []
    null = sharding.shard_documents(docs([(1, None)]), WEIGHTS).first()
    assert (null["size"], null["text_crc32"], null["slot"]) == (1, 0, 0)
    for bad in ([], [0.0], [1.0, -1.0], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.assign(docs([]), bad)
