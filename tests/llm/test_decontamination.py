import random

import pytest

from lexweave.llm import decontamination as D
from tests.llm.conftest import EDGE


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(rows, items, percent=80):
    out = set()
    for j, q in items:
        n = len((q or "").encode().lower().split())
        own = shingles(q, min(5, n)) if n else set()
        for i, t in rows:
            held = len(own & shingles(t, min(5, n))) if own else 0
            if own and 100 * held >= percent * len(own):
                out.add((i, j, held, len(own)))
    return out


def test_against_brute_force(spark, docs):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(400)}"
    items = [(j, " ".join(word() for _ in range(r.choice([1, 3, 4, 5, 6, 9, 20, 40])))) for j in range(30)] + [(90, None), (91, " "), (92, "Dup Item here of five words"), (92, "Dup Item here of five words"), (93, "dup item here of five words"), (None, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for i in range(80):
        own = [word() for _ in range(r.randrange(0, 200))]
        if i % 2:
            q = (r.choice(items)[1] or "").split()
            if i % 3 == 0 and len(q) > 10:
                q[r.randrange(len(q))] = "changed"
            own[len(own) // 2 : len(own) // 2] = q
        rows.append((i, " ".join(own).upper() if i % 5 == 0 else " ".join(own)))
    rows += EDGE
    df = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {tuple(x) for x in D.find_contained(docs(rows), df).collect()}
    assert got == plain(rows, items) and len(got) > 30
    rows += [(None, items[7][1]), (0, "a clean text of the same id")]
    kept = D.drop_contaminated(docs(rows), df).count()
    assert kept == sum(not plain([r], items) for r in rows)


@pytest.mark.parametrize("percent", [50, 100])
def test_thresholds(spark, docs, percent):
    text = " ".join(f"a{i}" for i in range(24))
    rows = [(1, text), (2, " ".join(f"a{i}" for i in range(14))), (3, text.replace("a12", "b"))]
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    got = {tuple(x) for x in D.find_contained(docs(rows), items, threshold_percent=percent).collect()}
    assert got == plain(rows, [(1, text)], percent)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contained(docs([(1, "a b c d e f")]), none).count() == 0
    assert D.find_contained(docs([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0
    assert D.drop_contaminated(docs([(1, "a b c d e f")]), none).count() == 1


def test_no_python(spark, docs):
    plan = D.find_contained(docs([(1, "a b")]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_of_any_name_pass_through(spark):
    item = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, f"before {item} behind", 1, 2, 3), (2, "nothing of it", 1, 2, 3)], "doc_id long, text string, _hit int, _HIT_TH int, _item int")
    items = spark.createDataFrame([(7, item, 0)], "item_id long, text string, _w int")
    out = D.drop_contaminated(df, items)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [2]
    assert [(r.doc_id, r.item_id) for r in D.find_contained(df, items).collect()] == [(1, 7)]
