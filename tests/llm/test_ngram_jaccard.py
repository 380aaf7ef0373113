import random

import numpy as np
import pytest

from lexweave.llm import ngram_jaccard as J
from lexweave.llm._components import components
from tests.llm.conftest import EDGE


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def plain(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return sorted(((i, len(sets[k]), i if not sets[k] else least.get(top(k))) for k, (i, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("hot", [8, 1])
def test_against_every_pair(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(J, "HOT", hot)
    r = random.Random(6)
    word = lambda: f"w{r.randrange(3000)}"
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(r.choice([3, 5, 6, 8, 12, 30, 80, 150]))] for _ in range(14)]
    rows = []
    for i in range(160):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        if i % 4 == 0:
            w += passage
        if i % 9 == 0:
            w += [word() for _ in range(r.randrange(12))]
        rows.append((i, " ".join(w)))
    rows += EDGE
    got = sorted(map(tuple, J.jaccard_components(docs(rows)).collect()), key=repr)
    assert got == plain(rows)
    assert sum(i != c for i, _, c in got) > 40
    kept = sorted(x.doc_id for x in J.keep_one_of_each(docs(rows)).where("doc_id IS NOT NULL").collect())
    assert kept == sorted(i for i, _, c in got if i is not None and i == c)


def test_similar_sets_share_signatures():
    """The guarantee itself: at least m + 1 parts agree, in an instance both take part in."""
    r, bands = np.random.default_rng(7), J.Bands()
    for _ in range(400):
        size = int(r.integers(1, 400))
        u = r.integers(0, 2**63, size, dtype=np.uint64)
        drop, add = int(r.integers(0, size // 4 + 1)), int(r.integers(0, size // 4 + 1))
        v = np.concatenate([u[drop:], r.integers(0, 2**63, add, dtype=np.uint64)])
        n = size - drop
        if not len(v) or 100 * n < 80 * (size + len(v) - n):
            continue
        a, b = bands.of(len(u)), bands.of(len(v))
        assert abs(a - b) <= 1
        shared = min(a, b)
        parts = bands.differences(shared) + 1 + bands.spare(shared)
        x, y = (J.signatures(np.unique(w), shared, parts) for w in (u, v))
        assert len(np.intersect1d(x, y)) > bands.spare(shared) - (parts - max(len(x), len(y)))


def test_empty_and_extremes(spark, docs):
    assert J.jaccard_components(docs([])).count() == 0
    assert [tuple(x) for x in J.jaccard_components(docs([(4, None), (4, ""), (2, " ")])).orderBy("doc_id").collect()] == [(2, 0, 2), (4, 0, 4), (4, 0, 4)]
    same = [(i, "A b c d E f") for i in range(30)] + [(None, "a B c d e f")]
    assert {x.component_id for x in J.jaccard_components(docs(same)).collect()} == {0}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (5, 5)]
    got = {x.id: x.component for x in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == got[100] == got[200] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_of_any_name_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(i, text if i < 2 else f"{text} {text[::-1]}", 1, 2, 3, 4) for i in range(3)], "doc_id long, text string, _gone_id int, _GONE_TH int, _id int, `a.b` int")
    out = J.keep_one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]


@pytest.mark.parametrize("size", [3, 40, 300, 1024, 5000])
def test_sketches_tell_long_sets_apart_and_never_similar_ones(spark, size):
    """Sketches of any length: a set against a longer similar one, whose sketch may be twice as long, and against one of half its elements."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(size)
    u = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
    more = np.unique(np.concatenate([u, r.integers(0, 2**63, size // 4, dtype=np.uint64)]))
    half = np.unique(np.concatenate([u[::2], r.integers(0, 2**63, size - len(u[::2]), dtype=np.uint64)]))
    rows = spark.createDataFrame([(k, J.parity(u).tolist(), J.parity(v).tolist()) for k, v in enumerate([u, more, half])], "k long, x array<long>, y array<long>")
    x, y = F.col("x"), F.col("y")
    differ = F.aggregate(F.zip_with(J.folded(x, y), J.folded(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, b: s + b)
    same, longer, other = (row.d for row in rows.orderBy("k").select(differ.alias("d")).collect())
    most = lambda v: len(u) + len(v) - 2 * J.least_shared(len(u), len(v), 80)
    assert same == 0 and longer <= len(more) - len(u) <= most(more)
    assert size < 40 or other > most(half)


def test_a_join_leaves_only_its_result(spark, docs):
    """Tables between the steps go when nothing reads them any more."""
    import os

    from lexweave.operators.tables import run_dir

    there = lambda: set(os.listdir(run_dir(spark).removeprefix("file:")))
    before = there()
    text = " ".join(f"w{i}" for i in range(60))
    found = J.jaccard_components(docs([(1, text), (2, f"{text} more"), (3, "something else"), (3, "something else")]))
    assert sorted(map(tuple, found.collect())) == [(1, 56, 1), (2, 57, 1), (3, 1, 3), (3, 1, 3)]
    assert {name.rpartition("-")[0] for name in there() - before} == {"component-rows", "edges"}


@pytest.mark.parametrize("at_once", [1, 7, 1_000_000])
def test_groups_of_a_signature_wherever_its_rows_are_cut(monkeypatch, at_once):
    from collections import Counter, defaultdict

    import pyarrow as pa

    monkeypatch.setattr(J, "ROWS_AT_ONCE", at_once)
    r = random.Random(at_once)
    rows = [(sig, cid, cid % 5) for sig in range(60) for cid in r.sample(range(100), r.choice([1, 2, 2, 3, J.HOT, J.HOT + 1, 30])) for _ in range(r.choice([1, 1, 1, 2]))]
    rows += [(sig, cid, cid % 5) for sig in (70, 71) for cid in (4, 6)] + [(sig, sig, J.DEEP) for sig in (3, 99)]
    rows.sort()
    batches, k = [], 0
    while k < len(rows):
        n = r.randrange(1, 12)
        batches.append(pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + n], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["_sig", "_cid", "_tag"]))
        k += n
    got = Counter((tuple(x["_cids"]), x["_tag"]) for b in J._shared_signatures(iter(batches)) for x in b.to_pylist())
    holders = defaultdict(set)
    for sig, cid, tag in rows:
        if tag != J.DEEP:
            holders[sig].add(cid)
    want = Counter(((c,), c % 5) for v in holders.values() if len(v) > J.HOT for c in v) + Counter([((3,), J.DEEP), ((99,), J.DEEP)])
    assert {x: n for x, n in got.items() if x[1] is not None} == want
    assert {x for x, tag in got if tag is None} == {tuple(sorted(v)) for v in holders.values() if 1 < len(v) <= J.HOT}
    assert list(J._shared_signatures(iter([]))) == []
