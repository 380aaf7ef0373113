import hashlib
import math
import random

import numpy as np
import pytest

from lexweave.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int"


def plain(rows, parts, entries, rounds):
    """rows: (vec_id, vector, label) that are usable; the contract's words with no short cut."""
    ints = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    d = len(ints[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [best(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                if held := [c[p] for c, o in zip(cut, own, strict=True) if o == k]:
                    books[p][k] = [sum(x) // len(held) for x in zip(*held, strict=True)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f), label) for (i, _, label), f in zip(ints, found, strict=True)]
    by = {}
    for _, _, e, label in out:
        by[label] = by.get(label, 0) + e
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, 7) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize(("parts", "entries", "n"), [(4, 6, 150), (2, 64, 40), (8, 3, 60), (1, 20, 90)])
def test_against_plain_search(spark, parts, entries, n):
    r = random.Random(parts)
    # quarters give many equal distances and repeated vectors
    rows = [(r.randrange(1000), [float(r.randrange(-3, 4)) / r.choice([4, 512]) for _ in range(8)], r.choice([None, 0, 1, 2])) for _ in range(n)]
    rows += [(None, [0.25] * 8, None)] + [(5000 + i, [0.5] * 8, 9) for i in range(n // 2)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [0.5] * 7 + [float("nan")], 1), (-4, [float("inf")] + [0.0] * 7, 1), (-5, [None] + [0.0] * 7, 1), (10**6, [0.5] * 16, 1)] + ([(-6, [0.1] * 7, 1)] if parts > 1 else [])
    got = vector_codes.compress(made(spark, rows + bad).repartition(5), parts=parts, entries=entries).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, parts, entries, 2)


def test_search_drops_nothing_that_ties():
    rng = np.random.default_rng(3)
    for _ in range(60):
        book, values = rng.integers(-3, 4, (rng.integers(1, 40), rng.integers(1, 6))), None
        values = rng.integers(-4, 5, (50, book.shape[1]))
        index, best = vector_codes.nearest(values, book)
        full = ((values[:, None] - book) ** 2).sum(2)
        assert (index == full.argmin(1)).all() and (best == full.min(1)).all()


def test_decoded_vectors_have_the_error(spark, tiny):
    vectors, dim = vector_codes.usable(spark.read.parquet(f"{tiny}/embeddings.parquet"))
    books = vector_codes.train(vectors, dim)
    whole = dict(vectors.select("vec_id", "vector").collect())
    for r in vector_codes.encode(vectors, books).collect():
        v = np.floor(np.array(whole[r["vec_id"]]) * 256).astype(int)
        assert ((v - vector_codes.decode(r["code"], books)) ** 2).sum() == r["error"]


def test_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.op12_vector_codes(spark, tiny).collect()), key=repr) == plain(rows, 16, 64, 2)


def test_nothing_usable_and_too_large(spark):
    assert vector_codes.compress(made(spark, [])).collect() == []
    assert vector_codes.compress(made(spark, [(1, None, 1), (2, [0.5] * 15, 1)])).collect() == []
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(made(spark, [(1, [3e38] * 16, 1)])).collect()
