import random
import re
import zlib
from collections import Counter

import numpy as np

from lexweave.llm import queries, spelling_variants
from tests.llm.conftest import EDGE


def count(rows, one_in=97, least_length=5, least_count=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=2):
    forms, out = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = len(others)
    rows = []
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], words[forms[w]] if forms[w] else None))
    return sorted(rows)


def test_against_all_pairs(spark, docs):
    r = random.Random(4)
    for letters, size in (("ab", 9), ("abcé", 7)):
        words = ["".join(r.choice(letters) for _ in range(r.randrange(4, size))) for _ in range(120)]
        rows = [(i, " ".join(r.choice(words[: r.randrange(1, 121)]).upper() if i % 9 == 0 else r.choice(words) for _ in range(40)) + "-3x") for i in range(60)] + EDGE + [(None, "aaaaa aaaaa aaaaa aaaab")]
        got = spelling_variants.spelling_variants(docs(rows), one_in=5).collect()
        assert sorted(map(tuple, got)) == plain(count(rows, 5))


def test_chains_of_forms_and_ties(spark):
    counts = {"aaaaaa": 3, "aaaaab": 6, "aaaabb": 12, "aaabbb": 24, "aabbbb": 48, "abbbbb": 96, "bbbbb": 3, "ccccc": 3, "ccccd": 6, "cccce": 6, "zzzzzzz": 10}
    got = spelling_variants.group_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == plain(counts)
    assert {r["word"]: r["root"] for r in got}["aaaaaa"] == "abbbbb" and {r["word"]: r["form"] for r in got}["ccccc"] == "ccccd"


def test_very_long_words(spark):
    base = "".join(random.Random(1).choices("abc", k=60_000))
    counts = {base: 3, base[:30_000] + "z" + base[30_001:]: 9, base[1:]: 4, "a" * 50_000: 5, "a" * 50_001: 11}
    got = {r["word"]: r for r in spelling_variants.group_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got[base]["n_near"] == 2 and got[base]["form_n"] == 9 and got[base[1:]]["n_near"] == 1 and got["a" * 50_000]["form_n"] == 11


def test_hashes_follow_the_rule():
    words = ["abcabc", "é", "aab", "abab" * 40]
    index, keys, length, place = spelling_variants.deletion_keys(words)
    seen = {}
    for i, k, n, p in zip(index, keys, length, place, strict=True):
        rest = words[i] if p < 0 else words[i][:p] + words[i][p + 1 :]
        assert len(rest) == n
        assert seen.setdefault(rest, k) == k
    assert len(set(seen.values())) == len(seen)


def test_groups_across_batches():
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 40, 300))
    length, place, own = np.full(300, 5, np.int32), rng.integers(-1, 4, 300).astype(np.int32), rng.random(300) < 0.8
    by = np.lexsort((place, key))
    key, place = key[by], place[by]
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(np.zeros(300, np.int32)), pa.array(key), pa.array(length), pa.array(place), pa.array(own)], ["id", "radix", "key", "length", "place", "own"])
    want = [i for b in spelling_variants._candidates([whole]) for i in b.column(0).to_pylist()]
    for size in (1, 7, 100):
        got = [i for b in spelling_variants._candidates(whole.slice(k, size) for k in range(0, 300, size)) for i in b.column(0).to_pylist()]
        assert got == want and want


def test_query(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    words = count(rows)
    got = {r["word"]: r for r in queries.op11_spelling_variants(spark, tiny).collect()}
    assert {w: r["n"] for w, r in got.items()} == words
    for w in sorted(words)[::40]:
        assert got[w]["n_near"] == sum(near(w, v) for v in words)


def test_empty_table(spark, docs):
    assert spelling_variants.spelling_variants(docs([])).collect() == []
    assert spelling_variants.spelling_variants(docs([(1, None), (2, ""), (3, "a bb ccc")])).collect() == []
