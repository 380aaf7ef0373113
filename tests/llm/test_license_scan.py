import random

from lexweave.llm import license_scan as L
from lexweave.llm.license_templates import TEMPLATES
from tests.llm.conftest import EDGE


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0] * (len(b) + 1)
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_finds_templates_with_spans(spark, docs):
    mit = TEMPLATES[0][1]
    worded = mit.split()
    edited = " ".join(w for i, w in enumerate(worded) if i % 25 != 3)
    rows = [(1, "Ünï intro.\n" + mit + "\nend"), (2, "x " + edited + " y"), (3, "nothing here"), (4, "ALL rights, RESERVED! and more. All rights reserved."), (5, mit[:200])]
    got = L.scan_licenses(docs(rows), TEMPLATES).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == {1, 2, 4}
    one = by[1][0]
    assert (one.license, one.coverage, one.matched) == ("MIT", 1.0, one.template_words)
    assert rows[0][1][one.start : one.end] == mit.rstrip(".")
    assert by[2][0].license == "MIT" and 0.9 < by[2][0].coverage < 1
    assert [(rows[3][1][r.start : r.end]) for r in sorted(by[4], key=lambda r: r.start)] == ["ALL rights, RESERVED", "All rights reserved"]


def test_edges(spark, docs):
    assert L.scan_licenses(docs(EDGE), TEMPLATES).count() == 0
    assert L.scan_licenses(docs([]), TEMPLATES).count() == 0
    assert L.scan_licenses(docs([(1, "All rights reserved."), (1, "All rights reserved.")]), [*TEMPLATES, ("none", " ... ")]).count() == 2


def test_alignment_equals_full_alignment():
    import numpy as np

    r = random.Random(2)
    for _ in range(300):
        t = [r.randrange(6) for _ in range(r.randrange(1, 12))]
        x = [r.randrange(6) for _ in range(r.randrange(1, 14))]
        matched, first, last = L.align(t, np.array(x), 0, 30)
        assert matched == lcs(t, x)
        if matched:
            assert lcs(t, x[first : last + 1]) == matched


def scanned(text, templates=TEMPLATES):
    """(template, matched, text of the span) of each match."""
    import numpy as np
    import xxhash

    parts = L.fold(text).split()
    found = L.LicenseIndex.build(templates).scan(np.array([xxhash.xxh3_64_intdigest(w) for w in parts], np.uint64), 0.8)
    return [(t, n, b" ".join(parts[a : b + 1]).decode()) for t, n, a, b in found]


def test_large_gaps_and_insertions_equal_full_alignment():
    foreign = [f"foreign{i}" for i in range(3000)]
    for t, (_, text) in enumerate(TEMPLATES):
        own = L.fold(text).decode().split()
        n = len(own)
        if n < 30:
            continue
        for cut in (n // 3, n // 2):
            for size in (11, n // 4, 400, 3000):
                long = own[:cut] + foreign[:size] + own[cut:]
                assert (t, n, " ".join(long)) in scanned(" ".join(["before", *long, "behind"])), (t, cut, size)
            gap = own[:cut] + own[cut + n // 6 :]
            got = [m for m in scanned(" ".join(["before", *gap, "behind"])) if m[0] == t]
            assert [m[1] for m in got] == [lcs(own, gap)] == [n - n // 6], (t, cut)
            assert all(m[0] != t for m in scanned(" ".join(own[:cut] + foreign[:50] + own[cut + n // 4 :]))), (t, cut)


def test_notices_inside_an_insertion_and_two_split_copies():
    own = L.fold(TEMPLATES[0][1]).decode().split()
    text = " ".join(own[:80] + [f"x{i}" for i in range(60)] + ["all rights reserved"] + [f"y{i}" for i in range(60)] + own[80:])
    got = scanned(text + " and " + text)
    assert [m[1] for m in got if m[0] == 0] == [163, 163] and sum(m[2] == "all rights reserved" for m in got) == 2


def test_every_run_of_a_short_template_is_known():
    own = [f"w{i}" for i in range(8)]
    for missing in range(8):
        text = ["a", "b", *own[:missing], "other", *own[missing + 1 :], "c"]
        assert [m[:2] for m in scanned(" ".join(text), [("short", " ".join(own))])] == [(0, 7)], missing
    for missing in (0, 1, 3, 4):
        text = ["a", "b", *own[:missing], "other", *own[missing + 1 : 5], "c"]
        assert [m[:2] for m in scanned(" ".join(text), [("short", " ".join(own[:5]))])] == [(0, 4)], missing


def test_winnowing_guarantee():
    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        h = np.array([r.randrange(50) for _ in range(r.randrange(1, 40))], np.uint64)
        places = L.winnow(h, 3).tolist()
        assert all(any(p in places for p in range(i, min(i + 3, len(h)))) for i in range(max(1, len(h) - 2)))


def test_recall_against_an_exhaustive_scan(spark, tiny):
    """Texts in which some window holds four fifths of a template in order, found by trying every window."""
    import numpy as np
    import xxhash

    from lexweave.llm.license_templates import TEMPLATES

    index = L.LicenseIndex.build(TEMPLATES)
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    scanned = {(r.doc_id, r.template) for r in L.scan_licenses(docs, TEMPLATES).collect()}
    inside = {}
    for r in L.scan_licenses(docs, TEMPLATES).collect():
        inside.setdefault(r.doc_id, []).append((r.start, r.end))
    truth = set()
    for r in docs.collect():
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in L.fold(r.text or "").split()], np.uint64)
        for t, template in enumerate(index.templates):
            need, wide = 0.8 * len(template), len(template) + len(template) // 4
            held = np.concatenate([[0], np.cumsum(np.isin(words, np.array(template, np.uint64)))])
            for p in range(max(1, len(words) - wide + 1)):
                if held[min(len(words), p + wide)] - held[p] >= need and L.full_length(template, words[p : p + wide].tolist())[-1] >= need:
                    truth.add((r.doc_id, t))
                    break
    longest = {}
    for d, t in truth:
        longest[d] = max(longest.get(d, 0), len(index.templates[t]))
    missed = [(d, t) for d, t in truth - scanned if d not in inside]
    assert len(truth) >= 5 and not missed, missed
    # shorter templates may lie inside longer ones, and of equally long ones the first is reported
    assert all(any((d, t) in scanned for t in range(len(index.templates)) if (d, t) in truth and len(index.templates[t]) == longest[d]) for d in longest)


def test_a_long_text_of_one_phrase_is_quick():
    import time

    import numpy as np
    import xxhash

    index = L.LicenseIndex.build([("MIT", "permission is hereby granted to any person obtaining a copy of the software to deal in the software without any restriction")])
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in b"in the software ".split() * 7000], np.uint64)
    began = time.time()
    assert index.scan(words, 0.8) == [] and time.time() - began < 5
