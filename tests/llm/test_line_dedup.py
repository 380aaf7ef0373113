import random

from lexweave.llm import line_dedup as L
from tests.llm.conftest import EDGE


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(rows, percent=80):
    """Every line against every earlier one."""
    order = sorted(((i is None, i or 0), k, n) for k, (i, t) in enumerate(rows) for n, _ in enumerate((t or "").split("\n")))
    lines = [(o, k, n, tuple(w for w in rows[k][1].split("\n")[n].split(" ") if w)) for o, k, n in order if rows[k][1] is not None]
    gone = set()
    for p, (o, k, n, w) in enumerate(lines):
        for q, (o2, k2, n2, v) in enumerate(lines[:p]):
            if w and (w == v or near(w, v) and 100 * (max(len(w), len(v)) - 1) >= percent * max(len(w), len(v))):
                gone.add((k, n))
                break
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, (_, t) in enumerate(rows)]


def test_against_every_pair(spark, docs):
    r = random.Random(5)
    base = [[f"w{r.randrange(30)}" for _ in range(r.randrange(1, 14))] for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 5)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(w))
                act = r.randrange(3)
                if act == 0:
                    w[at] = f"z{r.randrange(9)}"
                elif act == 1:
                    w.insert(at, f"z{r.randrange(9)}")
                elif len(w) > 1:
                    w.pop(at)
            lines.append("  ".join(w) if r.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    for percent in (80, 50, 90):
        got = {x.doc_id: x.text for x in L.dedup_lines(docs(rows), similarity_percent=percent).collect()}
        want = plain(rows, percent)
        assert [got[i] for i in range(60)] == want
        assert sum(a != b for (_, a), b in zip(rows, want, strict=True)) > 20


def test_short_lines(spark, docs):
    rows = [(1, "a b c d e\na b c d\nx y z\nno"), (2, "a b c d f"), (3, "a b c z"), (4, "x y w"), (5, "a c d e\nyes")]
    got = {r.doc_id: r.text for r in L.dedup_lines(docs(rows)).collect()}
    assert got == {1: "a b c d e\nx y z\nno", 2: "", 3: "a b c z", 4: "x y w", 5: "yes"}


def test_columns_of_any_name_pass_through(spark):
    names = ["_id", "_th", "_text", "_row", "_gone", "_gid", "_gth", "_pos", "_w", "_h1", "a.b", "LINES_REMOVED"]
    df = spark.createDataFrame([(i, "same line\nown %d" % i, *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    out = L.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *names[:-1], "lines_removed"]
    rows = sorted(map(tuple, out.collect()))
    assert rows == [(i, ("" if i else "same line\n") + f"own {i}", *range(len(names) - 1), int(i > 0)) for i in range(3)]


def test_edges(spark, docs):
    df = docs(EDGE)
    out = L.dedup_lines(df)
    got = out.collect()
    assert len(got) == len(EDGE) and out.columns == [*df.columns, "lines_removed"]
    assert sorted((r.text or "~") for r in got) == sorted((t or "~") if t is not None else "~" for _, t in EDGE)
    assert L.dedup_lines(docs([])).count() == 0


def test_earliest_stays(spark, docs):
    rows = [(None, "same line"), (9, "same line\nother"), (3, "x\nsame line\n\nx"), (4, "same line")]
    got = {r.doc_id: r.text for r in L.dedup_lines(docs(rows)).collect()}
    assert got == {None: "", 9: "other", 3: "x\nsame line\n", 4: ""}


def test_no_python_on_the_main_path(spark, docs):
    plan = L.dedup_lines(docs([(1, "a b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
