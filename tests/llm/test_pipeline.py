import corpus_pipeline as P
from lexweave.llm import queries
from lexweave.llm._common import materialize


def test_stages_keep_columns_and_take_effect(spark, tiny):
    docs = first = spark.read.parquet(f"{tiny}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, tiny), f"test-{name}")
        assert docs.schema.simpleString() == first.schema.simpleString()
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    last = P.STAGES[-1][1](spark, docs, tiny)
    assert last.count() == counts[-1] and {"doc_id", "token_ids", "n_tokens"} <= set(last.columns)


def test_run_equals_stages(spark, tiny):
    rows = P.run(spark, tiny).collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100
    assert set(P.queries()) == {"pipeline"} and P.oracle_sql() == {}


def test_empty(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, tiny)
        assert docs.count() == 0


def test_queries_match_sql(spark, tiny):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    made = queries.queries()
    for name, sql in queries.oracle_sql().items():
        df = made[name](spark, tiny)
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name


def test_registered_names():
    assert [n for n in queries.queries()] == [f"op{i}_{x}" for i, x in enumerate(["url_filters", "language_id", "warc", "license_scan", "sentencepiece", "html_extraction", "line_dedup", "media_columns", "decontamination", "ngram_jaccard"], 1)]


NAMES = ["_id", "_th", "_text", "_gone", "_verdict", "rejected", "score", "lang_pred", "lines_removed", "row", "own", "first", "_hit", "_row"]


def table(spark, rows):
    """documents rows with extra columns whose names the stages use themselves."""
    extra = ", ".join(f"`{n}` int" for n in NAMES)
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), *range(len(NAMES))) for i, t, lang in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def folder(spark, tmp_path, docs, items):
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def brute_force(rows, items):
    """doc_id -> text before the last stage, every step by the plainest means; rows without a language model."""
    import itertools

    from tests.llm.test_line_dedup import plain

    lined = plain([(i, t) for i, t, _ in rows])
    rows = [(i, t, new) for (i, t, _), new in zip(rows, lined, strict=True) if new == t or new.split()]
    grams = {}
    for i, t, _ in rows:
        w = t.lower().split()
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i, _, _ in rows}
    for _ in rows:
        for a, b in itertools.combinations(group, 2):
            shared = len(grams[a] & grams[b])
            if shared and 100 * shared >= 80 * len(grams[a] | grams[b]):
                group[a] = group[b] = min(group[a], group[b])
    rows = [r for r in rows if group[r[0]] == r[0]]
    out = {}
    for i, _, new in rows:
        w = new.lower().split()
        own = {k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for k in range(1, 6)}
        for _, item in items:
            v = item.lower().split()
            k = min(5, len(v))
            need = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else set()
            if need and 100 * len(need & own[k]) >= 80 * len(need):
                break
        else:
            out[i] = new
    return out


def test_stages_against_brute_force(spark, tmp_path):
    import random

    r = random.Random(11)
    words = [f"w{k}" for k in range(300)]

    def line(n):
        return " ".join(r.choice(words) for _ in range(n))

    shared = [line(9) for _ in range(3)]
    items = [(1, line(20)), (2, "one two"), (3, None), (4, "")]
    items = [(i, t or "") for i, t in items]
    rows, texts = [], []
    for i in range(60):
        lines = [line(r.randrange(3, 25)) for _ in range(r.randrange(2, 8))] + r.sample(shared, r.randrange(3))
        if i % 9 == 5:
            lines.insert(1, items[0][1])
        if texts and i % 4 == 3:  # a near copy: some lines as they are, others with a word or two changed
            lines = r.choice(texts).split("\n")
            for _ in range(r.randrange(3)):
                k = r.randrange(len(lines))
                w = lines[k].split()
                w[r.randrange(len(w))] = "x"
                w[r.randrange(len(w))] = "y"
                lines[k] = " ".join(w)
        if i % 13 == 6:
            lines = [*lines, "", "one two"]
        if i % 4 != 3:
            r.shuffle(lines)
        texts.append("\n".join(lines))
        rows.append((i, texts[-1], "en"))
    rows += [(100, "same short line", "en"), (101, "\n \nsame short line\n", "en")]
    sf = folder(spark, tmp_path, table(spark, rows), items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in P.STAGES[1:-1]:
        docs = materialize(stage(spark, docs, sf), f"brute-{name}")
    got = {x.doc_id: x.text for x in docs.collect()}
    want = brute_force(rows, items)
    assert got == want
    assert 101 not in got and 20 < len(got) < 54


def test_near_copies_are_found_after_line_dedup(spark, tmp_path):
    base = [[f"d{i}l{k}w{j}" for j in range(12)] for i in range(1) for k in range(30)]
    copies = []
    for c in range(10):
        own = [list(w) for w in base]
        own[c][3] = own[c][7] = f"new{c}"
        copies.append("\n".join(" ".join(w) for w in own))
    rows = [(i, t, "en") for i, t in enumerate(["\n".join(" ".join(w) for w in base), *copies])] + [(50, "another text altogether", "en")]
    sf = folder(spark, tmp_path, table(spark, rows), [])
    docs = materialize(P.line_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), "near")
    assert docs.count() == 12
    assert sorted(x.doc_id for x in P.near_duplicate_stage(spark, docs, sf).collect()) == [0, 50]


def test_every_stage_with_odd_rows_and_names(spark, tmp_path):
    long = " ".join(f"wort{i} und{i % 7}" for i in range(30_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "one", "en"), (5, long, "de"), (6, "the repeated row is here", "en"), (6, "the repeated row is here", "en"), (None, "no id at all in this one", "en"), (7, "… — ¡ 123 !", "en"), (8, "deutsche worte stehen hier und dort", "de"), (9, "\n\n", "en")]
    docs = table(spark, rows)
    sf = folder(spark, tmp_path, docs, [(1, None), (2, "")])
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(tuple(r)[5:] == tuple(range(len(NAMES))) for r in found), name
        assert all((r.doc_id, r.text, r.lang) in rows and r.n_chars == (None if r.text is None else len(r.text)) for r in found), name
        kept[name] = sorted(str(r.doc_id) for r in found)
    everything = sorted(str(i) for i, _, _ in rows)
    assert kept["line_dedup"] == kept["decontamination"] == everything
    assert kept["ngram_jaccard"] == everything  # rows with one doc_id stay together
    assert not {"1", "2", "3", "7", "9"} & set(kept["language_id"]) and {"5", "6", "8"} <= set(kept["language_id"])
    last = P.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == len(rows) and all(r.n_tokens == len(r.token_ids) for r in last) and {r.doc_id for r in last if r.n_tokens == 0} == {1, 2}


def test_what_line_dedup_cuts_decides_on_near_copies(spark, tmp_path):
    """Two long lines that differ in two words, each under a heading of its own that an earlier document has."""
    heads = [" ".join(f"h{k}w{j}" for j in range(150)) for k in range(2)]
    body = [f"b{j}" for j in range(200)]
    other = [*body[:50], "new", *body[51:120], "newer", *body[121:]]
    texts = [*heads, f"{heads[0]}\n{' '.join(body)}", f"{heads[1]}\n{' '.join(other)}"]
    sf = folder(spark, tmp_path, table(spark, [(i, t, "en") for i, t in enumerate(texts)]), [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(x.doc_id for x in P.near_duplicate_stage(spark, docs, sf).collect()) == [0, 1, 2, 3]
    cut = materialize(P.line_stage(spark, docs, sf), "cut")
    assert sorted(x.doc_id for x in P.near_duplicate_stage(spark, cut, sf).collect()) == [0, 1, 2]
