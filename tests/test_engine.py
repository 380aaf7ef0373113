import json

import pytest

from lexweave.operators import dense
from lexweave.plans import engine as E
from lexweave.plans import registry
from lexweave.sources import scans, sinks
from lexweave.streaming import ingest as streaming
from tests.test_chunking import ACT, JUDGMENT


def documents(spark, act="\n".join(ACT)):
    incoming = spark.createDataFrame([("act", "constitutional_text", "Constitution", "u", act[:9]), ("man", "judgment", "Maneka v. Union", "v", "h")], "document_id string, source_type string, title string, source_url string, file_sha256 string").selectExpr("*", "date'1978-01-25' AS source_date", "cast(null as string) AS error")
    pages = spark.createDataFrame([("act", 1, act, None), ("man", 1, "\n".join(JUDGMENT), "7")], "document_id string, page_number int, text string, page_label string")
    return incoming, pages


def test_from_documents_to_answers(spark, tmp_path):
    own = E.Engine(spark, str(tmp_path), embedder=dense.HashingEmbedder())
    own.create_corpus("demo", "Demo")
    with pytest.raises(E.CorpusExistsError):
        own.create_corpus("demo", "again")
    with pytest.raises(E.InvalidCorpusIdError):
        own.create_corpus("Not OK", "x")
    q = spark.createDataFrame([(1, "What does Article 21 provide on life?"), (2, "rivers of Mars")], "query_id long, query string")
    with pytest.raises(E.CorpusNotReadyError):
        own.retrieve("demo", q)
    assert {r.outcome for r in own.add_documents("demo", *documents(spark)).collect()} == {"added"}
    assert {r.outcome for r in own.add_documents("demo", *documents(spark)).collect()} == {"unchanged"}
    assert own.build_corpus("demo").status == "ready"
    got = {r.query_id: r for r in own.query_many("demo", q).collect()}
    assert got[1].status == "answered" and "Article 21" in got[1].claims[0].statement and got[2].status == "insufficient_evidence"
    for mode in ("bm25", "dense", "hybrid"):
        assert own.retrieve("demo", q, mode).where("rank = 1").count() >= 1
    with pytest.raises(E.QueryError):
        own.retrieve("demo", q, "other")
    with pytest.raises(E.QueryError):
        own.retrieve("demo", spark.createDataFrame([(1, " ")], "query_id long, query string"))
    assert own.add_documents("demo", *documents(spark, "\n".join(["New words", *ACT]))).where("outcome = 'new_version' AND document_version = 2").count() == 1
    with pytest.raises(sinks.StaleIndexError):
        own.load("demo")
    before = own.build_corpus("demo").report
    assert before["vectors_used_again"] > 0
    report = own.build_corpus("demo").report
    assert report["vectors_used_again"] == report["chunks"] > before["vectors_used_again"]
    assert own.counts("demo").first().documents == 2
    assert E.Engine(spark, str(tmp_path)).get_corpus("demo").status == "ready"
    asked = spark.createDataFrame([("a", "provision", "equality before law", None, ["14"]), ("b", "case", "passport impounded", ["man"], None), ("c", "out_of_scope", "rivers", None, None)], "id string, kind string, question string, relevant_documents array<string>, relevant_articles array<string>")
    rates = {(r.mode, r.group): r for r in own.evaluate("demo", asked).collect()}
    assert rates["bm25", "all"].n == 2 and rates["bm25", "all"].hit_at_1 == 1.0 and len(rates) == 9
    reranked = {r.mode for r in own.evaluate("demo", asked, ("bm25",), scorer=dense.OverlapScorer()).collect()}
    assert reranked == {"bm25", "bm25+overlap"}
    assert own.evaluate_answers("demo", asked).first().refused_share == 1.0
    assert [c.corpus_id for c in own.list_corpora()] == ["demo"]
    own.delete_corpus("demo")
    with pytest.raises(E.CorpusNotFoundError):
        own.get_corpus("demo")


def test_directory_and_command_line(spark, tmp_path, capsys):
    from lexweave.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "air.txt").write_text("Airships are lighter than air.\fThey were filled with hydrogen.")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xff")
    root = str(tmp_path / "root")
    main([root, "create", "ships", "Ships"])
    main([root, "add", "ships", str(tmp_path / "in")])
    main([root, "build", "ships"])
    main([root, "query", "ships", "What filled airships with hydrogen?"])
    main([root, "hits", "ships", "What filled airships with hydrogen?", "--mode", "bm25"])
    main([root, "check", "ships"])
    main([root, "list"])
    said = capsys.readouterr().out
    assert "failed" in said and "hydrogen" in said and "air.txt" in said and '"status": "ready"' in said
    main([root, "delete", "ships"])


def test_generated_claims_are_checked(spark, tmp_path):
    from lexweave.operators import generation

    own = E.Engine(spark, str(tmp_path))
    own.create_corpus("demo", "Demo")
    own.add_documents("demo", *documents(spark))
    own.build_later("demo").result(120)
    assert own.wait("demo").status == "ready"
    own.shutdown()
    text = "No person shall be deprived of his life [E1]."
    reply = json.dumps({"status": "answered", "direct_answer": [{"text": text, "citations": ["E1"]}], "explanation": [{"text": "Railways are taxed under many colonial statutes [E1].", "citations": ["E1"]}]})
    got = own.query("demo", "What does Article 21 provide on life?", mode="bm25", generator=own.llm_generator(generation.ScriptedClient([reply])))
    checks = [json.loads(x) for x in got["claim_checks"]]
    assert [c["status"] for c in checks] == ["supported", "insufficient"] and got["status"] == "partial" and len(got["claims"]) == 1
    assert "1 supported, 1 insufficient" in own.describe(got)


def test_uploads(spark, tmp_path):
    own = E.Engine(spark, str(tmp_path), E.Settings.load({"uploads": {"extensions": [".pdf", ".txt"], "max_bytes": 1000}}))
    own.create_corpus("mine", "Mine")
    case = b"Maneka Gandhi versus Union of India.\fThe passport was impounded without a hearing."
    files = [("../a:case.txt", case), ("b.pdf", b"not a pdf"), ("c.pdf", b"%PDF-1.4 /Encrypt 3 0 R"), ("d.doc", b"x"), ("e.txt", b""), ("f.txt", b"y" * 1001)]
    got = own.upload("mine", files, scans.text_pages)
    assert [r["status"] for r in got] == ["accepted"] + ["rejected"] * 5 and "encrypted" in got[2]["reason"] and "not a PDF" in got[1]["reason"]
    assert list(own._stored(f"{tmp_path}/mine/uploads")) == [f"{got[0]['file_sha256']}.txt"]
    assert own.upload("mine", files[:1], scans.text_pages)[0]["status"] == "unchanged"
    own.build_corpus("mine")
    library = spark.createDataFrame([("lib1", "Maneka Gandhi v. Union of India"), ("lib2", "Kesavananda Bharati v. State of Kerala")], "document_id string, title string")
    got = own.query("mine", "Was the passport impounded in Maneka Gandhi?", mode="bm25", library=library)
    assert got["query_type"] == "case" and got["status"] == "answered" and "passport" in got["claims"][0]["quote"]
    got = own.query("mine", "What did Kesavananda decide?", mode="bm25", library=library)
    assert got["status"] == "insufficient_evidence" and any("Kesavananda" in n for n in got["notices"])


def test_pages_that_cannot_be_read_leave_the_others(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"first page text\f!\fthird page text")
    parser = lambda content: [ValueError("no page") if p == "!" else (p, None) for p in content.decode().split("\f")]
    own = E.Engine(spark, str(tmp_path / "root"))
    own.create_corpus("c", "C")
    assert own.add_directory("c", str(tmp_path / "in"), parser, glob="*.txt").first().outcome == "added"
    rows = own.pages("c").orderBy("page_number").collect()
    assert [(r.page_number, r.is_empty, r.extraction_error) for r in rows] == [(1, False, None), (2, True, "ValueError: no page"), (3, False, None)]
    assert own.build_corpus("c").status == "ready"


def test_pointers_are_never_missing_and_old_versions_go(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(1, 6):
        sinks.publish({"a": spark.range(n)}, root)
        assert sinks.load_published(spark, root, "a").count() == n
    names = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert [n for n in names if n.startswith("CURRENT")] == ["CURRENT-000000000004", "CURRENT-000000000005"] and len(names) == 4


def test_failed_build_says_why(spark, tmp_path):
    own = E.Engine(spark, str(tmp_path))
    own.create_corpus("empty", "x")
    with pytest.raises(Exception, match="no documents"):
        own.build_corpus("empty")
    assert own.get_corpus("empty").status == "failed" and own.get_corpus("empty").reason
    own.create_corpus(E.RESERVED, "core")
    with pytest.raises(E.ReservedCorpusError):
        own.delete_corpus(E.RESERVED)
    assert own.list_corpora()[0].corpus_id == E.RESERVED


def test_publishing_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(sinks.IndexNotFoundError):
        sinks.read_pointer(spark, root)
    sinks.publish({"a": spark.range(3)}, root, {"fingerprint": "x", "model": None})
    with pytest.raises(Exception):  # noqa: B017
        sinks.publish({"a": spark.range(5), "b": spark.range(1).selectExpr("raise_error('no')")}, root)
    assert sinks.load_published(spark, root, "a").count() == 3
    with pytest.raises(sinks.StaleIndexError):
        sinks.load_indexes(spark, root, fingerprint="y")


def test_scans(spark, tmp_path):
    (tmp_path / "m.yaml").write_text("documents:\n  - file: a.pdf  # first\n    source_type: judgment\n    title: \"A v. B\"\n    source_url: https://x.org/a\n    source_date: 2001-02-03\n")
    assert scans.load_manifest(spark, str(tmp_path / "m.yaml")).first().title == "A v. B"
    (tmp_path / "bad.yaml").write_text("- file: a\n  source_type: nothing\n")
    with pytest.raises(scans.ManifestError):
        scans.load_manifest(spark, str(tmp_path / "bad.yaml"))
    twice = {"documents": [{"file": "a", "source_type": "user_document", "title": "t", "source_url": u} for u in ("https://X.org/a/", "https://x.org/a")]}
    (tmp_path / "twice.json").write_text(json.dumps(twice))
    with pytest.raises(scans.ManifestError, match="twice"):
        scans.load_manifest(spark, str(tmp_path / "twice.json"))
    (tmp_path / "one.pdf").write_bytes("page ﬁrst\fsecond".encode())
    (tmp_path / "two.pdf").write_bytes(b"\xff\xfe\xff")
    rows = scans.scan_pages(scans.scan_files(spark, str(tmp_path)), scans.text_pages).orderBy("path", "page_number").collect()
    assert [(r.page_number, r.text, r.extraction_error is None) for r in rows] == [(1, "page first", True), (2, "second", True), (None, None, False)]
    assert scans.load_registry(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "reg.jsonl").write_text('{"document_id": "a", "document_version": 1}\n' * 2)
    with pytest.raises(Exception, match="twice"):
        scans.load_registry(spark, str(tmp_path / "reg.jsonl"))
    files = [{"status": "accepted", "length": 60}, {"status": "accepted", "length": 50}, {"status": "accepted", "length": 30}]
    assert [f["status"] for f in scans.within_limits(files, 0, 0, max_total=100)] == ["accepted", "rejected", "accepted"]


def test_settings():
    own = E.Settings.load({"retrieval": {"k1": 1.2}}, {"LEXWEAVE_RETRIEVAL_K1": "1.7", "OTHER": "x"})
    assert own.retrieval.k1 == 1.7 and own.retrieval.b == 0.75
    with pytest.raises(ValueError):
        E.Settings.load({"retrieval": {"k9": 1}})
    with pytest.raises(ValueError):
        E.RetrievalSettings(bm25_weight=0, dense_weight=0)
    bad = {"uploads": {"max_pages": 0}, "reranking": {"candidates": 0}, "generation": {"chars": 10}, "llm": {"temperature": 2.5}, "validation": {"coverage": 1.5}, "chunking": {"target": 10}, "retrieval": {"top_n": -1}, "evidence": {"min_term_coverage": 2}, "quotes": {"chars": "many"}}
    for section, values in [*bad.items(), ("uploads", {"extensions": []}), ("candidate_pool", 0), ("retrieval", {"b": True})]:
        with pytest.raises(ValueError):
            E.Settings.load({section: values})
    assert E.Settings.load({"evidence": {"min_dense_score": None, "top_k": 3}, "llm": {"retries": 0}}).evidence.top_k == 3


def test_streams(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    query = streaming.windowed_counts(streaming.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("w").select("window_start", "event_type", "n").collect())) == sorted(map(tuple, streaming.windowed_counts(events).select("window_start", "event_type", "n").collect()))
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_bytes(b"text")
    seen = []
    streaming.watch_directory(spark, str(tmp_path / "files"), lambda df: seen.extend(df.select("length").collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.length for r in seen] == [4]


def test_queries_match_sql(spark, tiny):
    import duckdb

    con = duckdb.connect()
    for t in "customer part orders lineitem events documents embeddings pages benchmark conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    norm = lambda v: tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else round(v, 9) if isinstance(v, float) else v
    made = registry.queries()
    for name, sql in registry.oracle_sql().items():
        df, want = made[name](spark, tiny), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(df.columns), name
        assert sorted(repr(norm(tuple(r))) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == sorted(repr(norm(r)) for r in want.fetchall()), name


def test_entry_without_the_llm_folders(tmp_path):
    """The whole repository but the two folders, as the driver leaves it, with and without the pipeline's file: it imports, and the other tests are found and run."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    for folder in ("lexweave/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "r" / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    for _ in range(2):
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/usr/local/bin", "PYTHONPATH": str(tmp_path / "r")})
        subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "r", check=True, capture_output=True, env={"PATH": "/usr/bin:/usr/local/bin", "HOME": str(tmp_path)})
        (tmp_path / "r" / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_dense_blocks.py"], cwd=tmp_path / "r", check=True, capture_output=True, env={"PATH": "/usr/bin:/usr/local/bin", "HOME": str(tmp_path), "PYSPARK_PYTHON": sys.executable})


def test_titles_are_whole_and_lookups_act_in_the_registered_queries(spark, tiny):
    docs = {f"d{r.doc_id}": r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    asked = registry.question_analysis(spark, tiny).select("case_document_ids", "case_titles").collect()
    assert any(r.case_titles for r in asked) and all(t == docs[i] for r in asked for i, t in zip(r.case_document_ids, r.case_titles, strict=True))
    evidence = registry.evidence_selection(spark, tiny)[2].select("is_provision", "is_named_case", "origin").collect()
    assert any(r.is_provision for r in evidence) and any(r.is_named_case for r in evidence) and {r.origin for r in evidence} > {"retrieval"}
