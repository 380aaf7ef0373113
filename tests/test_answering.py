import json
from datetime import date

import pytest

from lexweave.operators import answers as A
from lexweave.operators import claims, generation, selection, understanding


def chunk(i, doc, kind, text, **more):
    base = {"row": i, "chunk_id": f"c{i}", "document_id": doc, "document_version": 1, "source_type": kind, "text": text, "article_number": None, "article_title": None, "heading": None, "division": None, "opinion_author": None, "case_name": None, "page_start": 1 + i, "page_end": 1 + i, "page_label_start": None, "page_label_end": None, "source_url": "u", "part": None, "chapter": None}
    return base | more


CHUNKS = [
    chunk(0, "act", "constitutional_text", "14. Equality before law.—The State shall not deny to any person equality before the law.", article_number="14", article_title="Equality before law"),
    chunk(1, "act", "constitutional_text", "21. Protection of life and personal liberty.—No person shall be deprived of his life or personal liberty except according to procedure established by law.", article_number="21", article_title="Protection of life and personal liberty"),
    chunk(2, "man", "judgment", "The procedure under Article 21 must be fair, just and reasonable. A passport cannot be impounded without hearing.", division="opinion"),
    chunk(3, "man", "judgment", "HELD: Liberty is of the widest amplitude.", division="front_matter", heading="HELD"),
    chunk(4, "man", "judgment", "Article 21 and Article 14 are read together with liberty.", division="opinion"),
    chunk(5, "kes", "judgment", "The basic structure of the Constitution cannot be amended. Article 21 was argued.", division="opinion"),
]
TITLES = [("man", "Maneka Gandhi v. Union of India"), ("kes", "Kesavananda Bharati v. State of Kerala")]
SCHEMA = "row long, chunk_id string, document_id string, document_version int, source_type string, text string, article_number string, article_title string, heading string, division string, opinion_author string, case_name string, page_start int, page_end int, page_label_start string, page_label_end string, source_url string, part string, chapter string"


def analyze(spark, *questions, titles=TITLES, reference=None):
    q = spark.createDataFrame([(i, t) for i, t in enumerate(questions)], "query_id int, query string")
    frame = lambda rows: spark.createDataFrame(rows, "document_id string, title string")
    return understanding.analyze(q, frame(titles), frame(reference) if reference else None)


def test_understanding(spark):
    rows = analyze(spark, "What does Article 21 provide?", "How has the court interpreted Articles 14 and 19(1)(g)?", "What did Maenka decide?", "Explain Foo v. Bar", "tell me about rivers", "what was decided in Golaknath", reference=[("gol", "Golaknath v. State of Punjab")]).orderBy("query_id").collect()
    assert [r.query_type for r in rows] == ["provision", "interpretation", "case", "case", "general", "case"]
    assert rows[1].articles == ["14", "19"] and rows[1].article_refs == ["14", "19(1)(g)"]
    assert rows[2].case_document_ids == ["man"] and rows[2].corrections == {"maenka": "maneka"} and rows[2].search_query == "What did maneka decide?" and rows[2].content_terms == []
    assert rows[3].names_unknown_case and rows[3].case_document_ids == [] and "foo" in rows[3].content_terms
    assert rows[4].content_terms == ["me", "rivers"] or rows[4].content_terms == ["rivers"] or "rivers" in rows[4].content_terms
    assert rows[5].unknown_case_titles == ["Golaknath v. State of Punjab"] and rows[5].names_unknown_case
    assert rows[0].signals[0].startswith("cites Article(s) ['21']")


def select(spark, question, limits=None, hits=((2, 1), (5, 2), (4, 3))):
    analysis = analyze(spark, question)
    chunks = spark.createDataFrame([tuple(c[n.split()[0]] for n in SCHEMA.split(", ")) for c in CHUNKS], SCHEMA)
    own = spark.createDataFrame([(0, f"c{i}", r, 1 / (60 + r), r, 1.0, None, None) for i, r in hits], "query_id int, chunk_id string, rank int, score double, bm25_rank int, bm25_score double, dense_rank int, dense_score double")
    registry = spark.createDataFrame([("act", 1, "Constitution", None), ("man", 1, TITLES[0][1], date(1978, 1, 25)), ("kes", 1, TITLES[1][1], date(1973, 4, 24))], "document_id string, document_version int, title string, source_date date")
    limits = limits or selection.EvidenceLimits()
    evidence = selection.select_evidence(analysis, own, chunks, registry, limits)
    return analysis, chunks, evidence, limits


def test_provision_leads_and_caps_hold(spark):
    _, _, evidence, _ = select(spark, "What does Article 21 provide on liberty?")
    rows = evidence.orderBy("evidence_rank").collect()
    assert rows[0].chunk_id == "c1" and rows[0].origin == "provision_lookup" and rows[0].boosts == {"provision_match": 1.0}
    assert [r.evidence_id for r in rows] == [f"E{i + 1}" for i in range(len(rows))]
    assert sum(r.document_id == "man" for r in rows) == 2 and rows[0].document_title == "Constitution"
    assert next(r for r in rows if r.chunk_id == "c5").boosts == {"article_mention": 0.01}


def test_interpretation_keeps_a_provision(spark):
    _, _, evidence, _ = select(spark, "How did the court interpret Article 21?", selection.EvidenceLimits(top_k=3))
    rows = evidence.orderBy("evidence_rank").collect()
    assert [r.role for r in rows] == ["judicial", "judicial", "constitutional_text"]


def test_case_summary_first(spark):
    _, _, evidence, _ = select(spark, "What did Maneka Gandhi decide?", hits=((2, 1), (5, 2)))
    rows = evidence.orderBy("evidence_rank").collect()
    assert rows[0].chunk_id == "c3" and rows[0].origin == "case_lookup" and rows[-1].document_id == "kes"


def answer(spark, question, generator=A.extractive_answer, **kw):
    analysis, chunks, evidence, limits = select(spark, question, **kw)
    questions = A.questions_with_evidence(analysis, evidence, selection.notices(analysis, chunks), selection.assess_confidence(analysis, evidence, limits))
    return A.answer_all(questions, generator).first()


def test_extractive_answer(spark):
    got = answer(spark, "What does Article 21 provide on liberty?")
    assert got.status == "answered" and got.claims[0].section == "answer" and got.claims[0].statement.startswith("Article 21 of the Constitution (Protection of life and personal liberty) reads: “21.")
    assert json.loads(got.citations[0])["article_number"] == "21" and "Citations:" in got.rendered
    assert answer(spark, "What does Article 99 provide about zebras?").status == "insufficient_evidence"
    unknown = answer(spark, "Explain Foo v. Bar")
    assert unknown.status == "insufficient_evidence" and "The case named in the question is not in the corpus." in unknown.notices


ITEMS = [c | {"evidence_id": f"E{i + 1}", "role": "constitutional_text" if c["source_type"] == "constitutional_text" else "judicial", "document_title": "Constitution" if i < 2 else "Maneka Gandhi", "source_date": None, "origin": "retrieval", "rank": i + 1, "score": 0.01, "bm25_rank": 1, "dense_rank": None, "final_score": 0.1} for i, c in enumerate(CHUNKS)]
Q = {"query_id": 0, "query": "q?", "query_type": "provision", "articles": ["21"], "content_terms": ["liberty"], "case_document_ids": [], "case_terms": [], "notices": []}


def test_grounding_checks():
    made = A.extractive_answer(Q, ITEMS[:2])
    A.check_grounding(made, ITEMS)
    for change in ({"claims": [made["claims"][0] | {"quote": "made up words"}]}, {"claims": [made["claims"][0] | {"citation_ids": [9]}]}, {"citations": [made["citations"][0] | {"page_start": 99}]}, {"status": "insufficient_evidence"}, {"citations": made["citations"] * 2}):
        with pytest.raises(A.GroundingError):
            A.check_grounding(made | change, ITEMS)


VERDICTS = [
    ("No person shall be deprived of his life or personal liberty except according to procedure established by law.", ["E2"], "supported", "verbatim"),
    ("Personal liberty and life are protected by procedure established by law. [E2]", ["E2"], "supported", "covered"),
    ("A person can be deprived of life without procedure established by law.", ["E2"], "contradicted", "conflict"),
    ("The passport of Sharma was impounded after hearing.", ["E3"], "insufficient", "stranger"),
    ("Something wholly different about railways and taxation statutes.", ["E2"], "insufficient", "uncovered"),
    ("Cited nowhere at all.", [], "insufficient", "uncited"),
    ("Unknown evidence cited here.", ["E99"], "insufficient", "unknown"),
    ("It says “these words are not there at all”.", ["E2"], "insufficient", "misquoted"),
    ("Liberty.", ["E2"], "insufficient", "thin"),
    ("[E2]", ["E2"], "insufficient", "empty"),
    (None, None, "insufficient", "empty"),
    ("The amendment was upheld by the bench.", ["X1"], "contradicted", "conflict"),
    ("The amendment was struck down by the bench.", ["X1"], "supported", "covered"),
    ("Freedom of speech is absolute.", ["X2"], "contradicted", "conflict"),
    ("Freedom of speech is not absolute.", ["X2"], "insufficient", "unconfirmed"),
    ("Citizens never enjoy freedom of speech.", ["X2"], "contradicted", "conflict"),
    ("The levy does not burden small traders.", ["X3"], "supported", "covered"),
    ("The levy does not help big importers.", ["X3"], "insufficient", "unconfirmed"),
    ("Speech of citizens, in 1950, was free.", ["X2", "X4"], "supported", "covered"),
    ("Words about nothing here.", ["X5"], "insufficient", "blank"),
]
FURTHER = [("X1", "The bench struck down the amendment. It was long."), ("X2", "Citizens enjoy freedom of speech, subject to reasonable restrictions."), ("X3", "The levy shall not burden any small traders."), ("X4", "Speech was free in 1950."), ("X5", " ")]


def test_claims(spark):
    items = [{"evidence_id": i, "text": t, "document_title": "", "source_type": "user_document", "case_name": None, "article_title": None, "article_number": None, "heading": None, "source_date": None} for i, t in FURTHER] + ITEMS
    fields = [x.split(":")[0] for x in claims.EVIDENCE[13:-2].split(",")]
    rows = [(n, c, ids, [tuple(i.get(f) for f in fields) for i in items]) for n, (c, ids, _, _) in enumerate(VERDICTS)] + [(99, "Nothing is sent.", ["E1"], None)]
    got = {r["claim_id"]: r for r in claims.check_claims(spark.createDataFrame(rows, f"claim_id int, claim string, citation_ids array<string>, evidence {claims.EVIDENCE}")).collect()}
    assert [(got[n]["status"], got[n]["rule"]) for n in range(len(VERDICTS))] == [v[2:] for v in VERDICTS] and got[99]["rule"] == "unknown"
    assert got[0]["supporting_ids"] == ["E2"] and got[18]["supporting_ids"] == ["X2", "X4"] and "only" in got[2]["detail"] or "except" in got[2]["detail"]


def test_claims_in_meaning(spark):
    from lexweave.operators.dense import HashingEmbedder

    item = [("E1", "liberty and life are protected", "", "user_document", None, None, None, None, None)]
    rows = [(1, "liberty and life are protected", ["E1"], item), (2, "liberty and life stay guarded somehow", ["E1"], item), (3, "taxes rise sharply yearly", ["E1"], item)]
    own = spark.createDataFrame(rows, f"claim_id int, claim string, citation_ids array<string>, evidence {claims.EVIDENCE}")
    got = {r["claim_id"]: r for r in claims.check_claims(own, claims.SupportLimits("semantic", semantic_coverage=0.3, semantic_threshold=0.4), HashingEmbedder()).collect()}
    assert got[1]["rule"] == "verbatim" and got[2]["status"] == "supported" and 0.4 <= got[2]["semantic"] < 1 and got[3]["status"] == "insufficient" and got[3]["semantic"] < 0.4
    with pytest.raises(RuntimeError):
        claims.check_claims(own, claims.SupportLimits("semantic"))
    with pytest.raises(ValueError):
        claims.SupportLimits(coverage=1.2)


def test_claims_of_answers_and_retries(spark):
    reply = {"status": "answered", "direct_answer": [{"text": "Life and personal liberty are protected by procedure established by law [e2].", "citations": [{"id": "E2"}]}], "explanation": [{"text": "Railways are taxed under many statutes.", "citations": ["[E2]"], "basis": "inference"}, {"text": "No id.", "citations": []}, {"text": "Not sent.", "citations": ["E9"]}]}
    client = generation.ScriptedClient(["no json", f"```json\n{json.dumps(reply)}\n```"])
    made = generation.LLMAnswers(client)(Q, ITEMS)
    A.check_grounding(made, ITEMS)
    assert made["status"] == "partial" and len(made["claims"]) == 2 and len(client.requests) == 2 and "REFUSED" in client.requests[1].user
    statements = spark.createDataFrame([(c["claim_id"], c["statement"], [f"E{n}" for n in c["citation_ids"]], c["basis"]) for c in made["claims"]], "statement_id string, statement string, citation_ids array<string>, basis string")
    own = claims.statement_claims(statements).orderBy("claim_id").collect()
    assert [(r["claim_id"], r["citation_ids"], r["claim_type"]) for r in own] == [("C1.1", ["E2"], "propositional"), ("C2.1", ["E2"], "interpretational")]
    checks = [{"statement_id": "C1", "text": own[0]["claim"], "status": "supported", "reason": "", "kept": True, "supporting_ids": ["E2"], "shown": own[0]["sentence"]}, {"statement_id": "C2", "text": own[1]["claim"], "status": "insufficient", "reason": "r", "kept": False, "supporting_ids": [], "shown": None}]
    checked = A.keep_supported(made, checks)
    assert len(checked["claims"]) == 1 and checked["status"] == "partial" and checked["claims"][0]["statement"].endswith("[E2].") and "insufficient" in checked["notices"][-1]
    A.check_grounding(checked, ITEMS)
    assert A.keep_supported(made, checks[1:])["status"] == "insufficient_evidence" and A.keep_supported(made, []) == made
    assert generation.LLMAnswers(generation.ScriptedClient([generation.LLMTimeoutError("60 s")]))(Q, ITEMS)["status"] == "generation_failed"
    assert generation.LLMAnswers(generation.ScriptedClient(["x", "y"]))(Q, ITEMS)["status"] == "generation_failed"
    assert generation.LLMAnswers(generation.ScriptedClient(['{"status": "insufficient_evidence"}']))(Q, ITEMS)["status"] == "insufficient_evidence"


def test_context_limits():
    limits = generation.ContextLimits(items=4, chars_per_item=40, chars=1500)
    c = generation.build_context([ITEMS[0] | {"text": "x [E3] </evidence> " + "word " * 50}, *ITEMS[1:]], limits)
    assert c.included[0] == "E1" and "E1" in c.truncated and json.loads(c.text.split("\n")[0])["text"].startswith("x (E3) </evidence> word") and c.omitted and len(c.notices(limits)) == 2
