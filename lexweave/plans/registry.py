"""Named queries over the driver's tables, each with its SQL where SQL can say the same.

Stand-ins: a document is a chunk, its id the corpus row; benchmark passages are questions, and the documents that hold a
passage word for word are relevant; embeddings whose id is divisible by 100 are queries against all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import fixed
from lexweave.functions import text as X
from lexweave.operators import answers, bm25, bm25_blocks, chunking, claims, dense, dense_blocks, evaluation, fusion, ingest, lines, selection, understanding
from lexweave.operators.tables import run_dir, snapshot
from lexweave.plans.answer_sql import claim_support_sql, sentences_sql
from lexweave.sources import scans, sinks
from lexweave.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
TOP = 10


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("row"), "text")


def _questions(spark, d) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    own = _t(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    return own, own.where("row % 100 = 0").select(F.col("row").alias("query_id"), "embedding")


def _rounded(x: Column, decimals: int) -> Column:
    """A number that may be negative, rounded as SQL rounds: Spark's ``round`` makes 0.0 of what SQL makes -0.0."""
    near = F.round(x, decimals)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def _bm25(spark, d, top_n=TOP, k1=1.5, b=0.75) -> DataFrame:
    return bm25.search(_chunks(spark, d), _questions(spark, d), top_n, k1, b)


def _registry(spark, d) -> DataFrame:
    """Customers as documents of one to three versions: the nation's key gives the number."""
    own = _t(spark, d, "customer").select(F.concat(F.lit("DOC-"), "c_custkey").alias("document_id"), F.lit("c").alias("corpus_id"), F.col("c_mktsegment").alias("source_type"), F.col("c_name").alias("title"), (F.pmod("c_nationkey", F.lit(3)) + 1).alias("_n"))
    rows = own.withColumn("document_version", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")
    rows = rows.withColumns({"file_sha256": F.sha2(F.concat_ws("@", "title", "document_version"), 256), "source_date": F.lit("2020-01-01").cast("date"), "replaced_by": F.lit(None).cast("string")})
    return ingest.relinked(rows)


_REGISTRY_SQL = """
base AS (SELECT 'DOC-' || c_custkey AS document_id, c_mktsegment AS source_type, c_name AS title, unnest(range(1, c_nationkey % 3 + 2)) AS document_version FROM customer),
registry AS (SELECT *, sha256(title || '@' || document_version) AS file_sha256,
  CASE WHEN lead(document_version) OVER w IS NOT NULL THEN document_id || '@v' || lead(document_version) OVER w END AS replaced_by FROM base WINDOW w AS (PARTITION BY document_id ORDER BY document_version))"""


def count_tokens(s, d):
    return _chunks(s, d).select("row", X.count_tokens(F.col("text")).alias("token_count"))


def tokenize_tf(s, d):
    return bm25.term_frequencies(_chunks(s, d))


def doc_lengths(s, d):
    return bm25.chunk_lengths(_chunks(s, d))


def doc_frequency(s, d):
    return bm25.document_frequency(bm25.term_frequencies(_chunks(s, d)))


def bm25_topk(s, d):
    return _bm25(s, d).select("query_id", "row", F.round("score", 6).alias("score"), "rank")


def dense_topk(s, d):
    return dense.top_rows(*_vectors(s, d), TOP).select("query_id", "row", _rounded(F.col("score"), 6).alias("score"), "rank")


def saved_vectors_topk(s, d):
    """A search of vectors that are saved in blocks around centroids."""
    vectors, asked = _vectors(s, d)
    root = f"{run_dir(s)}/vectors-{uuid.uuid4().hex}"
    sinks.publish({"vectors": dense_blocks.blocked(vectors, dense_blocks.fit_centroids(vectors, 32), 256)}, root)
    return dense_blocks.search(sinks.load_published(s, root, "vectors"), asked, TOP).select("query_id", "row", _rounded(F.col("score"), 6).alias("score"), "rank")


def rrf_fusion(s, d):
    terms = bm25.query_terms(_questions(s, d))
    counts = bm25.question_counts(_chunks(s, d), terms)
    fused = fusion.reciprocal_rank_fusion([bm25.search_counts(counts, terms, 20), bm25.search_counts(counts, terms, 20, 1.2, 0.0)], 60, [1.0, 0.5], TOP)
    return fused.select("query_id", "row", F.round("score", 9).alias("score"), "best_rank", "rank")


def hybrid_topk(s, d):
    """BM25 over documents with inner products of the vectors of the same numbers; a question's vector is that of its number."""
    vectors = _vectors(s, d)[0]
    asked = vectors.join(_questions(s, d).select(F.col("query_id").alias("row")), "row", "left_semi").withColumnRenamed("row", "query_id")
    hits = fusion.hybrid(_bm25(s, d, 20), dense.top_rows(vectors, asked, 20), TOP)
    return hits.select("query_id", "row", "rank", "bm25_rank", "dense_rank")


def _judged(s, d):
    hits = _bm25(s, d)
    texts = fusion.materialize_hits(hits, _chunks(s, d)).join(_questions(s, d), "query_id")
    return texts.select("query_id", "rank", "score", F.contains("text", "query").alias("relevant"))


def _kinds(s, d):
    return _questions(s, d).select("query_id", F.when(F.pmod("query_id", F.lit(7)) == 0, "out_of_scope").when(F.pmod("query_id", F.lit(2)) == 0, "case").otherwise("provision").alias("kind"))


def first_relevant_rank(s, d):
    return evaluation.first_relevant(_kinds(s, d), _judged(s, d))


def retrieval_summary(s, d):
    return evaluation.summary(evaluation.first_relevant(_kinds(s, d), _judged(s, d)))


def score_separation(s, d):
    top = _bm25(s, d, 1).select("query_id", "score")
    return evaluation.score_separation(_kinds(s, d).join(top, "query_id"))


def _page_texts(texts):
    """Texts of one document as pages of 15 lines; rows with one id are read as one, line by line."""
    cut = lambda n, page: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 15).cast("int")), page)
    single = X.let(F.split(F.get(texts, F.lit(0)), "\n"), lambda ls: cut(F.size(ls), lambda p: F.array_join(F.slice(ls, p * 15 + 1, F.lit(15)), "\n")))
    rows = F.array_sort(F.flatten(F.transform(texts, lambda t: F.transform(F.split(t, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("line"))))))
    several = X.let(rows, lambda xs: cut(F.array_max(F.transform(xs, lambda x: x["i"])) + 1, lambda p: F.array_join(F.transform(F.filter(xs, lambda x: F.floor(x["i"] / 15) == p), lambda x: x["line"]), "\n")))
    return F.when(F.size(texts) == 1, single).when(F.size(texts) > 1, several)


def _document_texts(s, d):
    return _t(s, d, "documents").select(F.concat(F.lit("D"), "doc_id").alias("document_id"), F.lit(1).alias("document_version"), "text")


def _pages(s, d):
    """Documents as pages of 15 lines."""
    own = _document_texts(s, d).groupBy("document_id", "document_version").agg(F.collect_list("text").alias("texts"))
    paged = own.select("document_id", "document_version", F.posexplode(_page_texts(F.col("texts"))).alias("p", "text"))
    return paged.select("document_id", "document_version", (F.col("p") + 1).alias("page_number"), "text", F.lit(None).cast("string").alias("page_label"))


def running_lines(s, d):
    return lines.running_lines(lines.page_lines(_pages(s, d))).where("pages > 1").select("document_id", "key", "pages")


def kept_lines(s, d):
    return lines.document_lines(_pages(s, d)).groupBy("document_id").agg(F.count("*").alias("lines"))


def _all_chunks(s, d):
    pages = _pages(s, d)
    registry = _document_texts(s, d).where("text IS NOT NULL").select("document_id", "document_version").distinct().withColumns({"corpus_id": F.lit("c"), "source_type": F.lit("user_document"), "source_url": F.lit("u"), "title": F.col("document_id"), "replaced_by": F.lit(None).cast("string")})
    return chunking.chunk_documents(pages, registry, chunking.ChunkLimits(200, 250, 40))


def chunk_documents(s, d):
    return _all_chunks(s, d).select("chunk_id", "chunk_index", "page_start", "page_end", "text", "token_count", "chunking_method")


def _turns(s, d):
    """Turns of conversations as chunks: the role is the method, the turn the page."""
    own = _t(s, d, "conversations")
    return own.select(F.col("conv_id").alias("document_id"), F.lit(1).alias("document_version"), F.col("role").alias("chunking_method"), F.col("turn").alias("chunk_index"), X.count_tokens(F.col("text")).alias("token_count"), F.col("turn").alias("page_start"), F.col("turn").alias("page_end"), "text", F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))


def chunk_report(s, d):
    return chunking.chunk_report(_all_chunks(s, d))


def opening_texts(s, d):
    return understanding.opening_texts(_turns(s, d), 200)


def invalid_chunks(s, d):
    """Every third turn begins a page after its end, system turns claim an article."""
    own = _turns(s, d).withColumns({"page_start": F.col("page_start") + (F.pmod("chunk_index", F.lit(3)) == 2).cast("int"), "article_number": F.when(F.col("chunking_method") == "system", "1"), "source_type": F.lit("judgment")})
    return chunking.invalid_chunks(own)


def stale_rows(s, d):
    """The stored order of documents against one in which every tenth is another and the first hundred are missing."""
    own = _t(s, d, "documents").select(F.col("doc_id").alias("row"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"))
    now = own.select("row", F.when(F.col("row") % 10 == 3, F.concat("chunk_id", F.lit("x"))).otherwise(F.col("chunk_id")).alias("chunk_id")).where("row >= 100")
    return chunking.stale_rows(own, now)


def page_problems(s, d):
    """Lines of orders as pages; an order says that it has as many as its key's last digit."""
    pages = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("document_version"), F.col("l_linenumber").alias("page_number"), F.lit("c").alias("corpus_id"), F.lit("text").alias("text"), (F.col("l_linenumber") == 9).alias("is_empty"))
    orders = _t(s, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("document_version"), (F.col("o_orderkey") % 10).alias("page_count"), F.lit("c").alias("corpus_id"))
    return ingest.page_problems(pages, orders).select("document_id", "problem")


def duplicate_sources(s, d):
    """Pages as a manifest by their URLs without what stands behind the path."""
    own = _t(s, d, "pages").select(F.lit("judgment").alias("source_type"), F.regexp_replace("url", "/[^/]*$", "/").alias("source_url"))
    return ingest.duplicate_sources(own)


def undated_sources(s, d):
    kinds = F.when(F.col("lang") == "en", "judgment").when(F.col("lang") == "de", "constitutional_text").otherwise("user_document")
    own = _t(s, d, "documents").select("doc_id", kinds.alias("source_type"), F.when(F.col("doc_id") % 3 > 0, F.lit("2020-01-01")).cast("date").alias("source_date"))
    return ingest.undated(own).select("doc_id", "source_type")


def version_titles(s, d):
    """The registry after new titles have come for every fifth document."""
    own = _registry(s, d).withColumn("ingestion_date", F.lit(None).cast("timestamp")).withColumn("source_url", F.lit("u"))
    latest = ingest.latest_versions(own)
    fresh = latest.where("cast(substring(document_id, 5) AS BIGINT) % 5 = 0").select("document_id", F.concat("title", F.lit("*")).alias("title"), "file_sha256", "source_date", F.lit(None).cast("string").alias("error"))
    return ingest.apply_ingest(own, ingest.plan_ingest(own, fresh)).select("document_id", "document_version", "title", "replaced_by")


def saved_registry(s, d):
    """The registry written as JSON and loaded again."""
    folder = f"{run_dir(s)}/registry-{uuid.uuid4().hex}"
    sinks.write_registry(_registry(s, d), folder)
    return scans.load_registry(s, folder).select("document_id", "document_version", "title", "file_sha256", "replaced_by")


def save_index(s, d, root):
    """The documents' index, published under ``root``."""
    chunks = _chunks(s, d)
    with bm25_blocks.built(chunks) as (blocks, stats):
        sinks.save_indexes(chunks, blocks, stats, None, root, "f")


def search_index(s, d, root):
    """The passages' best rows in a published index, loaded with its fingerprint."""
    index = sinks.load_indexes(s, root, "f")
    hits = bm25_blocks.search(index["postings"], index["stats"], bm25.query_terms(_questions(s, d)), TOP)
    return hits.select("query_id", "row", F.round("score", 6).alias("score"), "rank")


def saved_index_topk(s, d):
    root = f"{run_dir(s)}/index-{uuid.uuid4().hex}"
    save_index(s, d, root)
    return search_index(s, d, root)


def accepted_uploads(s, d):
    """Pages as uploads: the id's last digit gives the ending, pages of ids under 20 are there already."""
    own = _t(s, d, "pages").select("page_id", F.concat(F.lit("f"), F.when(F.col("page_id") % 10 == 7, ".exe").when(F.col("page_id") % 10 == 8, ".PDF").otherwise(".pdf")).alias("filename"), F.octet_length(F.coalesce("html", F.lit(""))).alias("length"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("file_sha256"))
    return scans.accept_uploads(own, own.where("page_id < 20"), 5000).select("page_id", "status", "reason")


def reranked_topk(s, d):
    """The best ten of BM25 by the share of the question's words that they hold."""
    pairs = fusion.materialize_hits(_bm25(s, d), _chunks(s, d)).join(_questions(s, d), "query_id")
    return fusion.rank_scores(dense.rerank(pairs, dense.OverlapScorer())).select("query_id", "row", F.round("score", 9).alias("score"), "rank")


def best_similarity(s, d):
    """Each queried vector against the vectors of its own label."""
    own = _t(s, d, "embeddings")
    asked = own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    passages = asked.select("query_id", "label").join(own.select("vec_id", "label", "embedding"), "label").where("vec_id <> query_id").select("query_id", "embedding")
    return dense.best_similarity(asked.select("query_id", "embedding"), passages).select("query_id", _rounded(F.col("score"), 6).alias("score"))


def reused_vectors(s, d):
    """Which chunks keep their vector: those cached by the same model at the same size."""
    own = _t(s, d, "embeddings")
    chunks = own.select(F.col("vec_id").cast("string").alias("chunk_id"), F.lit("word").alias("text"))
    marked = F.transform("embedding", lambda x: F.lit(2.0).cast("float"))
    cached = own.where("label < 5").select(F.col("vec_id").cast("string").alias("chunk_id"), marked.alias("embedding"), F.when(F.col("vec_id") % 2 == 0, "hashing-64").otherwise("other").alias("model"))
    return dense.embed_missing(chunks, cached, dense.HashingEmbedder()).select("chunk_id", (F.element_at("embedding", 1) == 2.0).alias("reused"), F.size("embedding").alias("dim"))


def _letters(column, letters):
    return F.translate(column.cast("string"), "0123456789", letters)


def known_cases(s, d):
    """Parts as a library of cases, first turns of conversations with the name of the part of their number as uploads."""
    library = _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.concat(F.lit("matter kesho"), _letters(F.col("p_partkey"), "klmnopqrst")).alias("title"))
    opening = F.concat("text", F.lit(" kesho"), _letters(F.col("conv_id"), "klmnopqrst"))
    uploads = _t(s, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("document_id"), opening.alias("opening"))
    return understanding.known_cases(uploads, library)


def answer_rates(s, d):
    """Turns as answers: those of assistants are answered, those of users refused."""
    own = _t(s, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), F.when(F.col("conv_id") % 3 == 0, "out_of_scope").otherwise("case").alias("kind"), F.when(F.col("role") == "assistant", "answered").otherwise("insufficient_evidence").alias("status"))
    rates = evaluation.answer_rates(own)
    return rates.select("answered_share", "refused_share", F.size("not_answered").alias("not_answered"), F.size("not_refused").alias("not_refused"))


def question_problems(s, d):
    """Documents as evaluation questions: the language is the kind, texts of copies have one id."""
    kind = F.when(F.col("lang") == "en", "case").when(F.col("lang") == "de", "provision").when(F.col("lang") == "fr", "out_of_scope").otherwise(F.col("lang"))
    some = lambda n: F.when(F.col("doc_id") % n == 0, F.array(F.lit("d"))).otherwise(F.array().cast("array<string>"))
    own = _t(s, d, "documents").select(F.sha2("text", 256).alias("id"), kind.alias("kind"), some(2).alias("relevant_documents"), some(3).alias("relevant_articles"))
    return evaluation.question_problems(own).distinct()


def relevant_rows(s, d):
    """Documents as hits, judgments or articles by their number, of questions of two kinds."""
    own = _t(s, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "case").otherwise("provision").alias("kind"), F.concat(F.lit("d"), F.col("doc_id") % 7).alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "constitutional_text").otherwise("judgment").alias("source_type"), (F.col("doc_id") % 5).cast("string").alias("article"))
    ok = evaluation.is_relevant(F.col("kind"), F.array(F.lit("d1"), F.lit("d2")), F.array(F.lit("3"), F.lit("4")), F.col("document_id"), F.col("source_type"), F.col("article"))
    return own.select("doc_id", ok.alias("relevant"))


def provision_lookups(s, d):
    """Questions that cite articles against chunks that are articles."""
    chunks = _t(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.when(F.col("l_returnflag") == "R", "constitutional_text").otherwise("judgment").alias("source_type"), F.col("l_suppkey").cast("string").alias("article_number"))
    asked = _questions(s, d).select("query_id", F.array(F.col("query_id").cast("string"), F.lit("7")).alias("articles"))
    return selection.provision_lookup(asked, chunks)


def case_lookups(s, d):
    """Two headnotes of a named case, else its first chunk: orders are cases, their returned lines headnotes."""
    chunks = _t(s, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_id"), F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("row"), F.lit("front_matter").alias("division"), F.when(F.col("l_returnflag") == "R", " held").alias("heading"))
    asked = _questions(s, d).select("query_id", F.array(F.col("query_id").cast("string"), (F.col("query_id") + 100).cast("string")).alias("case_document_ids"))
    return selection.case_lookup(asked, chunks)


def latest_version(s, d):
    return ingest.latest_versions(_registry(s, d)).select("document_id", "document_version", "title")


def current_versions(s, d):
    return ingest.current_versions(_registry(s, d)).select("document_id", "document_version")


def relink_versions(s, d):
    return _registry(s, d).select("document_id", "document_version", "replaced_by")


def change_detection(s, d):
    """Every fifth customer comes with a new title, every seventh is new, every eleventh cannot be read."""
    own = ingest.latest_versions(_registry(s, d)).withColumn("k", F.substring("document_id", 5, 20).cast("long"))
    incoming = own.select(F.when(F.col("k") % 7 == 0, F.concat(F.lit("NEW-"), "k")).otherwise(F.col("document_id")).alias("document_id"), F.when(F.col("k") % 5 == 0, F.concat("title", F.lit("*"))).otherwise(F.col("title")).alias("title"), "file_sha256", "source_date", F.when(F.col("k") % 11 == 0, "unreadable").alias("error"))
    return ingest.plan_ingest(_registry(s, d), incoming).select("document_id", "outcome", "document_version")


def orphan_rows(s, d):
    """Orders are document rows, customers with a positive balance the registry."""
    orders = _t(s, d, "orders").select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("document_version"), "o_orderkey")
    known = _t(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"), F.lit(1).alias("document_version"))
    return ingest.keep_registered(orders, known).select("document_id", "o_orderkey")


def missing_versions(s, d):
    """Customers without an order of over 300,000."""
    orders = _t(s, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("document_id"), F.lit(1).alias("document_version"))
    known = _t(s, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(1).alias("document_version"))
    return ingest.missing_versions(known, orders)


def corpus_counts(s, d):
    docs = _t(s, d, "documents").select(F.col("source").alias("corpus_id"), F.lit(None).cast("string").alias("replaced_by"))
    return ingest.corpus_counts(docs, _t(s, d, "documents").where("n_chars > 500").select(F.col("source").alias("corpus_id")))


def content_hash_ids(s, d):
    own = _t(s, d, "pages")
    ident = ingest.document_id(F.lit("c"), F.lit("judgment"), F.col("url"))
    return own.select("page_id", ident.alias("document_id"), ingest.chunk_id(ident, F.lit(1), F.col("page_id"), F.col("html")).alias("chunk_id"))


def normalize_urls(s, d):
    return _t(s, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url"))


def _passages(s, d) -> DataFrame:
    """Benchmark passages, whole, as titles."""
    return _t(s, d, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("document_id"), F.col("text").alias("title"))


def distinctive_tokens(s, d):
    titles = _t(s, d, "part").select(F.col("p_partkey").cast("string").alias("document_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return understanding.distinctive_tokens(titles.unionByName(_passages(s, d)))


def one_typo_pairs(s, d):
    """Words of conversations against the names in the passages."""
    asked = _t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return understanding.match_cases(asked, _passages(s, d)).select("query_id", "document_id", "word", "token", "corrected")


def term_coverage(s, d):
    hits = _bm25(s, d, 3).select("query_id", "row").join(_chunks(s, d), "row").join(_questions(s, d), "query_id")
    terms = F.array_distinct(X.tokens(F.col("query")))
    return hits.select("query_id", "row", F.round(X.coverage(terms, F.col("text"), F.array().cast("array<string>")), 6).alias("coverage"))


def light_stems(s, d):
    own = bm25.document_frequency(bm25.term_frequencies(_chunks(s, d)))
    return own.select("term", X.light_stem(F.col("term")).alias("stem"))


def claim_stems(s, d):
    own = bm25.document_frequency(bm25.term_frequencies(_chunks(s, d)))
    return own.select("term", X.claim_stem(F.col("term")).alias("stem"))


def article_refs(s, d):
    own = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("See Articles "), F.col("l_linenumber"), F.lit("(1)(g), "), F.col("l_partkey") % 400, F.lit("A and "), F.col("l_linenumber"), F.lit(" or art. 21 of "), F.col("l_shipmode") if "l_shipmode" in _t(s, d, "lineitem").columns else F.col("l_returnflag")).alias("q"))
    found = own.select("l_orderkey", "l_linenumber", X.article_refs(F.col("q")).alias("refs"))
    return found.select("l_orderkey", "l_linenumber", F.array_join("refs", "|").alias("refs"), F.array_join(X.articles_of(F.col("refs")), "|").alias("articles"))


def article_mentions(s, d):
    own = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Under Arts. 14, "), F.col("l_linenumber"), F.lit(" and 21 of 3")).alias("q"))
    return own.select("l_orderkey", "l_linenumber", *[X.mentions_article(F.col("q"), F.lit(a)).alias(f"a{a}") for a in ("3", "7", "21")])


def capped_selection(s, d):
    """Orders are questions, their lines candidates; returned lines play constitutional text.  Line numbers repeat in an order, so a row's number has part and supplier too."""
    li = _t(s, d, "lineitem")
    scored = li.select(
        F.col("l_orderkey").alias("query_id"), F.lit("general").alias("query_type"), F.when(F.col("l_returnflag") == "R", "constitutional_text").otherwise("judicial").alias("role"), F.lit(False).alias("is_provision"), (F.col("l_partkey") % 5 == 0).alias("is_named_case"),
        F.pmod("l_suppkey", F.lit(2)).cast("string").alias("document_id"), (F.col("l_linenumber") % 2).alias("presentation_group"), F.col("l_quantity").alias("final_score"), F.col("l_linenumber").alias("rank"),
        (F.col("l_linenumber") * 10**15 + F.col("l_partkey") * 10**7 + F.col("l_suppkey")).alias("row"),
    )
    return selection.choose(scored, selection.EvidenceLimits(top_k=4)).select("query_id", "row", "evidence_id", "evidence_rank")


def canonical_texts(s, d):
    own = _t(s, d, "conversations")
    return own.select("conv_id", "turn", X.normalize_space(F.col("text")).alias("spaced"), X.canonical_claim(F.col("text")).alias("claim"), X.canonical_quote(F.col("text")).alias("quote"), X.truncate_words(X.normalize_space(F.col("text")), 60).alias("short"))


def evidence_markers(s, d):
    own = _t(s, d, "conversations").select("conv_id", "turn", F.concat("text", F.lit(" [E1, E2] and ["), F.lit("E"), F.col("turn"), F.lit("] .")).alias("q"))
    return own.select("conv_id", "turn", F.array_join(X.marker_ids(F.col("q")), ",").alias("ids"), X.strip_markers(F.col("q")).alias("text"))


def normalized_vectors(s, d):
    own = _t(s, d, "embeddings")
    return own.select("vec_id", F.transform(dense.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)), lambda x: _rounded(x, 6)).alias("unit"))


def event_windows(s, d):
    return streaming.windowed_counts(_t(s, d, "events")).select("window_start", "event_type", "n", _rounded(F.col("total"), 4).alias("total"))


def event_sessions(s, d):
    return streaming.sessions(_t(s, d, "events"))


def sentence_split(s, d):
    """Sentences of whole conversations, and of whole documents as turn -1."""
    own = _t(s, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text").unionByName(_t(s, d, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), "text"))
    return own.select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("place", "sentence"))


def claim_support(s, d):
    """Passages as claims about the three best documents, which they cite: as they are, in another order, denied, under a stranger's name, and with an item that was not retrieved."""
    hits = snapshot(_bm25(s, d, 3).select("query_id", "row", "rank"), "hits")
    none = F.lit(None).cast("string")
    item = F.struct(F.concat(F.lit("E"), "rank").alias("evidence_id"), "text", F.lit("").alias("document_title"), F.lit("user_document").alias("source_type"), none.alias("case_name"), none.alias("article_title"), none.alias("article_number"), none.alias("heading"), F.lit(None).cast("date").alias("source_date"))
    evidence = fusion.materialize_hits(hits, _chunks(s, d)).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    ids = F.transform("evidence", lambda e: e["evidence_id"])
    words = F.split("query", " ")
    turned = F.array_join(F.concat(F.slice(words, 2, F.size(words)), F.slice(words, 1, 1)), " ")
    said = {"a": (F.col("query"), ids), "b": (turned, ids), "c": (F.concat(F.lit("never "), turned), ids), "d": (F.concat(turned, F.lit(" by Qqzz")), ids), "e": (F.col("query"), F.array_append(ids, F.lit("E9")))}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("claim"), i.alias("ids")) for k, (c, i) in said.items()]))
    rows = evidence.join(_questions(s, d), "query_id").select("query_id", "evidence", kinds.alias("k")).select(F.concat_ws(".", "query_id", "k.kind").alias("claim_id"), "k.claim", F.col("k.ids").alias("citation_ids"), "evidence")
    return claims.check_claims(rows).select("claim_id", "status", F.round("score", 4).alias("score"), F.round("coverage", 4).alias("coverage"), "rule", F.array_join("supporting_ids", ",").alias("supporting"))


def _titles(s, d) -> DataFrame:
    """Whole texts stand in for titles."""
    return _t(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.col("text").alias("title"))


def question_analysis(s, d):
    return understanding.analyze(_questions(s, d), _titles(s, d))


def _citing_questions(s, d) -> DataFrame:
    """The passages, and for each a further question, of a negative id, for the article of its number."""
    own = _questions(s, d)
    return own.unionByName(own.select((-1 - F.col("query_id")).alias("query_id"), F.concat(F.lit("Article "), "query_id").alias("query")))


def evidence_selection(s, d):
    """Documents of src0 are articles of a constitution, numbered in turn; all others are judgments, known by their titles."""
    docs = _t(s, d, "documents")
    article = F.col("source") == "src0"
    none = F.lit(None).cast("string")
    chunks = docs.select(F.col("doc_id").alias("row"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit(1).alias("document_version"), F.when(article, "constitutional_text").otherwise("judgment").alias("source_type"), "text",
                         F.when(article, F.floor(F.col("doc_id") / 20).cast("string")).alias("article_number"), F.when(~article, F.col("text")).alias("case_name"),
                         *[none.alias(c) for c in ("article_title", "heading", "opinion_author", "division", "page_label_start", "page_label_end", "part", "chapter")], F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit("u").alias("source_url"))
    registry = chunks.select("document_id", "document_version", F.col("text").alias("title"), F.lit(None).cast("date").alias("source_date"))
    judgments = chunks.where("source_type = 'judgment'").select("document_id")
    # tables of their own: what follows reads them many times
    analysis = snapshot(understanding.analyze(_citing_questions(s, d), _titles(s, d).join(judgments, "document_id", "left_semi")), "analysis")
    hits = bm25.search(_chunks(s, d), _citing_questions(s, d), 50).select("query_id", F.concat(F.lit("c"), "row").alias("chunk_id"), "rank", "score", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"), F.lit(None).cast("int").alias("dense_rank"), F.lit(None).cast("double").alias("dense_score"))
    return analysis, chunks, snapshot(selection.select_evidence(analysis, snapshot(hits, "hits"), chunks, registry), "evidence")


def selected_evidence(s, d):
    return evidence_selection(s, d)[2].select("query_id", "evidence_id", "chunk_id", "role", "origin", F.round("final_score", 6).alias("final_score"), F.round("term_coverage", 6).alias("term_coverage"))


def extractive_answers(s, d):
    analysis, chunks, evidence = evidence_selection(s, d)
    limits = selection.EvidenceLimits()
    questions = answers.questions_with_evidence(analysis, evidence, selection.notices(analysis, chunks), selection.assess_confidence(analysis, evidence, limits))
    return answers.answer_all(questions).select("query_id", "status", F.size("claims").alias("n_claims"), F.size("citations").alias("n_citations"), "rendered")


QUERIES: list[Query] = [
    count_tokens, tokenize_tf, doc_lengths, doc_frequency, bm25_topk, dense_topk, saved_vectors_topk, rrf_fusion, hybrid_topk, first_relevant_rank, retrieval_summary, score_separation, running_lines, kept_lines,
    chunk_documents, chunk_report, latest_version, current_versions, relink_versions, change_detection, orphan_rows, missing_versions, corpus_counts, content_hash_ids, normalize_urls,
    distinctive_tokens, one_typo_pairs, term_coverage, light_stems, claim_stems, article_refs, article_mentions, capped_selection, canonical_texts, evidence_markers, normalized_vectors,
    event_windows, event_sessions, sentence_split, claim_support, question_analysis, selected_evidence, extractive_answers, opening_texts, invalid_chunks, stale_rows, page_problems, duplicate_sources, undated_sources, version_titles, saved_registry,
    saved_index_topk, accepted_uploads, reranked_topk, best_similarity, reused_vectors, known_cases, answer_rates, question_problems, relevant_rows, provision_lookups, case_lookups,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}


# SQL

_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.STOPWORDS) + "]"


def _tokens_sql(column: str) -> str:
    found = rf"regexp_extract_all(lower(coalesce({column}, '')), '{fixed.REFERENCE}|[\p{{L}}\p{{N}}]+')"
    parts = r"regexp_extract_all(regexp_replace(t, '\s', '', 'g'), '\([0-9a-z]+\)')"
    steps = rf"list_transform(range(0, len({parts}) + 1), lambda i: regexp_extract(t, '^\d+[a-z]{{0,3}}') || array_to_string({parts}[1:i], ''))"
    return f"flatten(list_transform({found}, lambda t: CASE WHEN contains(t, '(') THEN {steps} WHEN list_contains({_STOP}, t) THEN [] ELSE [t] END))"


_TF = f"""tok AS (SELECT doc_id AS row, {_tokens_sql('text')} AS ts FROM documents),
tf AS (SELECT row, term, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(len) AS INTEGER) AS len FROM (SELECT row, len(ts) AS len, unnest(ts) AS term FROM tok) GROUP BY row, term)"""


def _bm25_sql(name: str, top: int, k1: float = 1.5, b: float = 0.75) -> str:
    return f"""{name}_s AS (SELECT q.query_id, tf.row, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / avgdl))) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term), stats GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row) AS INTEGER) AS rank FROM {name}_s) WHERE rank <= {top})"""


_INDEX = f"""{_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
q AS (SELECT item_id AS query_id, unnest(list_distinct({_tokens_sql('text')})) AS term FROM benchmark)"""
_KINDS = "kinds AS (SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN 'out_of_scope' WHEN item_id % 2 = 0 THEN 'case' ELSE 'provision' END AS kind FROM benchmark)"
_JUDGED = f"WITH {_INDEX}, {_bm25_sql('hits', TOP)}, {_KINDS}, firsts AS (SELECT h.query_id, min(rank) AS first_rank FROM hits h JOIN documents d ON d.doc_id = h.row JOIN benchmark b ON b.item_id = h.query_id WHERE contains(d.text, b.text) GROUP BY 1), ranks AS (SELECT k.query_id, kind, first_rank FROM kinds k LEFT JOIN firsts f ON f.query_id = k.query_id)"
_LISTS = f"WITH {_INDEX}, {_bm25_sql('one', 20)}, {_bm25_sql('two', 20, 1.2, 0.0)}"


def _fused(w1: float, w2: float) -> str:
    return f"""fused AS (SELECT query_id, row, sum(w / (60 + rank)) AS score, min(rank) AS best_rank FROM (SELECT query_id, row, rank, {w1} AS w FROM one UNION ALL SELECT query_id, row, rank, {w2} FROM two) GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best_rank, row) AS INTEGER) AS rank FROM fused) WHERE rank <= {TOP})"""


def _stem_sql(suffixes: list[str], least: int, restore: dict[str, str], light: bool) -> str:
    cases = " ".join(f"WHEN ends_with(term, '{s}') AND length(term) - {len(s)} >= {least}" + (" AND NOT ends_with(term, 'ss')" if light and s == "s" else "") + f" THEN left(term, -{len(s)}) || '{restore.get(s, '')}'" for s in suffixes)
    cut = f"CASE {cases} ELSE term END"
    final = "CASE WHEN length(c) > 4 AND ends_with(c, 'e') THEN left(c, -1) ELSE c END"
    whole = f"SELECT term, {final} AS stem FROM (SELECT term, CASE WHEN length(term) > 4 AND NOT regexp_matches(term, '[0-9]$') THEN {cut} ELSE term END AS c FROM terms)"
    strict = f"SELECT term, CASE WHEN regexp_matches(term, '[0-9]') OR length(term) <= 4 THEN term ELSE {final} END AS stem FROM (SELECT term, {cut} AS c FROM terms)"
    return f"WITH {_TF}, terms AS (SELECT DISTINCT term FROM tf) " + (whole if light else strict)


def _light_of_terms() -> str:
    """term and stem of every row of a table ``terms``."""
    return _stem_sql(fixed.LIGHT_SUFFIXES, 3, {"ied": "y", "ies": "y"}, True).split("FROM tf) ", 1)[1]


_PAGES = """src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), raw AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM src),
solid AS (SELECT doc_id, i // 15 AS p, trim(line) AS line, row_number() OVER (PARTITION BY doc_id, i // 15 ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id, i // 15) AS n FROM raw WHERE trim(line) <> ''),
keyed AS (SELECT *, (k < 2 OR k >= n - 2) AS at_edge, regexp_replace(regexp_replace(lower(line), '\\s+', ' ', 'g'), '\\d+', '#', 'g') AS key FROM solid)"""

_HEADER = r"(len(regexp_split_to_array(trim(line), '\s+')) <= 12 AND len(regexp_extract_all(line, '\p{L}')) > 0 AND len(regexp_extract_all(line, '\p{Lu}')) >= 0.7 * len(regexp_extract_all(line, '\p{L}')))"
_KEPT = f"""{_PAGES}, fuzz AS (SELECT *, left(regexp_replace(lower(line), '[^a-z]', '', 'g'), 12) AS fuzzy, {_HEADER} AS header FROM keyed),
total AS (SELECT doc_id, max(i) // 15 + 1 AS n_pages FROM raw GROUP BY 1),
running AS (SELECT doc_id, key, count(DISTINCT p) AS pages FROM fuzz WHERE at_edge GROUP BY 1, 2),
heads AS (SELECT doc_id, fuzzy FROM fuzz WHERE at_edge AND header AND length(fuzzy) >= 6 GROUP BY 1, 2 HAVING count(DISTINCT p) >= 3),
marked AS (SELECT f.doc_id, f.p, f.k, f.line, regexp_matches(line, '^[A-Ha-h]$') OR (h.fuzzy IS NOT NULL AND header) OR (at_edge AND (regexp_matches(line, '(?i){fixed.PAGE_NUMBER}')
  OR coalesce(len(string_split(f.key, ' ')) <= 12 AND r.pages >= 5 AND r.pages >= n_pages / 2.0, false))) AS gone
  FROM fuzz f JOIN total t ON t.doc_id = f.doc_id LEFT JOIN running r ON r.doc_id = f.doc_id AND r.key = f.key LEFT JOIN heads h ON h.doc_id = f.doc_id AND h.fuzzy = f.fuzzy)"""

_COUNT = r"len(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


def _chunks_sql(target: int, most: int, overlap: int) -> str:
    """Pages of documents without structure, packed piece by piece: ``chunks``."""
    words = r"string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ')"
    states = f"list_transform({words}, lambda w: {{'done': CAST([] AS VARCHAR[]), 'now': w, 'size': {_COUNT.format(c='w')}}})"
    merged = f"list_reduce({states}, lambda a, x: CASE WHEN a.size + x.size > {most} THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'size': x.size}} ELSE {{'done': a.done, 'now': a.now || ' ' || x.now, 'size': a.size + x.size}} END)"
    size = lambda a, b: f"(sums[{b} + 1] - sums[{a} + 1])"
    ends = f"greatest(begin + 1, list_max(list_filter(range(begin, n), lambda k: {size('begin', 'k')} <= {target})))"
    inside = f"list_max(list_filter(range(begin + 1, n), lambda k: clean[k + 1] AND {size('begin', 'k')} BETWEEN {max(target // 2, 1)} AND {target}))"
    ahead = f"list_min(list_filter(range(begin + 1, n), lambda k: clean[k + 1] AND {size('begin', 'k')} BETWEEN {target + 1} AND {most}))"
    cut = f"CASE WHEN {size('begin', 'n')} <= {most} THEN n ELSE coalesce({inside}, {ahead}, {ends}) END"
    back = f"coalesce(list_min(list_filter(range(begin + 1, cut + 1), lambda k: {size('k', 'cut')} <= {overlap})), cut)"
    return f"""{_KEPT}, long_ AS (SELECT doc_id, p, k, line, {_COUNT.format(c='line')} AS tokens FROM marked WHERE NOT gone),
wrapped AS (SELECT doc_id, p, k, line, CASE WHEN tokens <= {most} THEN [line] ELSE list_transform([{merged}], lambda m: list_append(m.done, m.now))[1] END AS ws FROM long_ WHERE tokens > 0),
parts AS (SELECT doc_id, p, k, line, unnest(range(len(ws))) AS part, unnest(ws) AS text FROM wrapped),
own AS (SELECT *, {_COUNT.format(c='text')} AS tokens, part = 0 AND (regexp_matches(line, '^(?:{fixed.NUMBERED_PARAGRAPH}|{fixed.CLAUSE})') OR coalesce(regexp_matches(lag(text) OVER (PARTITION BY doc_id ORDER BY p, k, part), '{fixed.TERMINAL.replace("'", "''")}'), false)) AS clean FROM parts),
docs AS MATERIALIZED (SELECT doc_id, count(*) AS n, list(text ORDER BY p, k, part) AS texts, list(p + 1 ORDER BY p, k, part) AS on_page, list(clean ORDER BY p, k, part) AS clean, list_prepend(0, list(upto ORDER BY p, k, part)) AS sums
  FROM (SELECT *, sum(tokens) OVER (PARTITION BY doc_id ORDER BY p, k, part ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM own) GROUP BY doc_id),
steps(doc_id, chunk_index, begin, cut) AS (SELECT doc_id, 0, 0::BIGINT, {cut.replace('begin', '0')} FROM docs
  UNION ALL SELECT doc_id, chunk_index + 1, begin, {cut} FROM (SELECT s.doc_id, chunk_index, {back} AS begin, d.n, d.sums, d.clean FROM steps s JOIN docs d ON d.doc_id = s.doc_id WHERE s.cut < d.n)),
chunks AS (SELECT s.doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(list_min(on_page[begin + 1:cut]) AS INTEGER) AS page_start, CAST(list_max(on_page[begin + 1:cut]) AS INTEGER) AS page_end, array_to_string(texts[begin + 1:cut], chr(10)) AS text,
  CAST(sums[cut + 1] - sums[begin + 1] AS INTEGER) AS token_count, 'fallback' AS chunking_method FROM steps s JOIN docs d ON d.doc_id = s.doc_id)"""


_SPACED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_PLAIN_QUOTES = "'" + "''" * 2 + '""--' + "'"
_NAME_WORDS = "SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS token FROM titles"
_GENERIC = "(" + ", ".join(f"'{w}'" for w in fixed.GENERIC_NAME_TOKENS) + ")"
_NAMES = f"names AS (SELECT token, min(document_id) AS document_id FROM ({_NAME_WORDS}) WHERE length(token) >= 4 AND token NOT IN {_GENERIC} GROUP BY token HAVING count(DISTINCT document_id) = 1)"

_DENSE_SQL = f"""SELECT query_id, row, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row) AS INTEGER) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id AS row, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {TOP}"""


def oracle_sql() -> dict[str, str]:
    return {
        "count_tokens": r"SELECT doc_id AS row, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER) AS token_count FROM documents",
        "sentence_split": f"""WITH t AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT doc_id, -1, text FROM documents), x AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {sentences_sql('text')} AS ss FROM t)
          SELECT conv_id, turn, CAST(unnest(range(len(ss))) AS INTEGER) AS place, unnest(ss) AS sentence FROM x""",
        "claim_support": claim_support_sql(_INDEX, _bm25_sql("hits", 3), _tokens_sql),
        "tokenize_tf": f"WITH {_TF} SELECT row, term, tf, len FROM tf",
        "doc_lengths": f"WITH {_TF} SELECT row, CAST(len(ts) AS INTEGER) AS len FROM tok",
        "doc_frequency": f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
        "bm25_topk": f"WITH {_INDEX}, {_bm25_sql('hits', TOP)} SELECT query_id, row, round(score, 6) AS score, rank FROM hits",
        "dense_topk": _DENSE_SQL,
        "saved_vectors_topk": _DENSE_SQL,
        "rrf_fusion": f"{_LISTS}, {_fused(1.0, 0.5)} SELECT query_id, row, round(score, 9) AS score, best_rank, rank FROM ranked",
        "hybrid_topk": f"""WITH {_INDEX}, {_bm25_sql('one', 20)}, two AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row) AS INTEGER) AS rank
          FROM (SELECT q.vec_id AS query_id, v.vec_id AS row, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark))) WHERE rank <= 20),
          {_fused(1.0, 1.0)} SELECT r.query_id, r.row, r.rank, one.rank AS bm25_rank, two.rank AS dense_rank FROM ranked r LEFT JOIN one ON one.query_id = r.query_id AND one.row = r.row LEFT JOIN two ON two.query_id = r.query_id AND two.row = r.row""",
        "first_relevant_rank": f"{_JUDGED} SELECT query_id, kind, first_rank FROM ranks",
        "retrieval_summary": f"""{_JUDGED}, own AS (SELECT kind AS "group", first_rank FROM ranks WHERE kind <> 'out_of_scope' UNION ALL SELECT 'all', first_rank FROM ranks WHERE kind <> 'out_of_scope')
          SELECT "group", count(*) AS n, {', '.join(f'round_even(avg(CASE WHEN first_rank <= {k} THEN 1.0 ELSE 0.0 END), 3) AS hit_at_{k}' for k in (1, 5, 10))}, round_even(avg(CASE WHEN first_rank <= 10 THEN 1.0 / first_rank ELSE 0.0 END), 3) AS mrr_at_10 FROM own GROUP BY 1""",
        "score_separation": f"""WITH {_INDEX}, {_bm25_sql('hits', 1)}, {_KINDS}, own AS (SELECT kind <> 'out_of_scope' AS a, score FROM hits JOIN kinds USING (query_id)), f AS (SELECT min(score) AS floor FROM own WHERE a)
          SELECT round_even(min(score) FILTER (a), 3) AS answerable_min, round_even(avg(score) FILTER (a), 3) AS answerable_mean, round_even(max(score) FILTER (a), 3) AS answerable_max, round_even(min(score) FILTER (NOT a), 3) AS out_of_scope_min,
          round_even(avg(score) FILTER (NOT a), 3) AS out_of_scope_mean, round_even(max(score) FILTER (NOT a), 3) AS out_of_scope_max, round_even(avg(CAST(score < floor AS DOUBLE)) FILTER (NOT a), 3) AS separated_share FROM own, f""",
        "running_lines": f"WITH {_PAGES} SELECT 'D' || doc_id AS document_id, key, count(DISTINCT p) AS pages FROM keyed WHERE at_edge GROUP BY doc_id, key HAVING count(DISTINCT p) > 1",
        "latest_version": f"WITH {_REGISTRY_SQL} SELECT document_id, CAST(max(document_version) AS INTEGER) AS document_version, max_by(title, document_version) AS title FROM registry GROUP BY 1",
        "current_versions": f"WITH {_REGISTRY_SQL} SELECT document_id, CAST(document_version AS INTEGER) AS document_version FROM registry WHERE replaced_by IS NULL",
        "relink_versions": f"WITH {_REGISTRY_SQL} SELECT document_id, CAST(document_version AS INTEGER) AS document_version, replaced_by FROM registry",
        "change_detection": f"""WITH {_REGISTRY_SQL}, own AS (SELECT *, CAST(substring(document_id, 5) AS BIGINT) AS k FROM registry WHERE replaced_by IS NULL)
          SELECT CASE WHEN k % 7 = 0 THEN 'NEW-' || k ELSE document_id END AS document_id,
          CASE WHEN k % 11 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'added' WHEN k % 5 = 0 THEN 'new_version' ELSE 'unchanged' END AS outcome,
          CAST(CASE WHEN k % 11 = 0 AND k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN document_version WHEN k % 7 = 0 THEN 1 WHEN k % 5 = 0 THEN document_version + 1 ELSE document_version END AS INTEGER) AS document_version FROM own""",
        "orphan_rows": "SELECT o_custkey AS document_id, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
        "missing_versions": "SELECT c_custkey AS document_id, CAST(1 AS INTEGER) AS document_version FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
        "corpus_counts": "SELECT source AS corpus_id, count(*) AS documents, count(*) FILTER (n_chars > 500) AS chunks FROM documents GROUP BY 1",
        "content_hash_ids": """WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '[?][^#]*') AS n FROM pages)
          SELECT page_id, 'JUDG-' || left(sha256('c|judgment|' || n), 12) AS document_id, 'JUDG-' || left(sha256('c|judgment|' || n), 12) || '@v1:' || printf('%04d', page_id) || ':' || left(sha256(html), 8) AS chunk_id FROM pages JOIN u USING (page_id)""",
        "normalize_urls": "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '[?][^#]*') AS url FROM pages",
        "distinctive_tokens": f"WITH titles AS (SELECT CAST(p_partkey AS VARCHAR) AS document_id, p_name || ' ' || p_type AS title FROM part UNION ALL SELECT 'b' || item_id, text FROM benchmark), {_NAMES} SELECT token, document_id FROM names",
        "one_typo_pairs": f"""WITH titles AS (SELECT 'b' || item_id AS document_id, text AS title FROM benchmark), {_NAMES}, words AS (SELECT DISTINCT conv_id * 1000 + turn AS query_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations),
          open_ AS (SELECT * FROM words WHERE word NOT IN (SELECT token FROM names) AND length(word) >= 6)
          SELECT query_id, document_id, word, token, false AS corrected FROM words JOIN names ON token = word
          UNION ALL SELECT query_id, document_id, word, min(token), true FROM open_ JOIN names ON left(word, 1) = left(token, 1) AND length(token) >= 6 AND abs(length(word) - length(token)) <= 1
          WHERE damerau_levenshtein(word, token) = 1 AND NOT starts_with(word, token) AND NOT starts_with(token, word) GROUP BY 1, 2, 3""",
        "kept_lines": f"WITH {_KEPT} SELECT 'D' || doc_id AS document_id, count(*) AS lines FROM marked WHERE NOT gone GROUP BY 1",
        "chunk_documents": f"WITH RECURSIVE {_chunks_sql(200, 250, 40)} SELECT 'D' || doc_id || '@v1:' || printf('%04d', chunk_index) || ':' || left(sha256(text), 8) AS chunk_id, chunk_index, page_start, page_end, text, token_count, chunking_method FROM chunks",
        "chunk_report": f"WITH RECURSIVE {_chunks_sql(200, 250, 40)} SELECT 'D' || doc_id AS document_id, chunking_method, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(page_start) AS first_page, max(page_end) AS last_page FROM chunks GROUP BY 1, 2",
        "opening_texts": "SELECT conv_id AS document_id, left(arg_min(text, turn), 200) AS opening FROM conversations GROUP BY 1",
        "invalid_chunks": "SELECT * FROM (SELECT conv_id || ':' || turn AS chunk_id, CASE WHEN turn % 3 = 2 THEN 'pages out of order' WHEN trim(text) = '' THEN 'blank text' WHEN role = 'system' THEN 'article outside constitutional text' END AS problem FROM conversations) WHERE problem IS NOT NULL",
        "stale_rows": "SELECT doc_id AS row FROM documents WHERE doc_id < 100 OR doc_id % 10 = 3",
        "page_problems": """WITH p AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS lo, max(l_linenumber) AS hi, count(DISTINCT l_linenumber) AS d, count(*) FILTER (l_linenumber = 9) AS f FROM lineitem GROUP BY 1)
          SELECT o_orderkey AS document_id, CASE WHEN NOT coalesce(lo = 1 AND hi = n AND d = n AND n = o_orderkey % 10, false) THEN 'pages are not numbered 1 to N' ELSE 'wrong empty flags' END AS problem
          FROM orders LEFT JOIN p ON k = o_orderkey WHERE NOT coalesce(lo = 1 AND hi = n AND d = n AND n = o_orderkey % 10, false) OR f > 0""",
        "duplicate_sources": """WITH u AS (SELECT regexp_replace(url, '/[^/]*$', '/') AS url FROM pages),
          n AS (SELECT lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '[?][^#]*') AS source FROM u)
          SELECT 'judgment' AS source_type, source FROM n GROUP BY source HAVING count(*) > 1""",
        "undated_sources": "SELECT doc_id, CASE lang WHEN 'en' THEN 'judgment' ELSE 'constitutional_text' END AS source_type FROM documents WHERE lang IN ('en', 'de') AND doc_id % 3 = 0",
        "version_titles": f"""WITH {_REGISTRY_SQL}, fresh AS (SELECT document_id, max(document_version) + 1 AS document_version, max_by(title, document_version) || '*' AS title FROM registry WHERE CAST(substring(document_id, 5) AS BIGINT) % 5 = 0 GROUP BY 1),
          both_ AS (SELECT document_id, document_version, title FROM registry UNION ALL SELECT * FROM fresh)
          SELECT document_id, CAST(document_version AS INTEGER) AS document_version, title, CASE WHEN lead(document_version) OVER w IS NOT NULL THEN document_id || '@v' || lead(document_version) OVER w END AS replaced_by FROM both_ WINDOW w AS (PARTITION BY document_id ORDER BY document_version)""",
        "saved_registry": f"WITH {_REGISTRY_SQL} SELECT document_id, CAST(document_version AS INTEGER) AS document_version, title, file_sha256, replaced_by FROM registry",
        "saved_index_topk": f"WITH {_INDEX}, {_bm25_sql('hits', TOP)} SELECT query_id, row, round(score, 6) AS score, rank FROM hits",
        "accepted_uploads": """WITH u AS (SELECT page_id, page_id % 10 = 7 AS exe, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
          r AS (SELECT *, CASE WHEN exe THEN 'Files of type .exe are not accepted.' WHEN n = 0 THEN 'The file is empty.' WHEN n > 5000 THEN 'The file is larger than 5000 bytes.' END AS reason FROM u)
          SELECT page_id, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN h IN (SELECT h FROM u WHERE page_id < 20) THEN 'unchanged' ELSE 'accepted' END AS status, reason FROM r""",
        "reranked_topk": f"""WITH {_INDEX}, {_bm25_sql('hits', TOP)}, qw AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM benchmark),
          dw AS (SELECT DISTINCT doc_id AS row, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents WHERE doc_id IN (SELECT row FROM hits)),
          s AS (SELECT h.query_id, h.row, h.rank, count(dw.w) * 1.0 / count(*) AS share FROM hits h JOIN qw ON qw.query_id = h.query_id LEFT JOIN dw ON dw.row = h.row AND dw.w = qw.w GROUP BY 1, 2, 3),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY share DESC, rank) AS k FROM s) SELECT query_id, row, round(1.0 / (60 + k), 9) AS score, CAST(k AS INTEGER) AS rank FROM r""",
        "best_similarity": "SELECT a.vec_id AS query_id, round(max(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY 1",
        "reused_vectors": "SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label < 5 AND vec_id % 2 = 0 AS reused, CAST(64 AS INTEGER) AS dim FROM embeddings",
        "known_cases": """WITH l AS (SELECT CAST(p_partkey AS VARCHAR) AS case_id, 'kesho' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'klmnopqrst') AS token FROM part),
          u AS (SELECT conv_id AS document_id, list_distinct(regexp_extract_all(lower(text || ' kesho' || translate(CAST(conv_id AS VARCHAR), '0123456789', 'klmnopqrst')), '[a-z]+')) AS ws FROM conversations WHERE turn = 0)
          SELECT document_id, case_id FROM (SELECT document_id, unnest(ws) AS token FROM u) JOIN l USING (token)""",
        "answer_rates": """WITH a AS (SELECT conv_id % 3 <> 0 AS ok, role = 'assistant' AS said FROM conversations)
          SELECT round_even(avg(CAST(said AS DOUBLE)) FILTER (ok), 3) AS answered_share, round_even(avg(CAST(NOT said AS DOUBLE)) FILTER (NOT ok), 3) AS refused_share, CAST(count(*) FILTER (ok AND NOT said) AS INTEGER) AS not_answered, CAST(count(*) FILTER (NOT ok AND said) AS INTEGER) AS not_refused FROM a""",
        "question_problems": """WITH q AS (SELECT sha256(text) AS id, lang, doc_id FROM documents) SELECT DISTINCT id, problem FROM (
          SELECT id, CASE WHEN lang IS NULL OR lang NOT IN ('en', 'de', 'fr') THEN 'unknown kind' WHEN lang = 'en' AND doc_id % 2 > 0 THEN 'no relevant documents' WHEN lang = 'de' AND doc_id % 3 > 0 THEN 'no relevant articles' END AS problem FROM q
          UNION ALL SELECT id, 'duplicate id' FROM q GROUP BY id HAVING count(*) > 1) WHERE problem IS NOT NULL""",
        "relevant_rows": "SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id % 7 IN (1, 2) ELSE doc_id % 3 = 0 AND doc_id % 5 IN (3, 4) END AS relevant FROM documents",
        "provision_lookups": "SELECT DISTINCT item_id AS query_id, l_orderkey || '-' || l_linenumber AS chunk_id FROM benchmark JOIN lineitem ON l_suppkey IN (item_id, 7) WHERE l_returnflag = 'R'",
        "case_lookups": """WITH o AS (SELECT item_id AS query_id, l_orderkey, l_linenumber, l_returnflag = 'R' AS head FROM benchmark JOIN lineitem ON l_orderkey IN (item_id, item_id + 100)),
          n AS (SELECT *, row_number() OVER (PARTITION BY query_id, l_orderkey ORDER BY head DESC, l_linenumber) AS k, bool_or(head) OVER (PARTITION BY query_id, l_orderkey) AS any_head FROM o)
          SELECT DISTINCT query_id, l_orderkey || '-' || l_linenumber AS chunk_id FROM n WHERE CASE WHEN any_head THEN head AND k <= 2 ELSE k = 1 END""",
        "term_coverage": f"""WITH {_INDEX}, {_bm25_sql('hits', 3)}, terms AS (SELECT DISTINCT term FROM tf UNION SELECT DISTINCT term FROM q), stems AS ({_light_of_terms()}),
          forms AS (SELECT DISTINCT row, term AS form FROM tf WHERE row IN (SELECT row FROM hits) UNION SELECT row, stem FROM tf JOIN stems USING (term) WHERE row IN (SELECT row FROM hits)),
          m AS (SELECT h.query_id, h.row, q.term, s.stem FROM hits h JOIN q ON q.query_id = h.query_id JOIN stems s ON s.term = q.term),
          e AS (SELECT m.*, a.form IS NOT NULL OR b.form IS NOT NULL AS hit FROM m LEFT JOIN forms a ON a.row = m.row AND a.form = m.term LEFT JOIN forms b ON b.row = m.row AND b.form = m.stem)
          SELECT query_id, row, round(avg(CAST(hit AS DOUBLE)), 6) AS coverage FROM e GROUP BY 1, 2""",
        "article_refs": "SELECT l_orderkey, l_linenumber, l_linenumber || '(1)(g)|' || l_partkey % 400 || 'A|' || l_linenumber || '|21' AS refs, l_linenumber || '|' || l_partkey % 400 || 'A|21' AS articles FROM lineitem",
        "canonical_texts": f"""WITH t AS (SELECT conv_id, turn, text, {_SPACED} AS spaced FROM conversations)
          SELECT conv_id, turn, spaced, trim(regexp_replace(regexp_replace(lower(text), '[“”"‘’''`]', '', 'g'), '[^\\p{{L}}\\p{{N}}_()]+', ' ', 'g')) AS claim, trim(regexp_replace(lower(translate(text, '’‘“”–—', {_PLAIN_QUOTES})), '\\s+', ' ', 'g')) AS quote,
          CASE WHEN length(spaced) <= 60 THEN spaced WHEN contains(left(spaced, 60), ' ') THEN regexp_replace(left(spaced, 60), ' [^ ]*$', '') || '{fixed.ELLIPSIS.rstrip()}' ELSE left(spaced, 60) || '{fixed.ELLIPSIS.rstrip()}' END AS short FROM t""",
        "light_stems": _stem_sql(fixed.LIGHT_SUFFIXES, 3, {"ied": "y", "ies": "y"}, True),
        "claim_stems": _stem_sql(fixed.CLAIM_SUFFIXES, 4, {"ied": "y", "ies": "y", "ural": "ure"}, False),
        "article_mentions": "SELECT l_orderkey, l_linenumber, l_linenumber = 3 AS a3, l_linenumber = 7 AS a7, true AS a21 FROM lineitem",
        "capped_selection": """WITH own AS (SELECT l_orderkey AS query_id, l_linenumber * 1000000000000000 + l_partkey * 10000000 + l_suppkey AS row, l_returnflag = 'R' AS c, l_suppkey % 2 AS d, l_partkey % 5 = 0 AS named, l_linenumber % 2 AS g, l_quantity AS s FROM lineitem),
          caps AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY g, s DESC, row) AS nc, row_number() OVER (PARTITION BY query_id, c, d ORDER BY g, s DESC, row) AS nd FROM own),
          kept AS (SELECT query_id, row, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, s DESC, row) AS INTEGER) AS r FROM caps WHERE CASE WHEN c THEN nc <= 2 ELSE named OR nd <= 2 END)
          SELECT query_id, row, 'E' || r AS evidence_id, r AS evidence_rank FROM kept WHERE r <= 4""",
        "evidence_markers": r"""SELECT conv_id, turn, array_to_string(CASE WHEN turn IN (1, 2) THEN ['E1', 'E2'] ELSE ['E1', 'E2', 'E' || turn] END, ',') AS ids,
          regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g') || ' and.'), '\s+([.;,?!])', '\1', 'g') AS text FROM conversations""",
        "normalized_vectors": "SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 3 / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * 3 * CAST(y AS DOUBLE) * 3))), 6)) AS unit FROM embeddings",
        "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        "event_sessions": """WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k""",
    }
