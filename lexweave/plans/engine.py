"""The service surface: corpora with a status, documents, builds, questions.  Control state is on the driver; data are tables."""

from __future__ import annotations

import hashlib
import json
import logging
import re
from collections import Counter
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import prose
from lexweave.operators import answers, bm25, bm25_blocks, chunking, claims, dense, dense_blocks, evaluation, fusion, generation, ingest, selection, understanding
from lexweave.operators.tables import snapshot
from lexweave.sources import sinks
from lexweave.sources.scans import PAGE_SCHEMA, REGISTRY_SCHEMA, PdfParser, accept_uploads, inspect_pdf, read_or_empty, scan_files, scan_pages, within_limits

RESERVED = "core"
#: An index has a centroid for each so many vectors as it has centroids, and no more than this: they are fitted on the driver.
MAX_CENTROIDS = 1024
log = logging.getLogger("lexweave")


class CorpusError(Exception):
    """Anything wrong with a corpus."""


class CorpusNotFoundError(CorpusError):
    pass


class CorpusExistsError(CorpusError):
    pass


class CorpusNotReadyError(CorpusError):
    pass


class CorpusBusyError(CorpusError):
    pass


class ReservedCorpusError(CorpusError):
    pass


class InvalidCorpusIdError(CorpusError):
    pass


class QueryError(ValueError):
    """The question or its settings cannot be used."""


@dataclass(frozen=True)
class RetrievalSettings:
    k1: float = 1.5
    b: float = 0.75
    top_bm25: int = 20
    top_dense: int = 20
    top_n: int = 20
    rrf_k: int = 60
    bm25_weight: float = 1.0
    dense_weight: float = 1.0

    def __post_init__(self):
        if self.bm25_weight < 0 or self.dense_weight < 0 or self.bm25_weight + self.dense_weight <= 0:
            raise ValueError("one weight must be over 0")


@dataclass(frozen=True)
class CorpusSettings:
    default: str = "core"


@dataclass(frozen=True)
class PathSettings:
    """Folders below the engine's root."""

    uploads: str = "uploads"
    indexes: str = "index"


@dataclass(frozen=True)
class LoggingSettings:
    level: str = "INFO"


@dataclass(frozen=True)
class UploadSettings:
    max_bytes: int = 20 << 20
    max_documents: int = 20
    max_total: int = 200 << 20
    max_pages: int = 500
    extensions: tuple[str, ...] = (".pdf",)


@dataclass(frozen=True)
class EmbeddingSettings:
    query_instruction: str = ""


@dataclass(frozen=True)
class RerankingSettings:
    enabled: bool = False
    candidates: int = 30


@dataclass(frozen=True)
class LLMSettings:
    provider: str = "none"
    model: str = ""
    retries: int = 1
    timeout_seconds: float = 60.0
    temperature: float = 0.0
    max_output_tokens: int = 1024


#: Least and largest of each setting; None: no bound.
BOUNDS: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "uploads": {"max_bytes": (1, None), "max_documents": (1, None), "max_total": (1, None), "max_pages": (1, None)},
    "reranking": {"candidates": (1, None)},
    "generation": {"items": (1, None), "chars_per_item": (200, None), "chars": (1000, None)},
    "llm": {"retries": (0, 3), "timeout_seconds": (1e-9, None), "temperature": (0, 2), "max_output_tokens": (16, None)},
    "validation": {"coverage": (1e-9, 1), "min_terms": (1, None), "contribution": (0, 1), "overlap": (1e-9, 1), "semantic_floor": (-1, 1), "semantic_threshold": (-1, 1), "semantic_coverage": (1e-9, 1)},
    "chunking": {"target": (50, None), "most": (50, None), "overlap": (0, None)},
    "retrieval": {"k1": (1e-9, None), "b": (0, 1), "top_bm25": (1, None), "top_dense": (1, None), "top_n": (1, None), "rrf_k": (1, None), "bm25_weight": (0, None), "dense_weight": (0, None)},
    "evidence": {"top_k": (1, None), "max_constitutional": (0, None), "max_per_document": (1, None), "provision_boost": (0, None), "case_boost": (0, None), "mention_boost": (0, None), "min_term_coverage": (0, 1), "min_dense_score": (-1, 1)},
    "quotes": {"sentences": (1, None), "chars": (80, None)},
}


def check_bounds(section: str, values: dict) -> None:
    """Refuse a number out of its bounds, and what is no number where one is asked for."""
    for name, (low, high) in BOUNDS.get(section, {}).items():
        value = values.get(name, low)
        if value is None:  # switched off
            continue
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (low is not None and value < low) or (high is not None and value > high):
            raise ValueError(f"{section}.{name} must be a number from {low} to {'any' if high is None else high}, not {value!r}")
    if section == "uploads" and not values.get("extensions", True):
        raise ValueError("uploads.extensions must name at least one ending")


@dataclass(frozen=True)
class Settings:
    corpus: CorpusSettings = field(default_factory=CorpusSettings)
    paths: PathSettings = field(default_factory=PathSettings)
    logging: LoggingSettings = field(default_factory=LoggingSettings)
    uploads: UploadSettings = field(default_factory=UploadSettings)
    embedding: EmbeddingSettings = field(default_factory=EmbeddingSettings)
    reranking: RerankingSettings = field(default_factory=RerankingSettings)
    generation: generation.ContextLimits = field(default_factory=generation.ContextLimits)
    llm: LLMSettings = field(default_factory=LLMSettings)
    validation: claims.SupportLimits = field(default_factory=claims.SupportLimits)
    chunking: chunking.ChunkLimits = field(default_factory=chunking.ChunkLimits)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    evidence: selection.EvidenceLimits = field(default_factory=selection.EvidenceLimits)
    quotes: answers.QuoteLimits = field(default_factory=answers.QuoteLimits)
    candidate_pool: int = 50

    @classmethod
    def load(cls, values: dict, env: dict[str, str] | None = None) -> Settings:
        """From nested values; ``LEXWEAVE_<SECTION>_<NAME>`` of ``env`` wins; unknown keys and values out of bounds are refused."""
        own = cls()
        known = {k: v for k, v in own.__dict__.items() if hasattr(v, "__dataclass_fields__")}
        for name, value in (env or {}).items():
            m = re.fullmatch(r"LEXWEAVE_([A-Z0-9]+)_([A-Z0-9_]+)", name)
            if m and m[1].lower() in known:
                values = values | {m[1].lower(): values.get(m[1].lower(), {}) | {m[2].lower(): json.loads(value)}}
        for section, part in values.items():
            if section == "candidate_pool":
                if isinstance(part, bool) or not isinstance(part, int) or part < 1:
                    raise ValueError("candidate_pool must be at least 1")
                own = replace(own, candidate_pool=part)
            elif section not in known or set(part) - set(asdict(known[section])):
                raise ValueError(f"unknown settings in {section}")
            else:
                check_bounds(section, part)
                own = replace(own, **{section: replace(known[section], **part)})
        return own


@dataclass
class Corpus:
    corpus_id: str
    title: str
    status: str = "uploaded"  # uploaded, processing, ready, failed
    reason: str | None = None
    report: dict | None = None  # of the last build: chunks, and vectors used again


class Engine:
    """Corpora under one root; each has its own directory, so a scan of one never reads another."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: dense.Embedder | None = None):
        self.spark, self.root, self.settings, self.embedder = spark, root.rstrip("/"), settings or Settings(), embedder
        try:
            saved = sinks.read_pointer(spark, f"{self.root}/corpora")
        except sinks.IndexNotFoundError:
            saved = {}
        self._corpora = {k: Corpus(**v) for k, v in saved.items()}
        self._builds: dict[str, Future] = {}
        self._worker: ThreadPoolExecutor | None = None
        log.setLevel(self.settings.logging.level)

    def _save(self) -> None:
        sinks.write_pointer(self.spark, f"{self.root}/corpora", {k: asdict(v) for k, v in self._corpora.items()})

    def _set(self, corpus: Corpus, status: str, reason: str | None = None) -> None:
        corpus.status, corpus.reason = status, reason
        self._save()
        log.info("corpus %s: %s%s", corpus.corpus_id, status, f" ({reason})" if reason else "")

    # corpora

    def create_corpus(self, corpus_id: str, title: str) -> Corpus:
        if not re.fullmatch(r"[a-z0-9](?:[a-z0-9-]{0,62}[a-z0-9])?", corpus_id):
            raise InvalidCorpusIdError(corpus_id)
        if corpus_id in self._corpora:
            raise CorpusExistsError(corpus_id)
        self._corpora[corpus_id] = Corpus(corpus_id, title)
        self._save()
        return self._corpora[corpus_id]

    def get_corpus(self, corpus_id: str) -> Corpus:
        if corpus_id not in self._corpora:
            raise CorpusNotFoundError(corpus_id)
        return self._corpora[corpus_id]

    def list_corpora(self) -> list[Corpus]:
        """The reserved corpus first, then by id."""
        return sorted(self._corpora.values(), key=lambda c: (c.corpus_id != RESERVED, c.corpus_id))

    def delete_corpus(self, corpus_id: str) -> None:
        if corpus_id == RESERVED:
            raise ReservedCorpusError(corpus_id)
        if self.get_corpus(corpus_id).status == "processing":
            raise CorpusBusyError(corpus_id)
        fs, p, _ = sinks._fs(self.spark, f"{self.root}/{corpus_id}")
        fs.delete(p, True)
        del self._corpora[corpus_id]
        self._save()

    def recover(self) -> None:
        """At start: what was processing when the driver ended has failed."""
        for c in self._corpora.values():
            if c.status == "processing":
                self._set(c, "failed", "The build was interrupted.")

    # tables

    def _table(self, corpus_id: str, name: str, schema: str) -> DataFrame:
        try:
            return sinks.load_published(self.spark, f"{self.root}/{corpus_id}/documents", name)
        except sinks.IndexNotFoundError:
            return read_or_empty(self.spark, f"{self.root}/{corpus_id}/none", schema)

    def registry(self, corpus_id: str) -> DataFrame:
        return self._table(corpus_id, "registry", REGISTRY_SCHEMA)

    def pages(self, corpus_id: str) -> DataFrame:
        return self._table(corpus_id, "pages", PAGE_SCHEMA)

    def add_documents(self, corpus_id: str, incoming: DataFrame, pages: DataFrame) -> DataFrame:
        """Versioned, idempotent ingest; returns what became of each document.

        ``incoming``: document_id, source_type, title, source_url, source_date, file_sha256, error.  ``pages``: document_id, page_number,
        text, page_label.  Nothing is written if nothing is new.
        """
        corpus = self.get_corpus(corpus_id)
        if corpus.status == "processing":
            raise CorpusBusyError(corpus_id)
        twice = incoming.groupBy("document_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise CorpusError(f"{twice[0]['document_id']} stands twice in one call")
        registry, old = self.registry(corpus_id), self.pages(corpus_id)
        planned = ingest.plan_ingest(registry, incoming).withColumns({"corpus_id": F.lit(corpus_id), "ingestion_date": F.current_timestamp(), "replaced_by": F.lit(None).cast("string")})
        planned = snapshot(planned)
        new = planned.where("outcome IN ('added', 'new_version')")
        if not new.isEmpty():
            if "extraction_error" not in pages.columns:
                pages = pages.withColumn("extraction_error", F.lit(None).cast("string"))
            own = pages.join(new.select("document_id", "document_version"), "document_id").select(
                F.lit(corpus_id).alias("corpus_id"), "document_id", "document_version", "page_number", "text", (F.trim(F.coalesce("text", F.lit(""))) == "").alias("is_empty"), "page_label", "extraction_error"
            )
            sinks.publish({"registry": ingest.apply_ingest(registry, planned), "pages": old.unionByName(own)}, f"{self.root}/{corpus_id}/documents")
            self._set(corpus, "uploaded")
        return planned.select("document_id", "document_version", "outcome", "error")

    def add_document(self, corpus_id: str, document: dict, pages: list[tuple[str, str | None]]) -> dict:
        """One document (document_id, source_type, title, source_url, source_date, file_sha256) with the (text, label) of its pages; returns what became of it."""
        columns = "document_id string, source_type string, title string, source_url string, source_date date, file_sha256 string, error string"
        incoming = self.spark.createDataFrame([tuple(document.get(c.split()[0]) for c in columns.split(", "))], columns)
        rows = [(document["document_id"], n, text, label) for n, (text, label) in enumerate(pages, 1)]
        return self.add_documents(corpus_id, incoming, self.spark.createDataFrame(rows, "document_id string, page_number int, text string, page_label string")).first().asDict()

    def upload(self, corpus_id: str, files: list[tuple[str, bytes]], parser: PdfParser) -> list[dict]:
        """One request's files (name, content): checked, stored under their hash, parsed and added; a row for each says what became of it."""
        limits, folder = self.settings.uploads, f"{self.root}/{corpus_id}/{self.settings.paths.uploads}"
        self.get_corpus(corpus_id)
        rows = [(n, prose.sanitize_filename(name), len(content), hashlib.sha256(content).hexdigest()) for n, (name, content) in enumerate(files)]
        listed = self.spark.createDataFrame(rows, "place int, filename string, length long, file_sha256 string")
        registry = ingest.current_versions(self.registry(corpus_id))
        judged = [r.asDict() for r in accept_uploads(listed, registry, limits.max_bytes, limits.extensions).orderBy("place").collect()]
        for r in judged:
            if r["status"] == "accepted" and r["filename"].lower().endswith(".pdf") and (reason := inspect_pdf(files[r["place"]][1], limits.max_pages)):
                r |= {"status": "rejected", "reason": reason}
        held = self._stored(folder)
        judged = within_limits(judged, registry.count(), sum(held.values()), limits.max_documents, limits.max_total)
        taken = {r["file_sha256"]: r for r in judged if r["status"] == "accepted"}
        for digest, r in taken.items():
            sinks.store_upload(self.spark, folder, files[r["place"]][1], re.sub(r".*(\.[^.]+)$", r"\1", r["filename"]).lower())
        if taken:
            found = scan_files(self.spark, folder, "[0-9a-f]*").where(F.col("file_sha256").isin(list(taken)))
            names = self.spark.createDataFrame([(d, r["filename"]) for d, r in taken.items()], "file_sha256 string, title string")
            outcomes = {r["document_id"]: r for r in self._add_parsed(corpus_id, scan_pages(found, parser).join(F.broadcast(names), "file_sha256"), "user_document").collect()}
            log.info("corpus %s: %s uploads, %s outcomes", corpus_id, len(taken), len(outcomes))
        return [{k: r[k] for k in ("filename", "file_sha256", "status", "reason")} for r in judged]

    def _stored(self, folder: str) -> dict[str, int]:
        fs, p, _ = sinks._fs(self.spark, folder)
        return {x.getPath().getName(): x.getLen() for x in fs.listStatus(p)} if fs.exists(p) else {}

    def add_directory(self, corpus_id: str, path: str, parser: PdfParser, source_type: str = "user_document", glob: str = "*.pdf") -> DataFrame:
        pages = scan_pages(scan_files(self.spark, path, glob), parser)
        return self._add_parsed(corpus_id, pages.withColumn("title", F.regexp_extract("path", r"([^/]*)$", 1)), source_type)

    def _add_parsed(self, corpus_id: str, pages: DataFrame, source_type: str) -> DataFrame:
        """Parsed pages with their file's ``title``; a file is a document, and one without a readable page has failed."""
        named = pages.withColumn("source_url", F.concat(F.lit("upload://"), F.col("file_sha256")))
        named = snapshot(named.withColumn("document_id", ingest.document_id(F.lit(corpus_id), F.lit(source_type), F.concat(F.lit("upload://"), F.col("title")))))
        failed = F.when(F.count_if(F.col("extraction_error").isNull()) == 0, F.max("extraction_error"))
        incoming = named.groupBy("document_id").agg(F.first("title").alias("title"), F.first("source_url").alias("source_url"), F.first("file_sha256").alias("file_sha256"), failed.alias("error"))
        incoming = incoming.withColumns({"source_type": F.lit(source_type), "source_date": F.lit(None).cast("date")})
        return self.add_documents(corpus_id, incoming, named.where("page_number IS NOT NULL").select("document_id", "page_number", "text", "page_label", "extraction_error"))

    def build_corpus(self, corpus_id: str) -> Corpus:
        """Chunk and index; a failure leaves the former index and says why."""
        corpus = self.get_corpus(corpus_id)
        if corpus.status == "processing":
            raise CorpusBusyError(corpus_id)
        self._set(corpus, "processing")
        try:
            registry, pages = self.registry(corpus_id), self.pages(corpus_id)
            if registry.isEmpty():
                raise chunking.ChunkingError("the corpus has no documents")
            if not chunking.missing_documents(registry, pages).isEmpty():
                raise chunking.ChunkingError("a registered document has no pages")
            if not (broken := ingest.page_problems(pages, registry.where("replaced_by IS NULL").join(pages.groupBy(*ingest.KEY).agg(F.max("page_number").alias("page_count")), ingest.KEY))).isEmpty():
                raise chunking.ChunkingError(f"{broken.first()['document_id']}: {broken.first()['problem']}")
            root = f"{self.root}/{corpus_id}/{self.settings.paths.indexes}"
            chunks = snapshot(chunking.with_rows(chunking.chunk_documents(pages, registry, self.settings.chunking)), "chunks")
            if chunks.isEmpty():
                raise chunking.ChunkingError("the documents have no text")
            if not (broken := chunking.invalid_chunks(chunks)).isEmpty():
                raise chunking.ChunkingError(f"{broken.first()['chunk_id']}: {broken.first()['problem']}")
            if not ingest.foreign_rows(chunks, corpus_id).isEmpty():
                raise CorpusError("chunks of another corpus")
            report = {"chunks": chunks.count(), "vectors_used_again": 0}
            vectors = None
            if self.embedder:
                cached = self._cached_vectors(root)
                report["vectors_used_again"] = chunks.join(cached, "chunk_id", "left_semi").count()
                vectors = dense.embed_missing(chunks, cached, self.embedder).join(chunks.select("chunk_id", "row"), "chunk_id").select("row", "embedding")
                vectors = snapshot(vectors, "vectors")  # a model's work is done once
                vectors = dense_blocks.blocked(vectors, dense_blocks.fit_centroids(vectors, min(MAX_CENTROIDS, int(report["chunks"] ** 0.5) + 1)))
            documents = sinks.read_pointer(self.spark, f"{self.root}/{corpus_id}/documents")["version"]
            # chunks and index appear together: after a failed build both are the former ones
            with bm25_blocks.built(chunks) as (postings, stats):
                sinks.save_indexes(chunks, postings, stats, vectors, root, chunking.index_fingerprint(chunks), self.embedder.name if self.embedder else None, {"documents": documents})
            corpus.report = report
            self._set(corpus, "ready")
        except Exception as e:
            self._set(corpus, "failed", str(e).splitlines()[0][:300])
            raise
        return corpus

    def _cached_vectors(self, root: str) -> DataFrame:
        """Vectors of the former index by chunk, if the same model made them."""
        try:
            index = sinks.load_indexes(self.spark, root, model=self.embedder.name)
        except (sinks.IndexNotFoundError, sinks.InconsistentIndexError):
            return self.spark.createDataFrame([], "chunk_id string, embedding array<float>, model string")
        return dense_blocks.unpacked(index["vectors"]).join(index["chunks"].select("row", "chunk_id"), "row").select("chunk_id", "embedding", F.lit(self.embedder.name).alias("model"))

    def build_later(self, corpus_id: str) -> Future:
        """A build in the background, one after another."""
        self.get_corpus(corpus_id)
        self._worker = self._worker or ThreadPoolExecutor(1, "build")
        self._builds[corpus_id] = self._worker.submit(self.build_corpus, corpus_id)
        return self._builds[corpus_id]

    def wait(self, corpus_id: str, timeout: float | None = None) -> Corpus:
        """The corpus after its build, which may have failed."""
        if corpus_id in self._builds:
            self._builds[corpus_id].exception(timeout)
        return self.get_corpus(corpus_id)

    def shutdown(self) -> None:
        """No further builds; the one that runs ends first."""
        if self._worker:
            self._worker.shutdown(wait=True, cancel_futures=True)
            self._worker = None

    def load(self, corpus_id: str, model: str | None = None) -> dict[str, DataFrame]:
        """The tables of a corpus's index; one that was built from other documents than the corpus has now is refused."""
        documents = sinks.read_pointer(self.spark, f"{self.root}/{corpus_id}/documents")["version"]
        return sinks.load_indexes(self.spark, f"{self.root}/{corpus_id}/{self.settings.paths.indexes}", model=model, documents=documents)

    def check_order(self, corpus_id: str) -> None:
        """Refuse an index whose chunks are not in the order that it was built over."""
        root = f"{self.root}/{corpus_id}/{self.settings.paths.indexes}"
        sinks.load_indexes(self.spark, root, fingerprint=chunking.index_fingerprint(self.load(corpus_id)["chunks"]))

    def counts(self, corpus_id: str) -> DataFrame:
        return ingest.corpus_counts(self.registry(corpus_id), self.load(corpus_id)["chunks"])

    # questions

    def retrieve(self, corpus_id: str, queries: DataFrame, mode: str = "hybrid", pool: int | None = None) -> DataFrame:
        """Ranked rows of many questions (query_id, query) with the scores of each method."""
        s = self.settings.retrieval
        top = pool or s.top_n
        if mode not in ("bm25", "dense", "hybrid") or top < 1:
            raise QueryError(f"{mode}, {top}")
        if self.get_corpus(corpus_id).status != "ready":
            raise CorpusNotReadyError(corpus_id)
        if not queries.where(F.trim(F.coalesce("query", F.lit(""))) == "").isEmpty():
            raise QueryError("a question is empty")
        if mode != "bm25" and self.embedder is None:
            raise QueryError("there is no embedder")
        index = self.load(corpus_id, self.embedder.name if mode != "bm25" else None)
        none = F.lit(None)
        if mode != "dense":
            words = bm25_blocks.search(index["postings"], index["stats"], bm25.query_terms(queries), pool or s.top_bm25, s.k1, s.b)
        if mode != "bm25":
            embedded = dense.embed_queries(queries, self.embedder, self.settings.embedding.query_instruction)
            near = dense_blocks.search(index["vectors"], embedded, pool or s.top_dense, self.embedder.dim)
        if mode == "bm25":
            hits = words.withColumns({"bm25_rank": F.col("rank"), "bm25_score": F.col("score"), "dense_rank": none.cast("int"), "dense_score": none.cast("double")})
        elif mode == "dense":
            hits = near.withColumns({"dense_rank": F.col("rank"), "dense_score": F.col("score"), "bm25_rank": none.cast("int"), "bm25_score": none.cast("double")})
        else:
            hits = fusion.hybrid(words, near, top, s.rrf_k, (s.bm25_weight, s.dense_weight))
        return hits.where(F.col("rank") <= top).select("query_id", "row", "rank", "score", "bm25_rank", "bm25_score", "dense_rank", "dense_score")

    def query_many(self, corpus_id: str, queries: DataFrame, mode: str = "hybrid", top_k: int | None = None, generator=None, library: DataFrame | None = None) -> DataFrame:
        """Answers of many questions through one plan."""
        limits = replace(self.settings.evidence, top_k=top_k) if top_k else self.settings.evidence
        if not 1 <= limits.top_k <= 20:
            raise QueryError("top_k must be from 1 to 20")
        registry = self.registry(corpus_id)
        chunks = self.load(corpus_id)["chunks"]
        titles = registry.where("source_type = 'judgment' AND replaced_by IS NULL").select("document_id", "title")
        if library is not None:  # uploads that are known cases are named by their cases' titles, and no longer unknown
            known = snapshot(understanding.identified_titles(chunks, library), "identified")
            titles = titles.unionByName(known)
            library = library.join(known.select("title"), "title", "left_anti")
        # both are read many times by what follows
        analysis = snapshot(understanding.analyze(queries, titles, library), "analysis")
        searched = analysis.select("query_id", F.coalesce("search_query", "query").alias("query"))
        hits = self.retrieve(corpus_id, searched, mode, self.settings.candidate_pool)
        found = snapshot(fusion.materialize_hits(hits, chunks.select("row", "chunk_id")).drop("row"), "hits")
        evidence = snapshot(selection.select_evidence(analysis, found, chunks, registry, limits), "evidence")
        questions = answers.questions_with_evidence(analysis, evidence, selection.notices(analysis, chunks), selection.assess_confidence(analysis, evidence, limits))
        quotes = self.settings.quotes
        if generator is None:  # quotations, which the grounding check covers
            return answers.answer_all(questions, lambda q, items: answers.extractive_answer(q, items, quotes), quotes.show_author)
        return answers.answer_all(questions, generator, quotes.show_author, self.settings.validation, self.embedder)

    def llm_generator(self, client: generation.LLMClient) -> generation.LLMAnswers:
        """A generator for ``query_many`` as the settings say."""
        s = self.settings.llm
        return generation.LLMAnswers(client, self.settings.generation, s.model, s.retries, {"temperature": s.temperature, "max_output_tokens": s.max_output_tokens, "timeout_seconds": s.timeout_seconds})

    @staticmethod
    def describe(answer: dict) -> str:
        """One line about an answer."""
        checks = Counter(json.loads(x)["status"] for x in answer["claim_checks"])
        said = f", claims checked: {', '.join(f'{checks[k]} {k}' for k in ('supported', 'contradicted', 'insufficient') if checks[k])}" if checks else ""
        return f"{answer['query_type']} | {answer['status']} | {len(answer['claims'])} statement(s), {len(answer['citations'])} citation(s) | {answer['generator']}{said}"

    def describe_hits(self, corpus_id: str, hits: DataFrame) -> DataFrame:
        """``hits`` with ``line``: where each is from (case, article, heading, part, title or id), its author and its pages."""
        titles = ingest.latest_versions(self.registry(corpus_id)).select("document_id", "title")
        columns = ["row", "document_id", "case_name", "article_number", "article_title", "heading", "part", "opinion_author", "page_start", "page_end"]
        chunks = self.load(corpus_id)["chunks"].select(*columns).join(titles, "document_id", "left").select("row", chunking.hit_line().alias("line"))
        return hits.join(chunks, "row", "left")

    def query(self, corpus_id: str, question: str, **settings) -> dict:
        rows = self.query_many(corpus_id, self.spark.createDataFrame([("q", question)], "query_id string, query string"), **settings).collect()
        return rows[0].asDict(True)

    def evaluate(self, corpus_id: str, questions: DataFrame, modes: tuple[str, ...] = ("bm25", "dense", "hybrid"), ks: tuple[int, ...] = (1, 5, 10), scorer=None) -> DataFrame:
        """hit@k and MRR of each mode over evaluation questions (id, kind, question, relevant_documents, relevant_articles); with a pair scorer also of each mode reranked."""
        own = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"), "kind", "relevant_documents", "relevant_articles")
        chunks = self.load(corpus_id)["chunks"].select("row", "document_id", "source_type", "article_number", "text")
        relevant = evaluation.is_relevant(*map(F.col, ("kind", "relevant_documents", "relevant_articles", "document_id", "source_type", "article_number")))
        parts = []
        for mode in modes:
            pool = self.settings.reranking.candidates if scorer else None
            found = snapshot(self.retrieve(corpus_id, own.select("query_id", "query"), mode, pool).select("query_id", "row", "rank"), "found")
            lists = {mode: found}
            if scorer:
                pairs = fusion.materialize_hits(found, chunks.select("row", "text")).join(own.select("query_id", "query"), "query_id")
                lists[f"{mode}+{scorer.name}"] = fusion.rank_scores(dense.rerank(pairs, scorer)).select("query_id", "row", "rank")
            for name, hits in lists.items():
                judged = fusion.materialize_hits(hits, chunks.drop("text")).join(own, "query_id").select("query_id", "rank", relevant.alias("relevant"))
                parts.append(evaluation.summary(evaluation.first_relevant(own.select("query_id", "kind"), judged), ks).withColumn("mode", F.lit(name)))
        return reduce(DataFrame.unionByName, parts)

    def evaluate_answers(self, corpus_id: str, questions: DataFrame, **settings) -> DataFrame:
        """Shares of answerable questions answered and of the others refused, with the exceptions."""
        asked = questions.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
        made = self.query_many(corpus_id, asked, **settings).select("query_id", "status")
        return evaluation.answer_rates(made.join(questions.select(F.col("id").alias("query_id"), "kind"), "query_id"))
