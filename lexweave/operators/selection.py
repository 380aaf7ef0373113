"""Evidence selection and the confidence gate, as joins, flags and windows.

Boosts, groups and caps do not depend on each other, so the greedy choice equals three row numbers: constitutional
rows among themselves, rows of a document among themselves, then the first of what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as X


@dataclass(frozen=True)
class EvidenceLimits:
    top_k: int = 6
    max_constitutional: int = 2
    max_per_document: int = 2
    provision_boost: float = 1.0
    case_boost: float = 1.0
    mention_boost: float = 0.01
    min_term_coverage: float = 0.6
    min_dense_score: float | None = None


def role(source_type: Column) -> Column:
    return F.when(source_type == "constitutional_text", "constitutional_text").when(source_type == "judgment", "judicial").when(source_type == "user_document", "user_document").otherwise("other")


def is_headnote(division: Column, heading: Column) -> Column:
    return (division == "front_matter") & (F.upper(F.trim(F.coalesce(heading, F.lit("")))) == "HELD")


def provision_lookup(analysis: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the cited articles' own text."""
    cited = analysis.select("query_id", F.explode("articles").alias("article_number"))
    return chunks.where("source_type = 'constitutional_text'").join(cited, "article_number").select("query_id", "chunk_id").distinct()


def case_lookup(analysis: DataFrame, chunks: DataFrame) -> DataFrame:
    """Two headnote chunks of each named case, else its first chunk."""
    named = analysis.select("query_id", F.explode("case_document_ids").alias("document_id"))
    own = chunks.join(named, "document_id").withColumn("_head", is_headnote(F.col("division"), F.col("heading")))
    of = Window.partitionBy("query_id", "document_id")
    placed = own.withColumns({"_any": F.max("_head").over(of), "_n": F.row_number().over(of.orderBy(F.col("_head").desc(), "row"))})
    return placed.where(F.when(F.coalesce("_any", F.lit(False)), F.col("_head") & (F.col("_n") <= 2)).otherwise(F.col("_n") == 1)).select("query_id", "chunk_id").distinct()


def candidate_pool(analysis: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks, and looked-up ones that retrieval missed, with their origin and all chunk columns."""
    keys = ["query_id", "chunk_id"]
    found = hits.select(*keys, "rank", "score", "bm25_rank", "bm25_score", "dense_rank", "dense_score")
    summary = case_lookup(analysis, chunks)
    first = provision_lookup(analysis, chunks).withColumn("_o", F.lit(1)).unionByName(summary.withColumn("_o", F.lit(2))).groupBy(*keys).agg(F.min("_o").alias("_o"))
    both = found.join(first, keys, "full").join(summary.withColumn("is_case_summary", F.lit(True)), keys, "left")
    origin = F.when(F.col("rank").isNotNull(), "retrieval").when(F.col("_o") == 1, "provision_lookup").otherwise("case_lookup")
    return both.withColumns({"origin": origin, "is_case_summary": F.coalesce("is_case_summary", F.lit(False))}).drop("_o").join(chunks, "chunk_id")


def score_pool(analysis: DataFrame, pool: DataFrame, limits: EvidenceLimits) -> DataFrame:
    """Boosts, final score, term coverage and presentation group of each candidate.  The source's kind enters no score but by what the question names."""
    own = pool.join(analysis.select("query_id", "query_type", "articles", "case_document_ids", "content_terms"), "query_id")
    provision = (F.col("source_type") == "constitutional_text") & F.coalesce(F.array_contains("articles", F.col("article_number")), F.lit(False))
    own = own.withColumns({"role": role(F.col("source_type")), "is_provision": provision, "is_named_case": F.array_contains("case_document_ids", F.col("document_id"))})
    mentioned = F.filter("articles", lambda a: X.mentions_article(F.col("text"), a))
    own = own.withColumn("mentioned", F.when(F.col("is_provision"), F.array().cast("array<string>")).otherwise(mentioned))
    boosts = [("provision_match", F.col("is_provision"), limits.provision_boost), ("case_match", F.col("is_named_case"), limits.case_boost), ("article_mention", (F.size("mentioned") > 0) & (F.col("role") == "judicial"), limits.mention_boost)]
    entries = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("key"), F.lit(b).alias("value"))) for n, c, b in boosts]))
    own = own.withColumn("boosts", F.map_from_entries(entries))
    final = F.coalesce("score", F.lit(0.0)) + F.aggregate(F.map_values("boosts"), F.lit(0.0), lambda s, x: s + x)
    covered = X.coverage(F.col("content_terms"), F.col("text"), F.when(F.col("is_provision"), F.col("articles")).otherwise(F.array().cast("array<string>")))
    group = (
        F.when(F.col("query_type") == "provision", F.when(F.col("is_provision"), 0).when(F.col("role") == "judicial", 1).otherwise(2))
        .when(F.col("query_type") == "interpretation", F.when(F.col("role") == "judicial", 0).when(F.col("is_provision"), 1).otherwise(2))
        .when(F.col("query_type") == "case", F.when(~F.col("is_named_case"), 2).when(F.col("is_case_summary") & (F.size("content_terms") == 0), 0).otherwise(1))
        .otherwise(0)
    )
    reasons = F.array_compact(F.array(
        F.concat(F.lit("origin: "), F.col("origin")), F.when(F.col("is_provision"), F.concat(F.lit("is Article "), F.col("article_number"))),
        F.when(F.col("is_named_case"), F.lit("belongs to the named case")),
        F.when((F.size("mentioned") > 0) & (F.col("role") == "judicial"), F.concat(F.lit("mentions Article "), F.array_join("mentioned", ", "))),
    ))
    return own.withColumns({"final_score": final, "term_coverage": covered, "presentation_group": group, "reasons": reasons})


def choose(scored: DataFrame, limits: EvidenceLimits) -> DataFrame:
    """The evidence of each question in order, with its numbers E1, E2, ..."""
    order = [F.col("presentation_group"), F.round("final_score", 9).desc(), F.col("rank").asc_nulls_last(), F.col("row")]
    query = Window.partitionBy("query_id")
    constitutional = F.col("role") == "constitutional_text"
    placed = scored.withColumns({
        "_c": F.row_number().over(Window.partitionBy("query_id", constitutional).orderBy(*order)),
        "_d": F.row_number().over(Window.partitionBy("query_id", constitutional, "document_id").orderBy(*order)),
        "_p": F.row_number().over(Window.partitionBy("query_id", "is_provision").orderBy(*order)),
        "_any": F.max("is_provision").over(query),
    })
    allowed = F.when(constitutional, F.col("_c") <= limits.max_constitutional).otherwise(F.col("is_named_case") | (F.col("_d") <= limits.max_per_document))
    reserve = (F.col("query_type") == "interpretation") & F.col("_any") & F.lit(limits.max_constitutional > 0)
    ranked = placed.withColumns({"_ok": allowed, "_reserve": reserve.cast("int")}).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_ok").orderBy(*order)))
    chosen = F.col("_ok") & (F.col("_r") <= F.lit(limits.top_k) - F.col("_reserve"))
    flagged = ranked.withColumn("_in", chosen).withColumn("_has", F.max(F.col("_in") & F.col("is_provision")).over(query))
    extra = (F.col("_reserve") == 1) & ~F.col("_has") & F.col("is_provision") & (F.col("_p") == 1)
    kept = flagged.where(F.col("_in") | extra).withColumn("evidence_rank", F.row_number().over(query.orderBy((~F.col("_in")).cast("int"), *order)))
    return kept.withColumn("evidence_id", F.concat(F.lit("E"), F.col("evidence_rank"))).drop("_c", "_d", "_p", "_any", "_ok", "_reserve", "_r", "_in", "_has")


def with_titles(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """Document title and date from the registry; else the case's name, else the id."""
    own = registry.select("document_id", "document_version", F.col("title").alias("_title"), "source_date")
    return evidence.join(own, ["document_id", "document_version"], "left").withColumn("document_title", F.coalesce("_title", "case_name", "document_id")).drop("_title")


def notices(analysis: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a reader must know: missing articles, spelling, unknown cases."""
    held = chunks.where("source_type = 'constitutional_text' AND article_number IS NOT NULL").select(F.col("article_number").alias("article")).distinct()
    cited = analysis.select("query_id", F.posexplode("articles").alias("_i", "article")).join(held, "article", "left_anti")
    missing = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "article"))), lambda x: F.concat(F.lit("No constitutional text for Article "), x["article"], F.lit(" was found in the corpus."))).alias("_missing"))
    pairs = F.array_sort(F.map_entries("corrections"))
    spelling = F.when(F.size(pairs) > 0, F.concat(F.lit("Spelling: "), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("searched for '"), p["value"], F.lit("' instead of '"), p["key"], F.lit("'"))), ", "), F.lit(".")))
    unknown = F.when(F.size("unknown_case_titles") > 0, F.concat(F.array_join("unknown_case_titles", "; "), F.lit(" is not in this corpus. Passages below that mention it are not that judgment; select a corpus that contains it."))).when(F.col("names_unknown_case"), F.lit("The case named in the question is not in the corpus."))
    return analysis.join(missing, "query_id", "left").select("query_id", F.concat(F.coalesce("_missing", F.array().cast("array<string>")), F.array_compact(F.array(spelling, unknown))).alias("notices"))


def assess_confidence(analysis: DataFrame, evidence: DataFrame, limits: EvidenceLimits) -> DataFrame:
    """Why the evidence does not suffice; an empty list means that it does."""
    seen = evidence.groupBy("query_id").agg(F.count("*").alias("_n"), F.max("is_named_case").alias("_case"), F.max("term_coverage").alias("_best"), F.max("dense_score").alias("_dense"))
    own = analysis.join(seen, "query_id", "left")
    some = F.coalesce("_n", F.lit(0)) > 0
    percent = lambda x: F.concat(F.format_string("%.0f", x * 100), F.lit("%"))
    problems = [
        F.when(~some, F.lit("No evidence was retrieved for this question.")),
        F.when(F.col("names_unknown_case"), F.lit("The case named in the question is not in the corpus.")),
        F.when((F.col("query_type") == "case") & (F.size("case_document_ids") > 0) & ~F.coalesce("_case", F.lit(False)), F.lit("No passage from the named judgment was retrieved.")),
        F.when(some & (F.size("content_terms") > 0) & (F.col("_best") < limits.min_term_coverage), F.concat(F.lit("The best evidence contains only "), percent(F.col("_best")), F.lit(" of the question's key terms (threshold "), percent(F.lit(limits.min_term_coverage)), F.lit("): "), F.array_join("content_terms", ", "), F.lit("."))),
    ]
    if limits.min_dense_score is not None:
        low = F.col("_dense").isNull() | (F.col("_dense") < limits.min_dense_score)
        problems.append(F.when(low, F.concat(F.lit("Best dense similarity "), F.coalesce(F.col("_dense").cast("string"), F.lit("n/a")), F.lit(f" is below the threshold {limits.min_dense_score}."))))
    return own.select("query_id", F.array_compact(F.array(*problems)).alias("problems"))


def select_evidence(analysis: DataFrame, hits: DataFrame, chunks: DataFrame, registry: DataFrame, limits: EvidenceLimits | None = None) -> DataFrame:
    limits = limits or EvidenceLimits()
    return with_titles(choose(score_pool(analysis, candidate_pool(analysis, hits, chunks), limits), limits), registry)
