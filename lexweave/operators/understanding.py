"""Question analysis for any number of questions at once.

Cases are recognised by name tokens that occur in exactly one title: an aggregate over titles, then an equi-join with
the questions' words.  Words that match nothing meet the tokens with which they share a form with one letter
left out, and are compared for one typo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import fixed
from lexweave.functions import text as X
from lexweave.operators.tables import snapshot



def _none() -> Column:
    return F.array().cast("array<string>")


def title_tokens(titles: DataFrame) -> DataFrame:
    """document_id and each usable token of its title."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)))
    own = titles.select("document_id", F.explode(words).alias("token"))
    return own.where((F.length("token") >= 4) & ~F.col("token").isin(fixed.GENERIC_NAME_TOKENS))


def distinctive_tokens(titles: DataFrame) -> DataFrame:
    """Tokens that name one document only."""
    return title_tokens(titles).groupBy("token").agg(F.count_distinct("document_id").alias("_n"), F.min("document_id").alias("document_id")).where("_n = 1").drop("_n")


def _deletions(word: Column) -> Column:
    """The word, and each form of it without one letter, the first always kept."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.when(i == 1, word).otherwise(F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def match_cases(queries: DataFrame, titles: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """query_id, document_id, word, token, and whether the word had to be corrected; ``names``: the titles' ``distinctive_tokens``."""
    # a table of its own: three joins read it
    names = snapshot(distinctive_tokens(titles), "names") if names is None else names
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    exact = words.join(names, F.col("word") == F.col("token")).select("query_id", "document_id", "word", "token", F.lit(False).alias("corrected"))
    open_ = words.where(F.length("word") >= 6).join(names.select("token"), F.col("word") == F.col("token"), "left_anti")
    # words at one edit, or with two neighbours swapped, share a form with at most one letter left out behind the first
    spelt = names.where(F.length("token") >= 6).select("document_id", "token", F.explode(_deletions(F.col("token"))).alias("_form"))
    asked = open_.select("query_id", "word", F.explode(_deletions(F.col("word"))).alias("_form"))
    near = asked.join(spelt, "_form").where(X.is_one_typo(F.col("word"), F.col("token")))
    first = near.groupBy("query_id", "document_id", "word").agg(F.min("token").alias("token"))
    return exact.unionByName(first.select("query_id", "document_id", "word", "token", F.lit(True).alias("corrected")))


def _matched(queries: DataFrame, titles: DataFrame, prefix: str) -> DataFrame:
    names = snapshot(distinctive_tokens(titles), "names")
    found = snapshot(match_cases(queries, titles, names), "named-cases")
    named = found.join(titles.select("document_id", "title"), "document_id")
    # of several documents that a misspelt word could name, the last one's token is the reading
    fixes = found.where("corrected").groupBy("query_id", "word").agg(F.max_by("token", "document_id").alias("token")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "token")))).alias(f"{prefix}_corrections"))
    ids = named.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("document_id", "title"))), lambda x: x["document_id"]).alias(f"{prefix}_ids"), F.transform(F.array_sort(F.collect_set(F.struct("document_id", "title"))), lambda x: x["title"]).alias(f"{prefix}_titles"))
    terms = found.select("query_id", "document_id").distinct().join(names, "document_id").groupBy("query_id").agg(F.array_sort(F.collect_set("token")).alias(f"{prefix}_terms"))
    return ids.join(fixes, "query_id", "left").join(terms, "query_id", "left")


def analyze(queries: DataFrame, titles: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """One row for each question: type, articles, cases, corrections, search query, content terms, signals.

    ``titles`` (document_id, title) are the corpus's judgments, ``reference`` known judgments outside of it.
    """
    no_map = F.create_map().cast("map<string,string>")
    own = queries.select("query_id", "query").join(_matched(queries, titles, "case"), "query_id", "left")
    if reference is not None:
        own = own.join(_matched(queries, reference, "other"), "query_id", "left")
    else:
        own = own.withColumns({"other_ids": _none(), "other_titles": _none(), "other_terms": _none(), "other_corrections": no_map})
    for c in ("case_ids", "case_titles", "case_terms", "other_titles"):
        own = own.withColumn(c, F.coalesce(c, _none()))
    own = own.withColumn("article_refs", X.article_refs(F.col("query"))).withColumn("articles", X.articles_of(F.col("article_refs")))
    named = F.size("case_ids") > 0
    unknown = F.when(named, _none()).otherwise(F.col("other_titles"))
    form = F.col("query").rlike(f"(?U){fixed.CASE_FORM}")
    cue = F.regexp_extract("query", f"(?i)({fixed.INTERPRETATION})", 1)
    own = own.withColumns({"unknown_case_titles": unknown, "_form": form, "_cue": cue})
    cases, others = F.coalesce("case_corrections", no_map), F.coalesce("other_corrections", no_map)
    merged = F.map_concat(F.map_filter(cases, lambda k, v: ~F.map_contains_key(others, k)), others)
    own = own.withColumn("corrections", F.when(named, cases).otherwise(merged))
    is_case = named | F.col("_form") | (F.size("unknown_case_titles") > 0)
    kind = F.when(is_case, "case").when(F.col("_cue") != "", "interpretation").when(F.size("articles") > 0, "provision").otherwise("general")
    own = own.withColumn("query_type", kind).withColumn("names_unknown_case", (F.col("_form") & ~named) | (F.size("unknown_case_titles") > 0))

    pairs = F.array_sort(F.map_entries("corrections"))
    names = F.flatten(F.transform(F.when(named, F.col("case_titles")).otherwise(F.col("unknown_case_titles")), X.tokens))
    ignored = F.when(F.col("_form") & ~named & (F.size("unknown_case_titles") == 0), _none()).otherwise(F.concat(names, X.string_array(["v", "vs", "versus"]), F.map_keys("corrections")))
    content = F.array_except(F.array_distinct(X.tokens(F.col("query"))), F.concat(X.string_array(fixed.QUERY_STOPWORDS), ignored))
    corrected = F.aggregate(pairs, F.col("query"), lambda q, p: F.regexp_replace(q, F.concat(F.lit(r"(?i)\b"), p["key"], F.lit(r"\b")), p["value"]))

    def said(column):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))

    why = (
        F.when(named, F.concat(F.lit("names case(s) "), said("case_titles")))
        .when(F.size("unknown_case_titles") > 0, F.concat(F.lit("names case(s) not in this corpus "), said("unknown_case_titles")))
        .when(F.col("_form"), F.lit("has 'X v. Y' case form"))
        .when(F.col("_cue") != "", F.concat(F.lit("interpretation cue '"), F.col("_cue"), F.lit("'")))
        .when(F.size("articles") > 0, F.concat(F.lit("cites Article(s) "), said("articles"), F.lit(" without interpretation cues")))
        .otherwise(F.lit("no article, case or interpretation cue"))
    )
    cites = F.when((F.size("articles") > 0) & (F.col("query_type") != "provision"), F.concat(F.lit("cites Article(s) "), said("articles")))
    spelling = F.when(F.size(pairs) > 0, F.concat(F.lit("spelling: "), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("'"), p["key"], F.lit("' read as '"), p["value"], F.lit("'"))), ", ")))
    return own.select(
        "query_id", "query", "query_type", "articles", "article_refs", F.col("case_ids").alias("case_document_ids"), "case_titles", "names_unknown_case", "unknown_case_titles",
        "corrections", F.when(F.size(pairs) > 0, corrected).alias("search_query"), "case_terms", content.alias("content_terms"), F.array_compact(F.array(why, cites, spelling)).alias("signals"),
    )


def known_cases(documents: DataFrame, library: DataFrame) -> DataFrame:
    """Library cases whose distinctive tokens all stand in an uploaded document's opening words.

    ``documents``: document_id, opening.  A case meets a document through one of its tokens, not through a cross join.
    """
    names = distinctive_tokens(library).withColumnRenamed("document_id", "case_id")
    needed = names.groupBy("case_id").agg(F.count("*").alias("_need"))
    words = documents.select("document_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("opening"), F.lit("[a-z]+"), F.lit(0)))).alias("token"))
    met = words.join(names, "token").groupBy("document_id", "case_id").agg(F.count("*").alias("_met"))
    return met.join(needed, "case_id").where("_met = _need").select("document_id", "case_id")


def opening_texts(chunks: DataFrame, chars: int = 1000) -> DataFrame:
    """document_id and the opening of its first chunk."""
    return chunks.groupBy("document_id").agg(F.substring(F.min_by("text", "chunk_index"), 1, chars).alias("opening"))


def identified_titles(chunks: DataFrame, library: DataFrame) -> DataFrame:
    """document_id and title of uploaded documents that are known cases; of several the one of the smallest id."""
    uploads = opening_texts(chunks.where("source_type = 'user_document'"))
    found = known_cases(uploads, library).groupBy("document_id").agg(F.min("case_id").alias("case_id"))
    return found.join(library.select(F.col("document_id").alias("case_id"), "title"), "case_id").select("document_id", "title")
