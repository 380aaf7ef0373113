"""Retrieval quality: first relevant rank, hit@k, MRR, score separation, answer rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("case", "provision", "out_of_scope")


def question_problems(questions: DataFrame) -> DataFrame:
    """Rows that are no valid questions, with the reason."""
    twice = questions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    reason = (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin(*KINDS), F.lit("unknown kind"))
        .when((F.col("kind") == "case") & (F.coalesce(F.size("relevant_documents"), F.lit(0)) <= 0), F.lit("no relevant documents"))
        .when((F.col("kind") == "provision") & (F.coalesce(F.size("relevant_articles"), F.lit(0)) <= 0), F.lit("no relevant articles"))
    )
    return questions.select("id", reason.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def is_relevant(kind: Column, documents: Column, articles: Column, document_id: Column, source_type: Column, article: Column) -> Column:
    own = F.when(kind == "case", F.array_contains(documents, document_id)).when(kind == "provision", (source_type == "constitutional_text") & F.array_contains(articles, article))
    return F.coalesce(own, F.lit(False))


def first_relevant(questions: DataFrame, judged: DataFrame) -> DataFrame:
    """The best relevant rank of each question (null: none); ``judged`` has query_id, rank, relevant."""
    best = judged.where("relevant").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return questions.join(best, "query_id", "left")


def _rates(ks: tuple[int, ...]) -> list[Column]:
    hits = [F.bround(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 3).alias(f"hit_at_{k}") for k in ks]
    top = max(ks)
    return [F.count("*").alias("n"), *hits, F.bround(F.avg(F.when(F.col("first_rank") <= top, 1.0 / F.col("first_rank")).otherwise(0.0)), 3).alias(f"mrr_at_{top}")]


def summary(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """hit@k and MRR for each kind and for all that can be answered; a question without a relevant hit counts as 0."""
    answerable = ranks.where("kind <> 'out_of_scope'")
    grouped = answerable.withColumn("group", F.explode(F.array(F.lit("all"), "kind")))
    return grouped.groupBy("group").agg(*_rates(ks))


def score_separation(top_scores: DataFrame) -> DataFrame:
    """Best scores of answerable and out-of-scope questions, and the share of the latter under the lowest of the former."""
    answerable = F.col("kind") != "out_of_scope"
    floor = top_scores.agg(F.min(F.when(answerable, F.col("score"))).alias("_floor"))
    both = top_scores.crossJoin(F.broadcast(floor))  # one row
    return both.agg(
        F.bround(F.min(F.when(answerable, F.col("score"))), 3).alias("answerable_min"), F.bround(F.avg(F.when(answerable, F.col("score"))), 3).alias("answerable_mean"), F.bround(F.max(F.when(answerable, F.col("score"))), 3).alias("answerable_max"),
        F.bround(F.min(F.when(~answerable, F.col("score"))), 3).alias("out_of_scope_min"), F.bround(F.avg(F.when(~answerable, F.col("score"))), 3).alias("out_of_scope_mean"), F.bround(F.max(F.when(~answerable, F.col("score"))), 3).alias("out_of_scope_max"),
        F.bround(F.avg(F.when(~answerable, (F.col("score") < F.col("_floor")).cast("double"))), 3).alias("separated_share"),
    )


def answer_rates(answers: DataFrame) -> DataFrame:
    """Shares of answerable questions answered and of others refused, with the exceptions."""
    answered, answerable = F.col("status").isin("answered", "partial"), F.col("kind") != "out_of_scope"
    return answers.agg(
        F.bround(F.avg(F.when(answerable, answered.cast("double"))), 3).alias("answered_share"),
        F.bround(F.avg(F.when(~answerable, (~answered).cast("double"))), 3).alias("refused_share"),
        F.array_sort(F.collect_list(F.when(answerable & ~answered, F.col("query_id")))).alias("not_answered"),
        F.array_sort(F.collect_list(F.when(~answerable & answered, F.col("query_id")))).alias("not_refused"),
    )
