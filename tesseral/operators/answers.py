"""Retrieval in three stages, and answers from what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesseral.functions import columns as C
from tesseral.functions import questions as Q
from tesseral.operators import retrieval

STAGES = (100, 30, 10)  # candidates after the dense, the sparse and the last stage
ALPHA, BOOST = 0.65, 0.3


def shared_weight(query: Column, text: Column) -> Column:
    """A sparse score: the number of a query's distinct terms that a text has, over the root of both counts of terms."""
    q, t = F.array_distinct(retrieval.terms(query)), F.array_distinct(retrieval.terms(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.sqrt(F.size(q) * F.size(t))), F.lit(0.0))


def coverage_scorer(query: Column, text: Column) -> Column:
    """The deterministic stand-in for a cross-encoder: the share of a query's distinct normal tokens in the text."""
    return C.answer_coverage(query, text)


def three_stage(docs: DataFrame, queries: DataFrame, stages: tuple[int, int, int] = STAGES, alpha: float = ALPHA, keep: DataFrame | None = None, mode: str = "prefilter", boost: float = BOOST, scorer=coverage_scorer, sparse: bool = True, rerank: bool = True) -> DataFrame:
    """(query_id, doc_id, dense, hybrid, score, rank): dense search, mixed with a sparse score, then scored by `scorer`.

    docs: (doc_id, embedding, text); queries: (query_id, embedding, query).  keep: (doc_id) that meet the question's
    filters, used before the dense stage ("prefilter"; queries that find nothing in it search all), as a bonus after
    the sparse one ("boost"), or after the last ("postfilter", three times as many candidates first).  Null texts
    have sparse score 0; ties go to the lesser doc_id.  Only `stages[0]` candidates a query meet their texts.
    """
    wide, middle, last = stages
    base, q = docs.select("doc_id", "embedding"), queries.select("query_id", "embedding")
    if keep is not None and mode == "prefilter":
        found = retrieval.dense_top_k(base, q, wide, keep=keep)
        lost = q.join(found.select("query_id").distinct(), "query_id", "left_anti")
        found = found.unionByName(retrieval.dense_top_k(base, lost, wide))
    else:
        found = retrieval.dense_top_k(base, q, wide)
    c = found.select("query_id", "doc_id", F.col("score").alias("dense")).join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "query"), "query_id")
    if sparse:
        mixed = retrieval.hybrid(c.withColumnRenamed("dense", "score"), c.select("query_id", "doc_id", F.round(shared_weight(F.col("query"), F.col("text")), 6).alias("score")), alpha)
        c = c.join(mixed.withColumnRenamed("score", "hybrid"), ["query_id", "doc_id"])
    else:
        c = c.withColumn("hybrid", F.col("dense"))
    c = retrieval.top_k(c, "query_id", "doc_id", "hybrid", middle).drop("rank")
    if keep is not None and mode == "boost":
        c = c.join(keep.select("doc_id").distinct().withColumn("__f", F.lit(boost)), "doc_id", "left").withColumn("hybrid", F.round(F.col("hybrid") + F.coalesce("__f", F.lit(0.0)), 6)).drop("__f")
    c = c.withColumn("score", F.round(scorer(F.col("query"), F.col("text")), 6) if rerank else F.col("hybrid"))
    if keep is not None and mode == "postfilter":
        c = retrieval.top_k(c, "query_id", "doc_id", "score", last * 3).drop("rank").join(keep.select("doc_id").distinct(), "doc_id", "left_semi")
    return retrieval.top_k(c, "query_id", "doc_id", "score", last).select("query_id", "doc_id", "dense", "hybrid", "score", "rank")


def best_sentence(query: Column, context: Column) -> Column:
    """The deterministic stand-in for a generator: the context's sentence with most of the query's tokens, the first of equals."""
    parts = F.filter(F.split(context, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    scored = F.transform(parts, lambda s, i: F.struct(C.answer_coverage(query, s).alias("c"), (-i).alias("i"), s.alias("s")))
    return F.array_max(scored)["s"]


def answers(found: DataFrame, docs: DataFrame, queries: DataFrame, budget: int = 2000, generator=best_sentence) -> DataFrame:
    """(query_id, kind, prompt, answer, used): the context of what was found (query_id, doc_id, rank), its prompt and answer.

    A query that found nothing, or only null texts, has an empty context and a null answer.
    """
    packed = retrieval.pack_context(found.select("query_id", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id"), budget)
    both = queries.select("query_id", "query").join(packed, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nAnswer:"))
    return both.select("query_id", C.query_kind("query").alias("kind"), prompt.alias("prompt"), F.when(F.col("context") != "", generator(F.col("query"), F.col("context"))).alias("answer"), F.coalesce("used", F.lit(0)).cast("long").alias("used"))


def read_questions(queries: DataFrame) -> DataFrame:
    """(query_id, query, kind, entities, years, regions, year, quarter, region, parts) of questions (query_id, query)."""
    q = queries.select("query_id", C.clean_query("query").alias("query"))
    join = lambda x: F.array_join(x, "|")
    return q.select("query_id", "query", C.query_kind("query").alias("kind"), join(Q.entities("query")).alias("entities"), join(C.temporal_hints("query")).alias("periods"), join(C.spatial_hints("query")).alias("regions"), Q.suggested_year("query").alias("year"), Q.suggested_quarter("query").alias("quarter"), Q.suggested_region("query").alias("region"), F.size(Q.sub_questions("query")).cast("long").alias("parts"))
