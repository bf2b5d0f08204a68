"""Queries of three-stage retrieval, questions, stories, batches and targets over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesseral.functions import questions as Q
from tesseral.operators import answers, discovery, filters, metrics, retrieval, stories
from tesseral.plans.core_queries import _bm25_all, _vector_queries, _vectors, dense_top, mentions, nearby_places
from tesseral.sources.tables import table


def _texts(s, d):
    """(doc_id, embedding, label, text, title): vectors with the documents of their ids."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label").dropDuplicates(["doc_id"])
    return v.join(table(s, d, "documents", "doc_id", "text", "title"), "doc_id")


def _asked(s, d):
    return _texts(s, d).where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), "embedding", F.col("title").alias("query"))


def three_stage_top(s, d):
    return answers.three_stage(_texts(s, d), _asked(s, d)).select("query_id", "doc_id", "hybrid", "score", "rank")


def three_stage_boosted(s, d):
    docs = _texts(s, d)
    return answers.three_stage(docs, _asked(s, d), keep=docs.where("label = 2"), mode="boost", rerank=False).select("query_id", "doc_id", "hybrid", "score", "rank")


def three_stage_filtered(s, d):
    docs = _texts(s, d)
    return answers.three_stage(docs, _asked(s, d), keep=docs.where("label in (1, 3, 5)")).select("query_id", "doc_id", "hybrid", "score", "rank")


def hybrid_top(s, d):
    """Dense candidates by titles' vectors, mixed with the terms that titles share with texts."""
    return answers.three_stage(_texts(s, d), _asked(s, d), (20, 20, 10), rerank=False).select("query_id", "doc_id", "score", "rank")


def rank_fusion(s, d):
    """Ranks by vectors and by the terms of titles, fused."""
    dense = retrieval.dense_top_k(_vectors(s, d), _vector_queries(s, d), 20)
    terms = retrieval.top_k(_bm25_all(s, d, 20), "query_id", "doc_id", "score", 20)
    both = dense.select(F.lit("dense").alias("ranker"), "query_id", "doc_id", "rank").unionByName(terms.select(F.lit("terms").alias("ranker"), "query_id", "doc_id", "rank"))
    return retrieval.top_k(retrieval.reciprocal_rank_fusion(both), "query_id", "doc_id", "score", 10)


def answered_titles(s, d):
    docs, asked = _texts(s, d), _asked(s, d)
    return answers.answers(answers.three_stage(docs, asked), docs, asked)


def title_questions(s, d):
    t = table(s, d, "documents", "doc_id", "title").where("title is not null")
    return answers.read_questions(t.select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")))


def suggested_filters(s, d):
    t = table(s, d, "documents", "title").where("title is not null").distinct()
    return t.select("title", F.array_join(Q.entities("title"), "|").alias("entities"), Q.suggested_year("title").alias("year"), Q.suggested_quarter("title").alias("quarter"), Q.suggested_region("title").alias("region"))


def context_ids(s, d):
    """The documents of each query's context in the order of their ranks."""
    top = dense_top(s, d).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))  # ten a query
    return top.select("query_id", F.array_join(F.transform("x", lambda r: r["doc_id"].cast("string")), ",").alias("doc_ids"), F.size(F.array_distinct(F.transform("x", lambda r: r["doc_id"]))).cast("long").alias("documents"))


def _arcs(s, d):
    """Mentions with their document as the arc."""
    m = mentions(s, d, "mention_id", "doc_id", "document_id", "dimension_name", "text", "normalized", "category", "latitude", "longitude").dropDuplicates(["mention_id"])
    return m.where("document_id is not null").withColumnRenamed("document_id", "arc")


def arc_entities(s, d):
    return stories.key_entities(_arcs(s, d))


def arc_dimensions(s, d):
    return stories.key_dimensions(_arcs(s, d))


def arc_times(s, d):
    return stories.temporal_span(_arcs(s, d))


def arc_places(s, d):
    return stories.spatial_span(_arcs(s, d))


def arc_gaps(s, d):
    return stories.neighbour_gaps(_arcs(s, d))


def arc_progression(s, d):
    return stories.progression(_arcs(s, d))


def time_ranges(s, d):
    m = mentions(s, d, "dimension_name", "text").where("dimension_name = 'temporal' and text is not null").select("text").distinct()
    return m.select("text", Q.time_range("text").alias("r")).select("text", "r.start", "r.end")


def efficiency_targets(s, d):
    return metrics.efficiency_targets(table(s, d, "timings", "total_duration_seconds", "gpu_hours"))


def overall_scores(s, d):
    """Mentions of confidence 0.8 or more against all, by dimension, as one mean."""
    m = mentions(s, d, "dimension_name", "confidence").where("confidence is not null")
    rows = m.groupBy("dimension_name").agg(F.sum((F.col("confidence") >= 0.8).cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    return metrics.overall_scores(rows.select("dimension_name", F.round(2.0 * F.col("tp") / (F.col("tp") + F.col("n")), 6).alias("f1")))


def batch_plans(s, d):
    """Sources as clusters of mentions: their first batches, numbers of batches, and last thresholds."""
    return discovery.batch_plan(mentions(s, d, "source").groupBy("source").agg(F.count(F.lit(1)).alias("size")))


def _entities(s, d):
    return mentions(s, d, "dimension_name", "text", "source").select(F.col("dimension_name").alias("dimension"), "text", F.coalesce("source", F.lit("none")).alias("cluster"))


def dimension_entities(s, d):
    return discovery.dimension_first(_entities(s, d))


def schema_statistics(s, d):
    return discovery.schema_statistics(_entities(s, d))


def fuzzy_categories(s, d):
    allowed = [(r["dimension_name"], r["category"]) for r in table(s, d, "category_ref", "dimension_name", "category").collect()]  # the fixed list
    return filters.fuzzy_categories(mentions(s, d, "dimension_name", "category"), allowed)


def nearby_lines(s, d):
    """A place's five nearest neighbours as lines for a prompt."""
    g = table(s, d, "gazetteer", "place_id", "place_name", "location_type")
    n = nearby_places(s, d).where("rank <= 5").join(g.withColumnRenamed("place_id", "other_id"), "other_id")
    line = F.concat(F.lit("  - "), "place_name", F.lit(" ("), F.coalesce("location_type", F.lit("feature")), F.lit("): "), F.format_number("km", 1), F.lit("km "), "direction")
    per = n.select("place_id", "rank", line.alias("line")).groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return per.select("place_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("lines"))


QUERIES = [
    three_stage_top, three_stage_boosted, three_stage_filtered, hybrid_top, rank_fusion, answered_titles, title_questions, suggested_filters, context_ids, arc_entities, arc_dimensions, arc_times, arc_places, arc_gaps, arc_progression,
    time_ranges, efficiency_targets, overall_scores, batch_plans, dimension_entities, schema_statistics, fuzzy_categories, nearby_lines,
]
