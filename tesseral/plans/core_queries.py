"""Queries of the core over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.functions import columns as C
from tesseral.operators import analysis, clusters, context, discovery, filters, instants, metrics, retrieval, text
from tesseral.sources.tables import table, utc_timestamps


def mentions(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "mentions", *cols)


def temporal_ids(s, d):
    return filters.filter_temporal(mentions(s, d), year=2022, quarter=2)


def temporal_range_ids(s, d):
    return filters.filter_temporal(mentions(s, d), start="2022-03-01", end="2022-06-30")


def bbox_ids(s, d):
    return filters.filter_spatial(mentions(s, d), bbox=(-60.0, -40.0, 60.0, 40.0))


def radius_ids(s, d):
    return filters.filter_spatial(mentions(s, d), center=(10.0, 20.0), radius_km=2500.0)


def any_ids(s, d):
    return filters.filter_dimension(mentions(s, d), "event_type", ["flood", "bushfire"])


def all_ids(s, d):
    return filters.filter_dimension(mentions(s, d), "event_type", ["flood", "bushfire"], "all")


def and_ids(s, d):
    return filters.combine([temporal_ids(s, d), bbox_ids(s, d), any_ids(s, d)], "and")


def or_ids(s, d):
    return filters.combine([temporal_ids(s, d), bbox_ids(s, d), any_ids(s, d)], "or")


def filter_stats(s, d):
    return filters.filter_statistics({"temporal": temporal_ids(s, d), "spatial": bbox_ids(s, d), "label": any_ids(s, d)})


def _postings(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    c = table(s, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    h = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return filters.postings(h.select("c_custkey", F.lit("place").alias("dim"), F.array("r_name", "n_name").alias("levels")).unionByName(c.select("c_custkey", F.lit("segment").alias("dim"), F.array("c_mktsegment").alias("levels"))), "c_custkey", "dim", "levels")


def dimension_postings(s, d):
    return _postings(s, d).groupBy("dim", "kind", "key").agg(F.count(F.lit(1)).alias("docs"))


def hierarchical_ids(s, d):
    return filters.hierarchical_filter(_postings(s, d), {"place": ["asia", "europe > g"], "segment": ["building"]})


def dimension_top(s, d):
    return filters.dimension_statistics(_postings(s, d)).select("dim", "key", "docs", "rank")


def available_keys(s, d):
    return _postings(s, d).select("dim", "kind", "key").distinct()


def category_validation(s, d):
    return filters.validate_categories(mentions(s, d), table(s, d, "category_ref"))


def temporal_stats(s, d):
    return analysis.temporal_statistics(mentions(s, d))


def temporal_distribution(s, d):
    return analysis.temporal_distribution(mentions(s, d))


def temporal_timeline(s, d):
    return analysis.temporal_timeline(mentions(s, d))


def spatial_stats(s, d):
    return analysis.spatial_statistics(mentions(s, d))


def top_texts(s, d):
    return analysis.top_texts(mentions(s, d))


def category_stats(s, d):
    return analysis.category_statistics(mentions(s, d))


def category_by_source(s, d):
    return analysis.category_by_source(mentions(s, d))


def cross_dimensional(s, d):
    return analysis.cross_dimensional(mentions(s, d).where("dimension_name in ('event_type', 'disease', 'organization')"), F.lower(F.trim("category")))


def cross_dimensional_all(s, d):
    """All dimensions, by category, else text; cross_dimensional has three dimensions and categories only, as its SQL."""
    clean = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    return analysis.cross_dimensional(mentions(s, d), F.coalesce(clean("category"), clean("text")))


def global_stats(s, d):
    return analysis.global_statistics(mentions(s, d), table(s, d, "document_chunks"))


def document_summary(s, d):
    return analysis.document_summary(mentions(s, d))


def burst_days(s, d):
    return analysis.bursts(utc_timestamps(table(s, d, "events", "ts")), every="1 day", sigmas=1.0)


def burst_hours(s, d):
    return analysis.bursts(utc_timestamps(table(s, d, "events", "ts")), every="1 hour")


def temporal_clusters(s, d):
    m = mentions(s, d, "mention_id", "dimension_name", "normalized").where("dimension_name = 'temporal'").select("mention_id", C.iso_timestamp("normalized").alias("ts")).distinct()
    got = clusters.temporal_islands(m, "ts", "mention_id", hours=24.0, least=2)
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("first_mention")).select("first_mention", "size")


def categorical_clusters(s, d):
    return clusters.categorical_clusters(mentions(s, d))


def spatial_clusters(s, d):
    return clusters.spatial_clusters(mentions(s, d)).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("first_mention")).select("first_mention", "size")


def _dated_places(s, d):
    e = analysis.enriched(mentions(s, d)).where("latitude is not null and temporal_normalized is not null")
    return e.select(F.col("document_id").alias("key"), "document_id", "latitude", "longitude", F.to_date("temporal_normalized").alias("date"))


def spatiotemporal_clusters(s, d):
    got = clusters.spatiotemporal_clusters(_dated_places(s, d).drop("document_id"), km=2000.0, day_weight=0.001)
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("first_document")).select("first_document", "size")


def multi_clusters(s, d):
    e = _dated_places(s, d)
    got = clusters.spatiotemporal_clusters(e.drop("document_id"), km=2000.0, day_weight=0.001)
    return clusters.multi_clusters(got, mentions(s, d), e.select("key", "document_id")).select("signature", "size")


def cluster_statistics(s, d):
    return clusters.cluster_statistics(clusters.spatial_clusters(mentions(s, d)))


def flat_events(s, d):
    return analysis.flat_events(mentions(s, d))


def geojson_features(s, d):
    return analysis.geojson_features(analysis.flat_events(mentions(s, d)))


def enriched_documents(s, d):
    return analysis.enriched(mentions(s, d))


def inverted_index(s, d):
    return analysis.inverted_index(analysis.enriched(mentions(s, d)))


def story_edges(s, d):
    return clusters.story_edges(mentions(s, d))


def story_arcs(s, d):
    return clusters.story_arcs_of(mentions(s, d)).drop("component")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label").dropDuplicates(["doc_id"])


def _vector_queries(s, d):
    return _vectors(s, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "label")


def dense_top(s, d):
    return retrieval.dense_top_k(_vectors(s, d), _vector_queries(s, d), 10)


def pre_filter_top(s, d):
    v = _vectors(s, d)
    return retrieval.dense_top_k(v, _vector_queries(s, d), 10, keep=v.where("label in (1, 3, 5)"))


def post_filter_top(s, d):
    v = _vectors(s, d)
    return retrieval.post_filter(retrieval.dense_top_k(v, _vector_queries(s, d), 30), v.where("label in (1, 3, 5)"), 10)


def ivf_top(s, d):
    index, q = retrieval.InvertedFileIndex(_vectors(s, d)), _vector_queries(s, d)
    return index.search(q, 10, index.probe_for(q, 10))


TERM_QUERIES = [(1, "river flood warning"), (2, "measles cases confirmed by the hospital"), (3, "storm moved towards the levee")]


def _bm25(s, d):
    docs = table(s, d, "documents", "doc_id", "text")
    return retrieval.bm25(docs, s.createDataFrame(TERM_QUERIES, "query_id long, query string"))


def _title_queries(s, d):
    """(query_id, query): the titles of a twentieth of the documents, as the vectors of dense searches."""
    return table(s, d, "documents", "doc_id", "title").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").cast("long").alias("query_id"), F.col("title").alias("query"))


def _bm25_all(s, d, best=None):
    return retrieval.bm25(table(s, d, "documents", "doc_id", "text"), _title_queries(s, d), best=best)


def bm25_scores_all(s, d):
    """Titles as queries; bm25_scores and bm25_top have the three phrases of their SQL."""
    return _bm25_all(s, d)


def bm25_top_all(s, d):
    return retrieval.top_k(_bm25_all(s, d, 10).withColumn("score", F.round("score", 4)), "query_id", "doc_id", "score", 10)


def bm25_scores(s, d):
    return _bm25(s, d)


def bm25_top(s, d):
    return retrieval.top_k(_bm25(s, d).withColumn("score", F.round("score", 4)), "query_id", "doc_id", "score", 10)


def boosted_top(s, d):
    dense = retrieval.dense_top_k(_vectors(s, d), _vector_queries(s, d), 30)
    return retrieval.top_k(retrieval.boosted(dense, _vectors(s, d).where("label = 2")), "query_id", "doc_id", "score", 10)


def packed_context(s, d):
    return retrieval.pack_found(bm25_top_all(s, d), table(s, d, "documents", "doc_id", "text"))


def multi_hop(s, d):
    return retrieval.multi_hop(table(s, d, "documents", "doc_id", "text", "title"), _title_queries(s, d))


def nearby_places(s, d):
    return retrieval.nearby_places(table(s, d, "gazetteer"), km=500.0)


def geocoded(s, d):
    return retrieval.geocoded(mentions(s, d), table(s, d, "gazetteer"))


def context_memory(s, d):
    return context.memory(mentions(s, d, "mention_id", "doc_id", "document_id", "dimension_name", "text"))


def context_memory_all(s, d):
    """Memory of every chunk; context_memory has rows of chunks with mentions of the dimension only, as its SQL."""
    return context.memory(mentions(s, d, "mention_id", "doc_id", "document_id", "dimension_name", "text"), chunks=table(s, d, "document_chunks", "doc_id", "document_id"))


def prompt_lines(s, d):
    every = context.chunk_keys(table(s, d, "document_chunks", "doc_id", "document_id").unionByName(mentions(s, d, "doc_id", "document_id")))
    got = context.prompt_lines(context_memory_all(s, d))
    return every.join(got, ["document_id", "chunk_index"], "left").withColumn("prompt", F.coalesce("prompt", F.lit("")))


def confidence_rollup(s, d):
    """Mentions of confidence 0.8 or more against all, by dimension and in total."""
    m = mentions(s, d, "dimension_name", "confidence").where("confidence is not null")
    rows = m.select("dimension_name", (F.col("confidence") >= 0.8).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("confidence") < 0.8).cast("long").alias("fn"))
    return metrics.rolled_up(rows, ["dimension_name"], ["tp", "fp", "fn"])


def schema_mentions(s, d):
    return filters.of_schema(mentions(s, d, "mention_id", "dimension_name", "text"), ["Temporal", "spatial"]).distinct()


def latency_improvement(s, d):
    t = table(s, d, "timings", "total_duration_seconds", "gpu_hours", "num_gpus")
    return metrics.improvement(metrics.latency(t.where("num_gpus = 1")), metrics.latency(t.where("num_gpus > 1")), ["p50", "p95", "mean"])


def anchor_dates(s, d):
    return context.anchor_dates(mentions(s, d).dropDuplicates(["mention_id"]), table(s, d, "parsed_documents", "document_id", "date"))


def content_copies(s, d):
    docs = table(s, d, "documents", "doc_id", "text").where("text <> ''")
    return docs.groupBy(C.content_id("text").alias("content_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def merged_ids(s, d):
    a = table(s, d, "parsed_documents", "document_id").withColumn("rank", F.lit(1))
    b = table(s, d, "input_documents", "document_id").withColumn("rank", F.lit(2))
    return a.unionByName(b).groupBy("document_id").agg(F.min("rank").alias("first_table"), F.countDistinct("rank").alias("tables"))


def unfinished_documents(s, d):
    return table(s, d, "input_documents", "document_id").distinct().join(table(s, d, "parsed_documents", "document_id"), "document_id", "left_anti")


def _answers(s, d):
    a = table(s, d, "input_documents", "document_id", "title").where("title is not null").distinct()
    b = table(s, d, "parsed_documents", "document_id", "title", "content").distinct()
    return a.join(b.select("document_id", F.col("title").alias("gold"), F.col("content").alias("context")), "document_id").where("gold is not null").select(F.col("document_id").alias("question_id"), F.col("title").alias("predicted"), "gold", "context")


def normalised_answers(s, d):
    return table(s, d, "parsed_documents", "title").where("title is not null").distinct().select("title", C.normalise_answer("title").alias("answer"))


def qa_rows(s, d):
    return metrics.qa_rows(_answers(s, d))


def qa_summary(s, d):
    return metrics.qa_summary(metrics.qa_rows(_answers(s, d)))


def retrieval_rows(s, d):
    ranked = retrieval.dense_top_k(_vectors(s, d), _vector_queries(s, d), 20)
    relevant = _vector_queries(s, d).select("query_id", "label").join(_vectors(s, d).select("doc_id", "label"), "label")
    return metrics.retrieval_rows(ranked, relevant)


def retrieval_summary(s, d):
    return metrics.retrieval_summary(retrieval_rows(s, d))


def extraction_counts(s, d):
    """Mentions of confidence 0.8 or more, held against those that a later step could normalise or categorise."""
    m = mentions(s, d, "mention_id", "document_id", "dimension_name", "text", "confidence", "normalized", "category").where("text is not null and document_id is not null")
    low = lambda df: df.select("document_id", "dimension_name", F.lower("text").alias("text"))
    return metrics.extraction_counts(low(m.where("confidence >= 0.8")), low(m.where("normalized is not null or category is not null")), ["document_id", "dimension_name", "text"])


def distance_accuracy(s, d):
    g = table(s, d, "gazetteer", "place_name", "latitude", "longitude")
    m = mentions(s, d).where("dimension_name = 'spatial'").where(C.located()).select("text", F.col("latitude").alias("a"), F.col("longitude").alias("o"))
    near = m.join(g, F.lower("text") == F.lower("place_name")).select(F.round(C.haversine("a", "o", "latitude", "longitude"), 6).alias("km"))
    return metrics.distance_accuracy(near)


def latency(s, d):
    return metrics.latency(table(s, d, "timings", "total_duration_seconds", "gpu_hours"))


def component_times(s, d):
    return metrics.component_times(table(s, d, "timings", "components"))


def duration_correlation(s, d):
    return metrics.correlation(table(s, d, "timings", "total_duration_seconds", "gpu_hours"), "total_duration_seconds", "gpu_hours")


def keywords(s, d):
    return text.keywords(table(s, d, "document_chunks", "doc_id", "text").distinct(), "doc_id", "text")


def previews(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", C.preview("text").alias("preview"))


def sliding_chunks(s, d):
    return text.chunked(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", 1500, 150, "sliding")


def paragraph_chunks(s, d):
    return text.chunked(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", 1500, 150, "paragraph")


def element_chunks(s, d):
    """The chunks of each document as its elements: their first type, and the depth of their hierarchy."""
    parts = table(s, d, "document_chunks", "document_id", "chunk_index", "element_types", "section_hierarchy", "text").distinct()
    kind = F.coalesce(F.lower(F.get("element_types", F.lit(0))), F.lit("text"))
    level = F.coalesce(F.size(F.split("section_hierarchy", r"\s*>\s*")), F.lit(1))
    return text.element_chunks(parts.where("document_id is not null").select("document_id", F.col("chunk_index").alias("pos"), kind.alias("type"), level.alias("level"), "text"))


def table_cells(s, d):
    c = table(s, d, "document_chunks", "doc_id", "text").where(F.col("text").contains(" | ")).distinct()
    rows = F.filter(C.table_rows("text"), lambda r: F.size(r) > 1)
    return c.select("doc_id", F.size(rows).cast("long").alias("rows"), F.size(F.flatten(rows)).cast("long").alias("cells"))


def resolved_phrases(s, d):
    phrases = ["yesterday", "next week", "on Friday", "2022-03-15", "last month", "soon"]
    dates = table(s, d, "parsed_documents", "document_id", "date").distinct().select("document_id", C.iso_date("date").alias("anchor")).where("anchor is not null")
    rows = dates.withColumn("phrase", F.explode(F.array(*[F.lit(p) for p in phrases])))
    return rows.select("document_id", "phrase", C.resolve_relative("phrase", "anchor").alias("resolved"))


def resolved_mentions(s, d):
    """(mention_id, text, anchor, resolved) of all temporal mentions; dates in any notation serve as anchors."""
    zones = table(s, d, "sources", "source", "time_zone", "date_order")

    def dated(rows, column, key):
        """rows with the column as an ISO value, where it names a date."""
        other = rows.where(F.col(column).isNotNull() & C.iso_date(column).isNull()).join(zones, "source", "left")
        utc = instants.normalise_instants(other, column, "time_zone", "date_order", [key]).groupBy(key).agg(F.min("utc").alias("utc"))
        return rows.join(utc, key, "left").withColumn(column, F.when(C.iso_date(column).isNotNull(), F.col(column)).otherwise(F.col("utc"))).drop("utc")

    m = mentions(s, d, "mention_id", "doc_id", "document_id", "dimension_name", "source", "text", "normalized").dropDuplicates(["mention_id"])
    t = dated(m.where("dimension_name = 'temporal'"), "normalized", "mention_id")
    pages = dated(table(s, d, "parsed_documents", "page_id", "document_id", "source", "date").distinct(), "date", "page_id").select("document_id", "date")
    anchors = context.anchor_dates(t, pages)
    own = pages.groupBy("document_id").agg(F.date_format(F.min(C.iso_date("date")), "yyyy-MM-dd").alias("own"))
    rows = t.where("text is not null").withColumn("chunk_index", F.regexp_extract("doc_id", r"_chunk_(\d+)$", 1).try_cast("int")).join(anchors, ["document_id", "chunk_index"], "left").join(own, "document_id", "left")
    rows = rows.withColumn("anchor", F.coalesce("anchor", "own"))
    return rows.select("mention_id", "text", "anchor", C.resolve_relative("text", F.col("anchor").cast("date")).alias("resolved"))


def time_parts(s, d):
    m = mentions(s, d).where("dimension_name = 'temporal'").select("mention_id", *C.time_parts("normalized")).distinct()
    return m.where("year is not null")


def directions(s, d):
    a = table(s, d, "gazetteer").where("place_id % 2 = 0").select((F.col("place_id") + 1).alias("to_id"), "place_id", F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    b = table(s, d, "gazetteer").select(F.col("place_id").alias("to_id"), "latitude", "longitude")
    deg = C.bearing("la", "lo", "latitude", "longitude")
    return a.join(b, "to_id").select("place_id", "to_id", F.round(deg, 4).alias("bearing"), C.direction(deg).alias("direction"), F.round(C.haversine("la", "lo", "latitude", "longitude"), 4).alias("km"))


def directions_all(s, d):
    """From each place to the next; directions has every other place, as its SQL."""
    g = table(s, d, "gazetteer", "place_id", "latitude", "longitude")
    a = g.select((F.col("place_id") + 1).alias("to_id"), "place_id", F.col("latitude").alias("la"), F.col("longitude").alias("lo"))
    deg = C.bearing("la", "lo", "latitude", "longitude")
    return a.join(g.withColumnRenamed("place_id", "to_id"), "to_id").select("place_id", "to_id", F.round(deg, 4).alias("bearing"), C.direction(deg).alias("direction"), F.round(C.haversine("la", "lo", "latitude", "longitude"), 4).alias("km"))


def query_kinds(s, d):
    t = table(s, d, "documents", "title").where("title is not null").distinct()
    q = t.select("title", F.concat(F.lit("What happened in "), "title", F.lit(" during 2022??")).alias("q"))
    return q.select("title", C.clean_query("q").alias("query"), C.query_kind("q").alias("kind"), F.array_join(C.temporal_hints("q"), ",").alias("years"))


def title_kinds(s, d):
    """Titles as they are; query_kinds has them in the template of its SQL."""
    t = table(s, d, "documents", "title").where("title is not null").distinct()
    return t.select("title", C.clean_query("title").alias("query"), C.query_kind("title").alias("kind"), F.array_join(C.temporal_hints("title"), ",").alias("years"))


def question_clusters(s, d):
    return discovery.cluster_profile(discovery.kmeans(_vectors(s, d)))


def question_samples(s, d):
    return discovery.representatives(discovery.kmeans(_vectors(s, d)))


def derived_dimensions(s, d):
    m = mentions(s, d, "mention_id", "dimension_name", "category", "hierarchy", "location_type").dropDuplicates(["mention_id"])
    have = F.map_filter(F.create_map(F.lit("category"), F.col("category"), F.lit("location_type"), F.col("location_type"), F.lit("level"), F.col("hierarchy")["level"]), lambda k, v: v.isNotNull())
    return discovery.derived_dimensions(m.select(F.col("mention_id").alias("entity"), F.col("dimension_name").alias("dimension"), have.alias("fields"))).select("dimension", "field", "share", "rank")


def merged_schema(s, d):
    """The categories of all mentions; a cluster is a source, in the order of names, mentions without one the first."""
    m = mentions(s, d, "source", "category").where("category is not null").distinct()
    sources = m.select("source").distinct().withColumn("cluster", F.row_number().over(W.orderBy(F.asc_nulls_first("source"))).cast("long"))  # a row a source
    return discovery.merged_schema(m.join(F.broadcast(sources), m["source"].eqNullSafe(sources["source"])).select(F.col("category").alias("name"), "cluster"))


def distinct_entities(s, d):
    return discovery.distinct_entities(mentions(s, d, "dimension_name", "text").select(F.col("dimension_name").alias("dimension"), "text")).select("dimension", "key", "variants", "mentions")


def yearly_rollup(s, d):
    m = mentions(s, d).where("dimension_name = 'temporal'").select(C.iso_date("normalized").alias("d"), F.coalesce("source", F.lit("none")).alias("source")).where("d is not null")
    return m.rollup(F.year("d").alias("year"), "source").agg(F.count(F.lit(1)).alias("mentions"), F.grouping_id().cast("long").alias("level"))


def event_windows(s, d):
    e = utc_timestamps(table(s, d, "events", "ts", "event_type", "value"))
    return e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean")).select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("bin"), "event_type", "events", "mean")


def event_sessions(s, d):
    e = utc_timestamps(table(s, d, "events", "ts", "user_id"))
    g = e.groupBy(F.session_window("ts", "4 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


def input_ids(s, d):
    from tesseral.sources.readers import from_texts

    return from_texts(table(s, d, "documents", "text").where("text is not null")).groupBy("document_id").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n"))


QUERIES = [
    temporal_ids, temporal_range_ids, bbox_ids, radius_ids, any_ids, all_ids, and_ids, or_ids, filter_stats, dimension_postings, hierarchical_ids, dimension_top, available_keys, category_validation,
    temporal_stats, temporal_distribution, temporal_timeline, spatial_stats, top_texts, category_stats, category_by_source, cross_dimensional, cross_dimensional_all, global_stats, document_summary, burst_days, burst_hours,
    temporal_clusters, categorical_clusters, spatial_clusters, spatiotemporal_clusters, multi_clusters, cluster_statistics, flat_events, geojson_features, enriched_documents, inverted_index, story_edges, story_arcs,
    dense_top, pre_filter_top, post_filter_top, ivf_top, bm25_scores, bm25_top, bm25_scores_all, bm25_top_all, boosted_top, packed_context, multi_hop, nearby_places, geocoded, context_memory, context_memory_all, prompt_lines, anchor_dates, confidence_rollup, schema_mentions, latency_improvement,
    content_copies, merged_ids, unfinished_documents, normalised_answers, qa_rows, qa_summary, retrieval_rows, retrieval_summary, extraction_counts, distance_accuracy, latency, component_times, duration_correlation,
    keywords, previews, sliding_chunks, paragraph_chunks, element_chunks, table_cells, resolved_phrases, resolved_mentions, time_parts, directions, directions_all, query_kinds, title_kinds, question_clusters, question_samples, derived_dimensions, merged_schema,
    distinct_entities, yearly_rollup, event_windows, event_sessions, input_ids,
]
