"""Statistics of dimensions, co-occurrence, bursts, flat events and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.functions import columns as C



def temporal_statistics(mentions: DataFrame) -> DataFrame:
    """One row: number of dated mentions, distinct dates, first and last date, days between."""
    d = mentions.where("dimension_name = 'temporal'").select(C.iso_date("normalized").alias("d")).where("d is not null")
    days = F.datediff(F.max("d"), F.min("d"))
    return d.agg(C.rows().alias("total"), F.countDistinct("d").alias("unique_dates"), F.date_format(F.min("d"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("last_date"), F.coalesce(days, F.lit(0)).cast("long").alias("span_days"))


def temporal_distribution(mentions: DataFrame) -> DataFrame:
    """(kind, key, mentions) by year, month of the year, weekday (Monday 0), type and source, from one scan."""
    d = mentions.where("dimension_name = 'temporal'").select(C.iso_date("normalized").alias("d"), "normalization_type", "source").where("d is not null")
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("key")) for k, v in (("year", F.year("d")), ("month", F.month("d")), ("weekday", F.weekday("d")), ("type", F.coalesce("normalization_type", F.lit("unknown"))), ("source", F.coalesce("source", F.lit("unknown"))))])
    return d.select(F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(C.rows().alias("mentions"))


def temporal_timeline(mentions: DataFrame) -> DataFrame:
    """(date, mentions, documents) for each date."""
    d = mentions.where("dimension_name = 'temporal'").select(C.iso_date("normalized").alias("d"), "document_id").where("d is not null")
    return d.groupBy("d").agg(C.rows().alias("mentions"), F.countDistinct("document_id").alias("documents")).select(F.date_format("d", "yyyy-MM-dd").alias("date"), "mentions", "documents")


def spatial_statistics(mentions: DataFrame) -> DataFrame:
    """One row: mentions, distinct texts, share located, bounding box and centroid of the located ones."""
    s = mentions.where("dimension_name = 'spatial'").select("text", "latitude", "longitude", C.located().alias("ok"))
    at = lambda f, c: F.round(f(F.when(F.col("ok"), F.col(c))), 6)
    return s.agg(
        C.rows().alias("total"), F.countDistinct("text").alias("unique_texts"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("located_share"),
        at(F.min, "latitude").alias("min_lat"), at(F.max, "latitude").alias("max_lat"), at(F.min, "longitude").alias("min_lon"), at(F.max, "longitude").alias("max_lon"),
        at(F.avg, "latitude").alias("center_lat"), at(F.avg, "longitude").alias("center_lon"),
    )


def top_texts(mentions: DataFrame, limit: int = 20) -> DataFrame:
    """(dimension_name, text, mentions, rank): the most frequent texts of each dimension; ties by text."""
    counts = mentions.where("text is not null").groupBy("dimension_name", "text").agg(C.rows().alias("mentions"))
    w = W.partitionBy("dimension_name").orderBy(F.desc("mentions"), "text")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def category_statistics(mentions: DataFrame) -> DataFrame:
    """(dimension_name, category, mentions, documents, confidence) of the categorical dimensions."""
    m = mentions.where("category is not null")
    return m.groupBy("dimension_name", "category").agg(C.rows().alias("mentions"), F.countDistinct("document_id").alias("documents"), F.round(F.avg("category_confidence"), 6).alias("confidence"))


def category_by_source(mentions: DataFrame) -> DataFrame:
    return mentions.where("category is not null and source is not null").groupBy("dimension_name", "source", "category").agg(C.rows().alias("mentions"))


def cross_dimensional(mentions: DataFrame, value: Column, doc: str = "document_id") -> DataFrame:
    """(dim_a, value_a, dim_b, value_b, documents): values of two dimensions in one document, dim_a before dim_b.

    Values of a document are made distinct and folded into one array a document and dimension first, so the join
    on the document carries a row for each of its dimensions, not for each mention.
    """
    v = mentions.select(F.col(doc).alias("doc"), F.col("dimension_name").alias("dim"), value.alias("value")).where("doc is not null and value is not null")
    sets = v.groupBy("doc", "dim").agg(F.collect_set("value").alias("values"))
    a, b = sets.select("doc", F.col("dim").alias("dim_a"), F.col("values").alias("va")), sets.select("doc", F.col("dim").alias("dim_b"), F.col("values").alias("vb"))
    both = a.join(b, "doc").where("dim_a < dim_b").select("dim_a", "dim_b", F.explode("va").alias("value_a"), "vb").select("dim_a", "value_a", "dim_b", F.explode("vb").alias("value_b"))
    return both.groupBy("dim_a", "value_a", "dim_b", "value_b").agg(C.rows().alias("documents"))


def global_statistics(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, key, n): chunks in all, with and without mentions, mentions by dimension, chunks by source."""
    ids = chunks.select("doc_id", F.coalesce(F.col("document_metadata")["source"], F.lit("unknown")).alias("source")).distinct()
    hit = mentions.where("doc_id is not null").select("doc_id").distinct().withColumn("hit", F.lit(1))
    c = ids.join(hit, "doc_id", "left")
    row = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), F.lit(key).alias("key"), n.cast("long").alias("n"))
    totals = c.agg(F.array(row("chunks", "all", C.rows()), row("chunks", "with_mentions", F.count("hit")), row("chunks", "without_mentions", C.rows() - F.count("hit"))).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    dims = mentions.groupBy("dimension_name").agg(C.rows().alias("n")).select(F.lit("dimension").alias("kind"), F.col("dimension_name").alias("key"), "n")
    sources = c.groupBy("source").agg(C.rows().alias("n")).select(F.lit("source").alias("kind"), F.col("source").alias("key"), "n")
    return totals.unionByName(dims).unionByName(sources)


def document_summary(mentions: DataFrame) -> DataFrame:
    """(document_id, temporal, spatial, other, mentions, confidence): a row for each document."""
    dim = F.col("dimension_name")
    return mentions.where("document_id is not null").groupBy("document_id").agg(
        F.count_if(dim == "temporal").alias("temporal"), F.count_if(dim == "spatial").alias("spatial"), F.count_if(~dim.isin("temporal", "spatial")).alias("other"), C.rows().alias("mentions"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def bursts(times: DataFrame, at: str = "ts", every: str = "1 day", sigmas: float = 2.0) -> DataFrame:
    """(bin, events, threshold, intensity): bins over mean + sigmas sample deviations; empty bins count as 0.

    Bins are counted before they meet the full range of bins, so one row a bin is all that is shuffled.
    """
    counted = times.where(F.col(at).isNotNull()).groupBy(F.window(F.col(at).cast("timestamp"), every).alias("w")).agg(C.rows().alias("events")).select(F.col("w.start").alias("bin"), "events")
    span = counted.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {every}"))).alias("bin"))
    full = span.join(counted, "bin", "left").select("bin", F.coalesce("events", F.lit(0).cast("long")).alias("events"))
    m = full.agg(F.avg("events").alias("mean"), F.stddev_samp("events").alias("sd")).first()  # one row
    mean, sd = F.lit(m["mean"]).cast("double"), F.lit(m["sd"]).cast("double")
    limit = mean + F.lit(sigmas) * sd
    return full.where(F.col("events") > limit).select(F.date_format("bin", "yyyy-MM-dd HH:mm:ss").alias("bin"), "events", F.round(limit, 6).alias("threshold"), F.round((F.col("events") - mean) / sd, 6).alias("intensity"))


def flat_events(mentions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A row for each pair of a dated and a located mention of a chunk, or for either alone where the other is missing."""
    t = mentions.where("dimension_name = 'temporal'").select(doc, F.date_format(C.iso_date("normalized"), "yyyy-MM-dd").alias("date"), F.col("text").alias("time_text")).where("date is not null").distinct()
    s = mentions.where(F.col("dimension_name").eqNullSafe("spatial") & C.located()).select(doc, F.col("text").alias("place"), "latitude", "longitude").distinct()
    ok = F.col(doc).isNotNull()
    return t.where(ok).join(s.where(ok), doc, "full").select(F.col(doc).alias("doc_id"), "date", "time_text", "place", "latitude", "longitude")


def geojson_features(events: DataFrame) -> DataFrame:
    """(doc_id, feature): a GeoJSON point feature for each located event."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("doc_id", "place", "date").alias("properties"))
    return events.where("latitude is not null").select("doc_id", F.to_json(feature).alias("feature"))


def enriched(mentions: DataFrame) -> DataFrame:
    """A row for each document with its first dated and first located mention (by mention_id) and their parts."""
    t = mentions.where("dimension_name = 'temporal'").withColumn("d", C.iso_date("normalized")).where("d is not null and document_id is not null")
    t = t.groupBy("document_id").agg(F.min_by(F.struct("d", "text"), "mention_id").alias("t"))
    s = mentions.where("dimension_name = 'spatial' and document_id is not null").where(C.located()).groupBy("document_id").agg(F.min_by(F.struct("text", "latitude", "longitude", "location_type"), "mention_id").alias("s"))
    out = t.join(s, "document_id", "full")
    return out.select("document_id", F.date_format("t.d", "yyyy-MM-dd").alias("temporal_normalized"), F.year("t.d").alias("temporal_year"), F.quarter("t.d").alias("temporal_quarter"), F.month("t.d").alias("temporal_month"), F.col("t.text").alias("temporal_text"), F.col("s.text").alias("spatial_text"), F.col("s.latitude").alias("latitude"), F.col("s.longitude").alias("longitude"), F.col("s.location_type").alias("location_type"))


def inverted_index(enriched_docs: DataFrame) -> DataFrame:
    """(kind, key, documents): years, quarters, months and places to the number of their documents."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("year", F.col("temporal_year").cast("string")), ("quarter", F.concat(F.lit("Q"), "temporal_quarter")), ("month", F.substring("temporal_normalized", 1, 7)), ("place", F.lower("spatial_text")))])
    return enriched_docs.select("document_id", F.explode(keys).alias("k")).where("k.key is not null").groupBy("k.kind", "k.key").agg(F.countDistinct("document_id").alias("documents"))
