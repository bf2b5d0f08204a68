"""What an arc of events tells: key entities, spans in time and space, gaps between neighbours, confidence.

An arc is any grouping of events: chunks of a component of story edges, or chunks of a document.  All functions take
long mentions with a column `arc` (string or long) beside doc_id, and are aggregates; no arc is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.functions import columns as C


def key_entities(m: DataFrame, most: int = 3) -> DataFrame:
    """(arc, dimension_name, text, mentions, rank): the most frequent texts of each dimension of an arc, ties by text."""
    n = m.where("text <> ''").groupBy("arc", "dimension_name", "text").agg(C.rows().alias("mentions"))
    w = W.partitionBy("arc", "dimension_name").orderBy(F.desc("mentions"), "text")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def key_dimensions(m: DataFrame) -> DataFrame:
    """(arc, dimension_name, texts, categories): how many distinct texts and categories of each dimension an arc has."""
    return m.groupBy("arc", "dimension_name").agg(F.countDistinct(F.nullif("text", F.lit(""))).alias("texts"), F.countDistinct(F.nullif("category", F.lit(""))).alias("categories"))


def first_dates(m: DataFrame) -> DataFrame:
    """(arc, doc_id, d): the first date of each event; events without one are left out."""
    d = m.where("dimension_name = 'temporal' and doc_id is not null").select("arc", "doc_id", C.iso_date("normalized").alias("d"))
    return d.where("d is not null").groupBy("arc", "doc_id").agg(F.min("d").alias("d"))


def temporal_span(m: DataFrame) -> DataFrame:
    """(arc, start, end, days, dated) between the first dates of an arc's events."""
    g = first_dates(m).groupBy("arc").agg(F.min("d").alias("a"), F.max("d").alias("b"), C.rows().alias("dated"))
    return g.select("arc", F.date_format("a", "yyyy-MM-dd").alias("start"), F.date_format("b", "yyyy-MM-dd").alias("end"), F.datediff("b", "a").cast("long").alias("days"), "dated")


def spatial_span(m: DataFrame) -> DataFrame:
    """(arc, places, box and centre) over the located mentions of an arc, copies of a mention counted once."""
    p = m.where((F.col("dimension_name") == "spatial") & C.located()).select("arc", "mention_id", "latitude", "longitude").distinct()
    box = [f(c).alias(f"{n}_{s}") for c, s in (("latitude", "lat"), ("longitude", "lon")) for f, n in ((F.min, "min"), (F.max, "max"))]
    return p.groupBy("arc").agg(C.rows().alias("places"), *box, F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon"))


def neighbour_gaps(m: DataFrame) -> DataFrame:
    """(arc, pairs, mean_gap, max_gap, coherence): days between an arc's dated events in their order.

    coherence is 1 - max_gap / 14, at least 0, and 1 for a single event.  Equal dates are gaps of 0.  Times within an
    arc are first counted by date, so the window sees an arc's distinct dates, not its events.
    """
    days = first_dates(m).groupBy("arc", "d").agg(C.rows().alias("n"))
    w = W.partitionBy("arc").orderBy("d")
    g = days.withColumn("gap", F.datediff("d", F.lag("d").over(w)))
    out = g.groupBy("arc").agg((F.sum("n") - 1).alias("pairs"), F.coalesce(F.sum("gap"), F.lit(0)).alias("total"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap"))
    return out.select("arc", "pairs", F.round(F.coalesce(F.try_divide("total", "pairs"), F.lit(0.0)), 6).alias("mean_gap"), "max_gap", F.round(F.greatest(F.lit(0.0), 1 - F.col("max_gap") / 14), 6).alias("coherence"))


def progression(m: DataFrame) -> DataFrame:
    """(arc, doc_id, date, place, step): an arc's events in the order of their first dates, undated ones last."""
    place = m.where("dimension_name = 'spatial' and text <> '' and doc_id is not null").groupBy("arc", "doc_id").agg(F.min_by("text", F.struct("mention_id", "text")).alias("place"))
    e = m.where("doc_id is not null").select("arc", "doc_id").distinct().join(first_dates(m), ["arc", "doc_id"], "left").join(place, ["arc", "doc_id"], "left")
    w = W.partitionBy("arc").orderBy(F.asc_nulls_last("d"), "doc_id")
    return e.select("arc", "doc_id", F.date_format("d", "yyyy-MM-dd").alias("date"), F.coalesce("place", F.lit("Unknown")).alias("place"), F.row_number().over(w).alias("step"))
