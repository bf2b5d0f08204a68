"""Dimensional filters over the long mention table, postings and their set algebra."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesseral.functions import columns as C

ID = "document_id"


def _ids(df: DataFrame) -> DataFrame:
    return df.where(F.col(ID).isNotNull()).select(ID).distinct()


def filter_temporal(mentions: DataFrame, year: int | None = None, quarter: int | None = None, month: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Ids with a temporal mention that meets all given criteria, the range inclusive; without criteria none."""
    d = C.iso_date("normalized")
    tests = [t for v, t in ((year, F.year(d) == year), (quarter, F.quarter(d) == quarter), (month, F.month(d) == month), (start, d >= F.lit(start).cast("date")), (end, d <= F.lit(end).cast("date"))) if v is not None]
    times = mentions.where(F.col("dimension_name") == "temporal")
    return _ids(times.where(reduce(lambda a, b: a & b, tests) if tests else F.lit(False)))


def filter_spatial(mentions: DataFrame, region: str | None = None, bbox: tuple | None = None, center: tuple | None = None, radius_km: float | None = None) -> DataFrame:
    """Ids with a located mention in the region (by name), the box (min_lon, min_lat, max_lon, max_lat) and the radius."""
    a, o = F.col("latitude"), F.col("longitude")
    tests = []
    if region is not None:
        tests.append(F.lower("text") == region.lower())
    if bbox is not None:
        tests.append(o.between(bbox[0], bbox[2]) & a.between(bbox[1], bbox[3]) & C.located())
    if center is not None and radius_km is not None:
        # a band of latitude first: a plain range that the scan can use before any trigonometry
        band = radius_km / 111.0
        tests.append(a.between(center[0] - band, center[0] + band) & C.located() & (C.haversine("latitude", "longitude", F.lit(center[0]), F.lit(center[1])) <= radius_km))
    places = mentions.where(F.col("dimension_name") == "spatial")
    return _ids(places.where(reduce(lambda x, y: x & y, tests) if tests else F.lit(False)))


def filter_dimension(mentions: DataFrame, dimension: str, values: list[str], mode: str = "any") -> DataFrame:
    """Ids whose labels in a dimension include any, or all, of the values."""
    wanted = sorted({v.strip().lower() for v in values})
    label = F.lower(F.trim("category"))
    hits = mentions.where((F.col("dimension_name") == dimension) & label.isin(*wanted) & F.col(ID).isNotNull())
    if mode == "any":
        return _ids(hits)
    if mode != "all":
        raise ValueError(f"unknown mode {mode}")
    return hits.groupBy(ID).agg(F.countDistinct(label).alias("k")).where(F.col("k") == len(wanted)).select(ID)


def combine(parts: list[DataFrame], mode: str = "and") -> DataFrame:
    """Intersection or union of id sets; of none the empty set must come from the caller."""
    if mode == "and":
        return reduce(lambda a, b: a.join(b, ID, "left_semi"), parts)
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def filter_statistics(parts: dict[str, DataFrame]) -> DataFrame:
    """(filter, matches) and the intersection, in one pass over the tagged ids."""
    names = sorted(parts)
    tagged = reduce(lambda a, b: a.unionByName(b), [parts[n].withColumn("filter", F.lit(n)) for n in names])
    single = tagged.groupBy("filter").agg(F.count(F.lit(1)).alias("matches"))
    both = tagged.groupBy(ID).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == len(names)).agg(F.count(F.lit(1)).alias("matches")).select(F.lit("combined").alias("filter"), "matches")
    every = tagged.sparkSession.createDataFrame([(n,) for n in names], "filter string")
    return every.join(single, "filter", "left").select("filter", F.coalesce("matches", F.lit(0).cast("long")).alias("matches")).unionByName(both)


def postings(df: DataFrame, doc: str, dimension: str, levels: str) -> DataFrame:
    """(dim, kind, key, doc_id): a posting for each level's label and one for the whole path, each once."""
    rows = df.where(F.size(F.filter(F.col(levels), lambda x: F.trim(x) != "")) > 0).select(F.col(doc).alias("doc_id"), F.col(dimension).alias("dim"), F.col(levels).alias("h"))
    labels = rows.select("dim", F.lit("label").alias("kind"), F.explode("h").alias("key"), "doc_id").withColumn("key", F.lower(F.trim("key"))).where(F.col("key") != "")
    paths = rows.select("dim", F.lit("path").alias("kind"), C.hierarchy_path("h").alias("key"), "doc_id")
    return labels.unionByName(paths).distinct()


def hierarchical_filter(index: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """Ids that in every dimension have a label equal to, or a path containing, one of its values."""
    hits = []
    for dim, values in sorted(filters.items()):
        test = reduce(lambda a, b: a | b, [((F.col("kind") == "label") & (F.col("key") == v.lower())) | ((F.col("kind") == "path") & F.col("key").contains(v.lower())) for v in values])
        hits.append((F.col("dim") == dim) & test)
    any_hit = reduce(lambda a, b: a | b, hits)
    return index.where(any_hit).groupBy("doc_id").agg(F.countDistinct("dim").alias("dims")).where(F.col("dims") == len(filters)).select("doc_id")


def dimension_statistics(index: DataFrame, limit: int = 50) -> DataFrame:
    """(dim, key, docs): labels of a dimension by their number of documents, the first ones of each dimension."""
    counts = index.where(F.col("kind") == "label").groupBy("dim", "key").agg(F.countDistinct("doc_id").alias("docs"))
    from pyspark.sql import Window as W

    w = W.partitionBy("dim").orderBy(F.desc("docs"), "key")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def with_index_ids(index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings by stored row number (dim, kind, key, doc_idx), and the postings whose document is unknown."""
    return index.join(ids, "doc_id").select("dim", "kind", "key", "doc_idx"), index.join(ids, "doc_id", "left_anti")


def validate_categories(mentions: DataFrame, reference: DataFrame, strict: bool = False) -> DataFrame:
    """mention_id, category, category_confidence, status: exact, corrected (case or blanks, confidence x 0.9) or invalid."""
    allowed = reference.select("dimension_name", F.col("category").alias("__c"), F.lower(F.trim("category")).alias("__k")).distinct()
    rows = mentions.where(F.col("category").isNotNull()).select("mention_id", "dimension_name", "category", "category_confidence").distinct()
    rows = rows.withColumn("__k", F.lower(F.trim("category"))).join(allowed, ["dimension_name", "__k"], "left")
    status = F.when(F.col("__c") == F.col("category"), "exact").when(F.col("__c").isNotNull(), "corrected").otherwise("invalid")
    confidence = F.coalesce("category_confidence", F.lit(1.0))
    out = rows.withColumn("status", status).select("mention_id", F.coalesce("__c", F.lit("unknown")).alias("category"), F.round(F.when(F.col("status") == "exact", confidence).when(F.col("status") == "corrected", confidence * 0.9).otherwise(0.0), 6).alias("category_confidence"), "status")
    return out.where("status <> 'invalid'") if strict else out


def fuzzy_categories(values: DataFrame, allowed: list[tuple[str, str]], least: float = 0.8) -> DataFrame:
    """(dimension_name, category, match, ratio): the allowed name of its dimension most like each distinct value, null below `least`.

    allowed: (dimension, name), a fixed list.  Equal ratios go to the first name in the order of letters; null and
    blank values have no row.  Ratios are of matching blocks, case and outer blanks aside; lengths bound them, so most
    names are never compared.
    """
    names: dict[str, list[str]] = {}
    for dimension, name in sorted(set(allowed)):
        names.setdefault(dimension, []).append(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for dimension, value in zip(b["dimension_name"], b["category"]):
                v, best = value.strip().lower(), (0.0, None)
                for name in names.get(dimension, ()):
                    k = name.strip().lower()
                    bound = 2 * min(len(k), len(v)) / max(1, len(k) + len(v))
                    if bound >= least and bound > best[0] and (r := SequenceMatcher(None, v, k).ratio()) >= least and r > best[0]:
                        best = (r, name)
                found.append(best)
            yield b.assign(match=[x[1] for x in found], ratio=[round(x[0], 6) for x in found])

    rows = values.where(F.trim("category") != "").select("dimension_name", "category").distinct()
    return rows.mapInPandas(run, "dimension_name string, category string, match string, ratio double")


def passing_scores(entities: DataFrame, relevance: float = 0.7, accuracy: float = 0.7, consistency: float = 0.6, with_context: bool = False) -> DataFrame:
    """Entities (relevance, accuracy, consistency) that reach the thresholds; a missing score counts as 1."""
    score = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    ok = (score("relevance") >= relevance) & (score("accuracy") >= accuracy)
    return entities.where(ok & (score("consistency") >= consistency) if with_context else ok)


def of_schema(mentions: DataFrame, dimensions: list[str]) -> DataFrame:
    """Mentions of the given dimensions, names in their normal form, blank texts left out."""
    wanted = [d.strip().lower().replace(" ", "_") for d in dimensions]
    return mentions.where(C.snake("dimension_name").isin(*wanted) & (F.trim("text") != ""))
