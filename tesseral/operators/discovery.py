"""Discovery of a schema: clusters of questions, dimensions from entities, merging across clusters."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.functions import columns as C



def kmeans(vectors: DataFrame, k: int = 10, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(doc_id, cluster, distance): clusters of vectors (doc_id, embedding) and the distance to their centre."""
    v = vectors.where("embedding is not null").select("doc_id", "embedding", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="features", predictionCol="cluster").fit(v)
    centres = vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    near = model.transform(v).join(F.broadcast(centres), "cluster")  # k rows
    d = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: F.pow(a.cast("double") - b, 2)), F.lit(0.0), lambda s, x: s + x))
    return near.select("doc_id", "cluster", F.round(d, 6).alias("distance"))


def representatives(clustered: DataFrame, most: int = 20) -> DataFrame:
    w = W.partitionBy("cluster").orderBy("distance", "doc_id")
    return clustered.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def cluster_profile(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(C.rows().alias("size"), F.round(F.avg("distance"), 6).alias("mean_distance"), F.max("distance").alias("radius"))


def derived_dimensions(entities: DataFrame, least: float = 0.5) -> DataFrame:
    """(dimension, field, share, position, rank): fields that at least a share of a dimension's entities have, by mean position.

    entities: (entity, dimension, fields map<string,string>), position being the field's place in the entity.
    """
    size = entities.groupBy("dimension").agg(F.countDistinct("entity").alias("entities"))
    f = entities.select("dimension", "entity", F.posexplode(F.map_keys("fields")).alias("at", "field"))
    per = f.groupBy("dimension", "field").agg(F.countDistinct("entity").alias("n"), F.avg("at").alias("position")).join(size, "dimension")
    kept = per.withColumn("share", F.round(F.col("n") / F.col("entities"), 6)).where(F.col("share") >= least)
    w = W.partitionBy("dimension").orderBy("position", "field")
    return kept.select("dimension", "field", "share", F.round("position", 6).alias("position"), F.row_number().over(w).alias("rank"))


FIRST_LEAST, FIRST_MOST, FIRST_SHARE, BATCH = 50, 150, 0.10, 50
DECAY = ((2, 0.3), (5, 0.6))  # up to this batch, the confidence that a new dimension needs; later ones 0.9
LATE = 0.9


def first_batch(size: Column | str) -> Column:
    """Questions of the first batch: a share of the cluster within bounds."""
    return F.greatest(F.lit(FIRST_LEAST), F.least(F.lit(FIRST_MOST), F.floor(C.col(size) * FIRST_SHARE))).cast("int")


def batches(size: Column | str, first: Column | str, batch: int = BATCH) -> Column:
    """Batches of a cluster: the first one, and the rest in equal ones."""
    n, f = C.col(size), C.col(first)
    return F.when(n <= f, 1).otherwise(1 + F.ceil((n - f) / batch)).cast("int")


def decay_threshold(number: Column | str) -> Column:
    """The confidence that a new dimension needs in the batch of a number, counted from 1."""
    out = F.lit(LATE)
    for last, threshold in reversed(DECAY):
        out = F.when(C.col(number) <= last, threshold).otherwise(out)
    return out


def batch_plan(sizes: DataFrame, size: str = "size") -> DataFrame:
    """sizes with first_batch, batches, and the threshold in force in the last batch."""
    return sizes.withColumn("first_batch", first_batch(size)).withColumn("batches", batches(size, "first_batch")).withColumn("threshold", decay_threshold("batches"))


def dimension_first(entities: DataFrame) -> DataFrame:
    """(dimension, text, clusters, mentions) from entity-first rows (cluster, dimension, text): case and blanks folded."""
    e = entities.where(F.trim("text") != "").select(C.snake("dimension").alias("dimension"), F.lower(F.trim("text")).alias("text"), "cluster")
    return e.groupBy("dimension", "text").agg(F.countDistinct("cluster").alias("clusters"), C.rows().alias("mentions"))


def schema_statistics(entities: DataFrame) -> DataFrame:
    """(dimension, entities, mentions, shared): distinct entities of each dimension, and those of more than one cluster; a total under null."""
    d = dimension_first(entities)
    return d.rollup("dimension").agg(C.rows().alias("entities"), F.sum("mentions").alias("mentions"), F.sum((F.col("clusters") > 1).cast("long")).alias("shared"))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def merged_schema(dimensions: DataFrame, least: float = 0.85) -> DataFrame:
    """(name, canonical, clusters) for (cluster, name): names alike are merged, greedily in the order of clusters and names.

    Greedy merging needs one group: it holds the distinct names, not entities.  Counts of characters bound the ratio,
    so only names that can reach `least` are compared.
    """
    names = dimensions.groupBy(F.lower(F.trim("name")).alias("name")).agg(F.min("cluster").alias("first"), F.countDistinct("cluster").alias("clusters"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "name"])
        counts, size = np.zeros((len(pdf), 64), np.uint16), np.array([len(n.lower()) for n in pdf["name"]])
        for i, n in enumerate(pdf["name"]):
            np.add.at(counts[i], [ord(ch) % 64 for ch in n.lower()], 1)
        chosen, at, out = [], np.zeros(len(pdf), np.int64), []
        for i, n in enumerate(pdf["name"]):
            some = at[: len(chosen)]
            some = some[np.minimum(size[some], size[i]) * 2 >= least * (size[some] + size[i]) - 1e-9]
            bound = 2 * np.minimum(counts[some], counts[i]).sum(1, dtype=np.int64) / np.maximum(1, size[some] + size[i])
            alike = next((c for c in pdf["name"].to_numpy()[some[bound >= least - 1e-9]] if ratio(c, n) >= least), None)
            if alike is None:
                at[len(chosen)] = i
                chosen.append(n)
            out.append(alike or n)
        return pdf.assign(canonical=out)[["name", "canonical", "clusters"]]

    return names.groupBy(F.lit(1).alias("all")).applyInPandas(merge, "name string, canonical string, clusters long")


def distinct_entities(entities: DataFrame) -> DataFrame:
    """(dimension, key, text, variants, mentions): texts of a dimension that have the same letters and digits are one entity.

    Aggregation only, so a dimension or an entity of any size is never one task's group; linking of misspelt
    variants is the names operator's work.
    """
    key = F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", ""))
    t = entities.where("text is not null").select("dimension", key.alias("key"), "text").where("key <> ''")
    return t.groupBy("dimension", "key").agg(F.min("text").alias("text"), F.countDistinct("text").alias("variants"), C.rows().alias("mentions"))
