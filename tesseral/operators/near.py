"""Points near other points, and regions containing points (problem 4).

Method: a dual-tree join.  Every task builds a tree over its batch of points and walks it against the tree of the
reference side, dropping node pairs that cannot match, accepting pairs that must match wholesale and refining the
uncertain leaves (kernels in tesseral.functions.geotree).  A reference side of at most BROADCAST_ROWS rows (regions:
vertices), counted before, is sent to all tasks, and the points aren't shuffled at all.  A larger one is cut into cells of the sphere;
both sides of a cell are split into blocks of bounded size, and the same walk runs for each pair of blocks.

Defined results: points with a null, NaN or out-of-range coordinate, or at exactly 0/0, match nothing; reference
rows with such coordinates are left out (0/0 counts there); exact copies of a row count once; ties (equal
distances, shared borders) all match; an empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesseral.functions.geotree import RADIUS_KM, Regions, Tree, inside_pairs, near_pairs, unit
from tesseral.session import materialise
from tesseral.sources.tables import table

BROADCAST_ROWS = 200_000
BLOCK_ROWS = 50_000
BAND = 1.0  # degrees of latitude of a cell


def usable(lat: str, lon: str, null_island: bool = False) -> Column:
    """Whether a coordinate pair can be used; 0/0 stands for a missing one unless null_island."""
    a, o = F.col(lat), F.col(lon)
    ok = a.between(-90, 90) & o.between(-180, 180)
    return F.coalesce(ok if null_island else ok & ~((a == 0) & (o == 0)), F.lit(False))


def _near_broadcast(points: DataFrame, ref: pd.DataFrame, km: float) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast((ref["target_id"].to_numpy(), ref["lat"].to_numpy(float), ref["lon"].to_numpy(float)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lat, lon = sent.value
        tree = Tree(unit(lat, lon))
        for b in batches:
            q, r = near_pairs(b["lat"].to_numpy(), b["lon"].to_numpy(), lat, lon, km, tree)
            yield pd.DataFrame({"point_id": b["point_id"].to_numpy()[q], "target_id": ids[r]})

    return points.mapInPandas(walk, "point_id long, target_id long")


def _cells(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The cell of each point: bands of latitude, each in as many columns as keeps them about square."""
    band = np.clip(np.floor((lat + 90) / BAND), 0, 180 / BAND - 1).astype(np.int64)
    width = _columns(band)
    return band * 1000 + np.minimum(((lon + 180) / 360 * width).astype(np.int64), width - 1)


def _columns(band: np.ndarray) -> np.ndarray:
    widest = np.minimum(np.abs(band * BAND - 90), np.abs((band + 1) * BAND - 90))  # nearest the equator
    return np.maximum(1, (360 / BAND * np.cos(np.radians(widest)))).astype(np.int64)


def _reached(lat: float, lon: float, km: float) -> list[int]:
    """The cells that points within km of a place may be in."""
    deg = np.degrees(km / RADIUS_KM) + 1e-9
    out = []
    for band in range(max(0, int((lat - deg + 90) / BAND)), min(int(180 / BAND) - 1, int((lat + deg + 90) / BAND)) + 1):
        width = int(_columns(np.array([band]))[0])
        top = max(abs(lat) + deg, abs(band * BAND - 90), abs((band + 1) * BAND - 90))
        if top >= 90 or np.sin(np.radians(deg)) >= np.cos(np.radians(top)):
            cols = range(width)
        else:
            d = np.degrees(np.arcsin(np.sin(np.radians(deg)) / np.cos(np.radians(top)))) + 1e-9
            a, b = int(np.floor((lon - d + 180) / 360 * width)), int(np.floor((lon + d + 180) / 360 * width))
            cols = range(width) if b - a >= width else sorted({c % width for c in range(a, b + 1)})
        out += [band * 1000 + c for c in cols]
    return out


def _near_blocks(points: DataFrame, ref: DataFrame, km: float) -> DataFrame:
    """Both sides by cell, each cell's sides in blocks of about BLOCK_ROWS rows, one walk for each pair of blocks."""

    def of_points(batches):
        for b in batches:
            yield b.assign(cell=_cells(b["lat"].to_numpy(), b["lon"].to_numpy()))

    def of_places(batches):
        for b in batches:
            cells = [_reached(a, o, km) for a, o in zip(b["lat"], b["lon"])]
            yield b.loc[b.index.repeat([len(c) for c in cells])].assign(cell=np.concatenate([np.asarray(c, np.int64) for c in cells]) if len(b) else np.zeros(0, np.int64))

    p = points.mapInPandas(of_points, "point_id long, lat double, lon double, cell long")
    r = ref.mapInPandas(of_places, "target_id long, lat double, lon double, cell long")
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))
    # at most one row for each of the sphere's cells (about 42,000): a proven bound for the broadcast
    n = F.broadcast(blocks(p, "ps").join(blocks(r, "rs"), "cell"))
    salt = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    p = p.join(n, "cell").withColumn("a", salt("point_id", "ps")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
    r = r.join(n, "cell").withColumn("b", salt("target_id", "rs")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))

    def walk(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        i, j = near_pairs(x["lat"].to_numpy(), x["lon"].to_numpy(), y["lat"].to_numpy(), y["lon"].to_numpy(), km)
        return pd.DataFrame({"point_id": x["point_id"].to_numpy()[i], "target_id": y["target_id"].to_numpy()[j]})

    keys = ["cell", "a", "b"]
    left, right = p.select("point_id", "lat", "lon", *keys).groupBy(*keys), r.select("target_id", "lat", "lon", *keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(walk, "point_id long, target_id long")


def near_places(points: DataFrame, places: DataFrame, km: float, broadcast_rows: int = BROADCAST_ROWS, null_island: bool = False) -> DataFrame:
    """(point_id, target_id) for each place of places (target_id, lat, lon) at most km from a point (point_id, lat, lon)."""
    points = points.select("point_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(usable("lat", "lon", null_island))
    places = places.select("target_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(usable("lat", "lon", True))
    few = places.limit(broadcast_rows + 1).toPandas()  # the size check: never more than the bound reaches the driver
    pairs = _near_broadcast(points, few, km) if len(few) <= broadcast_rows else _near_blocks(points, places, km)
    return pairs.distinct()


def _regions(ids: list, rings: list) -> Regions:
    return Regions([[np.array([[p["longitude"], p["latitude"]] for p in ring if p["longitude"] is not None and p["latitude"] is not None], float).reshape(-1, 2) for ring in (polygon if polygon is not None else []) if ring is not None] for polygon in rings])


def _points_of(ring_lists) -> list:
    """Rings as plain lists of points, without null rings and points."""
    return [[{"longitude": p["longitude"], "latitude": p["latitude"]} for p in ring if p is not None] for ring in (ring_lists if ring_lists is not None else []) if ring is not None]


def _regions_broadcast(points: DataFrame, chosen: list) -> DataFrame:
    sent = points.sparkSession.sparkContext.broadcast(([r["target_id"] for r in chosen], [_points_of(r["rings"]) for r in chosen]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, found = np.asarray(sent.value[0], np.int64), _regions(*sent.value)
        for b in batches:
            q, r = inside_pairs(b["lat"].to_numpy(), b["lon"].to_numpy(), found)
            yield pd.DataFrame({"point_id": b["point_id"].to_numpy()[q], "target_id": ids[r]})

    return points.mapInPandas(walk, "point_id long, target_id long")


def _box_cells(rings: list) -> np.ndarray:
    """The cells that the box of a region's vertices meets."""
    at = [(p["latitude"], p["longitude"]) for ring in rings for p in ring if p["latitude"] is not None and p["longitude"] is not None]
    if not at:
        return np.zeros(0, np.int64)
    lat, lon = np.array(at).T
    bands = np.clip(np.floor((np.array([lat.min(), lat.max()]) + 90) / BAND), 0, 180 / BAND - 1).astype(np.int64)
    out = []
    for band in range(bands[0], bands[1] + 1):
        width = int(_columns(np.array([band]))[0])
        a, b = (int(np.clip((x + 180) / 360 * width, 0, width - 1)) for x in (lon.min(), lon.max()))
        out.append(band * 1000 + np.arange(a, b + 1))
    return np.concatenate(out)


def _regions_blocks(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions go to the cells their boxes meet; each cell's sides are cut into blocks, by rows and by vertices."""

    def of_points(batches):
        for b in batches:
            yield b.assign(cell=_cells(b["lat"].to_numpy(), b["lon"].to_numpy()))

    def of_regions(batches):
        for b in batches:
            cells = [_box_cells(_points_of(r)) for r in b["rings"]]
            yield pd.DataFrame({"target_id": b["target_id"].to_numpy().repeat([len(c) for c in cells]), "cell": np.concatenate(cells) if cells else np.zeros(0, np.int64)})

    p = points.mapInPandas(of_points, "point_id long, lat double, lon double, cell long")
    # exact copies of a region share an id; rings of different rows under one id all count
    numbered = materialise(regions.withColumn("row", F.xxhash64("target_id", "rings")), "regions")
    r = numbered.select("row", "rings").mapInPandas(lambda bs: of_regions(b.rename(columns={"row": "target_id"}) for b in bs), "target_id long, cell long").withColumnRenamed("target_id", "row").distinct()
    r = r.join(numbered.dropDuplicates(["row"]).select("row", "target_id", "rings", "n"), "row")
    ps = p.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("ps"))
    rs = r.groupBy("cell").agg(F.ceil(F.sum("n") / BROADCAST_ROWS).cast("int").alias("rs"))
    n = F.broadcast(ps.join(rs, "cell"))  # at most one row for each of the sphere's cells (about 42,000)
    salt = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    p = p.join(n, "cell").withColumn("a", salt("point_id", "ps")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
    r = r.join(n, "cell").withColumn("b", salt("row", "rs")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))

    def walk(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"point_id": np.zeros(0, np.int64), "target_id": np.zeros(0, np.int64)})
        i, j = inside_pairs(x["lat"].to_numpy(), x["lon"].to_numpy(), _regions([], [_points_of(g) for g in y["rings"]]))
        return pd.DataFrame({"point_id": x["point_id"].to_numpy()[i], "target_id": y["target_id"].to_numpy()[j]})

    keys = ["cell", "a", "b"]
    left, right = p.select("point_id", "lat", "lon", *keys).groupBy(*keys), r.select("target_id", "rings", *keys).groupBy(*keys)
    return left.cogroup(right).applyInPandas(walk, "point_id long, target_id long")


def containing_regions(points: DataFrame, regions: DataFrame, broadcast_vertices: int = BROADCAST_ROWS) -> DataFrame:
    """(point_id, target_id) for each region (target_id, rings) that contains a point (point_id, lat, lon).

    Rings are array<array<struct<longitude, latitude>>>, closed from last to first vertex; inside means inside an
    odd number of rings.  Regions of at most broadcast_vertices vertices and rings in total, counted before, are sent to all
    tasks; more are joined by cells of the sphere, and no region passes through the driver.
    """
    points = points.select("point_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(usable("lat", "lon"))
    size = F.aggregate(F.transform(F.coalesce("rings", F.array()), lambda x: F.coalesce(F.size(x), F.lit(0))), F.lit(1).cast("int"), lambda a, x: a + x + 1)
    sized = regions.where("target_id is not null").select("target_id", "rings", size.alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pairs = _regions_broadcast(points, sized.collect()) if total <= broadcast_vertices else _regions_blocks(points, sized)
    return pairs.distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions", "mention_id", "dimension_name", "latitude", "longitude").where("dimension_name = 'spatial'")
    points = mentions.selectExpr("mention_id point_id", "latitude lat", "longitude lon")
    places = table(spark, sf_dir, "gazetteer", "place_id", "latitude", "longitude").selectExpr("place_id target_id", "latitude lat", "longitude lon")
    areas = table(spark, sf_dir, "areas", "area_id", "rings").selectExpr("area_id target_id", "rings")
    near, within = near_places(points, places, 10.0), containing_regions(points, areas)
    shape = lambda df, kind: df.select(F.col("point_id").alias("mention_id"), F.lit(kind).alias("kind"), "target_id")
    return shape(near, "near").unionByName(shape(within, "in"))
