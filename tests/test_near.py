import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesseral.functions.geotree import Regions, haversine_km, inside_pairs, near_pairs
from tesseral.operators.near import containing_regions, near_places

PLACES = "target_id long, lat double, lon double"
POINTS = "point_id long, lat double, lon double"


def brute(lat, lon, a, o, km):
    return {(i, j) for i in range(len(lat)) for j in range(len(a)) if haversine_km(lat[i], lon[i], a[j], o[j]) <= km}


@pytest.mark.parametrize("seed", range(6))
def test_dual_tree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 400), rng.integers(1, 200)
    lat, lon = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    a, o = rng.uniform(-90, 90, m), rng.uniform(-180, 180, m)
    lon[: n // 3], o[: m // 3] = 179.99 * rng.choice([-1, 1], n // 3), 179.999 * rng.choice([-1, 1], m // 3)
    lat[n // 2 :] = 89.9
    for km in (10.0, 700.0):
        q, r = near_pairs(lat, lon, a, o, km)
        assert len(q) == len(set(zip(q, r)))
        assert set(zip(q.tolist(), r.tolist())) == brute(lat, lon, a, o, km)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-60, 60), st.floats(-120, 120)), min_size=1, max_size=80), st.integers(3, 9), st.integers(0, 999))
def test_inside_equals_parity(points, corners, seed):
    rng = np.random.default_rng(seed)
    rings = [[np.column_stack([rng.uniform(-120, 120, corners), rng.uniform(-60, 60, corners)]) for _ in range(rng.integers(1, 3))] for _ in range(5)]
    lat, lon = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    q, r = inside_pairs(lat, lon, Regions(rings))
    want = set()
    for i, (y, x) in enumerate(points):
        for k, polygon in enumerate(rings):
            odd = 0
            for ring in polygon:
                for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
                    odd += (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)
            if odd % 2:
                want.add((i, k))
    assert set(zip(q.tolist(), r.tolist())) == want


@pytest.mark.parametrize("bound", [1000, 0])
def test_both_paths_nulls_ties_and_hot_points(spark, bound):
    points = [(1, 10.0, 20.0), (2, None, 20.0), (3, 0.0, 0.0), (4, 95.0, 10.0), (5, float("nan"), 1.0), (6, 0.05, 179.99), (7, 89.999, 10.0)] + [(100 + i, 10.0, 20.0) for i in range(300)] + [(1, 10.0, 20.0)]
    places = [(11, 10.0, 20.0), (12, 10.0, 20.0), (13, 0.05, -179.99), (14, 89.999, -170.0), (15, None, None), (16, 0.0, 0.0)]
    got = {tuple(r) for r in near_places(spark.createDataFrame(points, POINTS), spark.createDataFrame(places, PLACES), 10.0, broadcast_rows=bound).collect()}
    hot = {1, *range(100, 400)}
    assert got == {(p, t) for p in hot for t in (11, 12)} | {(6, 13), (7, 14)}


def test_empty_sides(spark):
    points, places = spark.createDataFrame([(1, 1.0, 1.0)], POINTS), spark.createDataFrame([], PLACES)
    assert near_places(points, places, 10.0).count() == 0
    assert near_places(points.limit(0), spark.createDataFrame([(1, 1.0, 1.0)], PLACES), 10.0).count() == 0


def test_regions_with_holes_and_slices(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rows = [(1, [ring(1.0, 9.0), ring(3.0, 6.0)]), (2, [ring(2.0, 4.0)]), (3, None), (4, [])]
    regions = spark.createDataFrame(rows, "target_id long, rings array<array<struct<longitude:double,latitude:double>>>")
    points = spark.createDataFrame([(1, 2.5, 2.5), (2, 5.0, 5.0), (3, 20.0, 20.0), (4, None, 1.0), (1, 2.5, 2.5)], POINTS)
    for bound in (1000, 4):
        got = {tuple(r) for r in containing_regions(points, regions, broadcast_vertices=bound).collect()}
        assert got == {(1, 1), (1, 2)}
    assert containing_regions(points, regions.limit(0)).count() == 0
