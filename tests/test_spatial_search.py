"""Spatial searches against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import hulls
from plumbline.functions.linalg import hull_ring
from plumbline.functions.quantiles import exact_quantiles, order_statistics
from plumbline.operators import appearance as A, checks as C, mesh as M, surfaces as S
from plumbline.session import cut_lineage


@pytest.mark.parametrize("shape", ["disc", "circle", "needle", "grid"])
def test_convex_overlap_against_all_edges(spark, shape):
    rng = np.random.default_rng(4)
    n = 700
    angle = rng.random(n) * 2 * np.pi
    make = {"disc": lambda: rng.normal(size=(n, 2)), "circle": lambda: np.stack([np.cos(angle), np.sin(angle)], 1),
            "needle": lambda: rng.normal(size=(n, 2)) * [1000, 1e-3], "grid": lambda: rng.integers(0, 12, (n, 2)).astype(float)}[shape]
    rings, points = {}, []
    corners = []
    for k in (1, 2, None):
        own = make()
        rings[k] = hull_ring(own)
        corners += [(k, *p) for p in own.tolist()]
        probe = np.concatenate([make() * 1.1, rings[k], rings[k] + [0.0, 5e-10], own[:50]])
        points += [(k, *p) for p in probe.tolist()]
    corners += [(4, 0.0, 0.0)] * 5 + [(5, 0.0, 0.0), (5, 1.0, 1.0), (5, 2.0, 2.0)]  # hulls without area
    points += [(4, 0.0, 0.0), (5, 1.0, 1.0), (6, 0.0, 0.0)]
    schema = "k int, px double, py double"
    second = spark.createDataFrame(corners, schema).repartition(9)
    got = S.convex_overlap(spark.createDataFrame(points, schema).repartition(7), second, "k")
    merged = {r["key"]: np.array(r["ring"]).reshape(-1, 2) for r in hulls.hulls(second.withColumnRenamed("k", "key"), held_corners=4).collect()}  # many partial hulls
    assert all(sorted(map(tuple, merged[k])) == sorted(map(tuple, rings[k])) for k in rings)

    def inside(k, x, y):
        ring = rings.get(k)
        if ring is None:
            return False
        a, b = ring, np.roll(ring, -1, axis=0)
        turn = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        return bool((turn / np.hypot(*(b - a).T) >= -1e-9).all())

    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([p for p in points if inside(*p)], key=key)


def test_hull_needs_no_gathering_task(spark):
    rows = spark.range(0, 200_000, 1, 20).select(F.lit(1).alias("key"), (F.rand(3) - 0.5).alias("px"), (F.rand(4) - 0.5).alias("py"))
    left = hulls.possible_corners(rows).count()
    assert left < 20_000  # most points never leave the JVM
    ring = np.array(hulls.hulls(rows).first()["ring"]).reshape(-1, 2)
    every = rows.toPandas()[["px", "py"]].to_numpy()
    assert sorted(map(tuple, ring)) == sorted(map(tuple, hull_ring(every)))


@pytest.mark.parametrize("values", ["wide", "signed", "ties", "tiny", "special", "steps"])
def test_selection_in_rounds_against_a_sort(spark, values):
    rng = np.random.default_rng(8)
    n = 6000
    data = {"wide": np.exp(rng.normal(size=n) * 120), "signed": rng.normal(size=n) ** 5, "ties": rng.integers(0, 3, n).astype(float), "tiny": rng.random(n) * 1e-310,
            "special": np.r_[rng.normal(size=n - 900), [np.inf] * 300, [-np.inf] * 300, [np.nan] * 200, [0.0] * 50, [-0.0] * 50],
            "steps": 1 + np.arange(n) * 2.0 ** -52}[values]
    rows = spark.createDataFrame([(k, float(v)) for k in (1, None) for v in data], "k int, v double").repartition(6)
    wanted = [0, 1, 299, 300, n // 2, n - 201, n - 200, n - 1]
    ranks = spark.createDataFrame([(k, r) for k in (1, None) for r in wanted], "k int, __rank long")
    got = order_statistics(rows, ranks, ["k"], "v", group_rows=50).collect()
    assert len(got) == 2 * len(wanted)
    ordered = np.sort(data)
    for r in got:
        assert r["__value"] == ordered[r["__rank"]] or np.isnan(r["__value"]) and np.isnan(ordered[r["__rank"]])


def test_one_hot_key_of_many_rows(spark):
    n = 2_000_000
    rows = spark.range(0, n, 1, 16).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v"))
    rows = rows.unionByName(spark.range(5).select(F.lit("cold").alias("k"), F.col("id").cast("double").alias("v")))
    got = {r.k: (r.a, r.b) for r in exact_quantiles(rows, ["k"], "v", {"a": 0.5, "b": 0.95}).collect()}
    assert got["cold"] == (2.0, 3.8) and got["hot"] == pytest.approx(((n - 1) * 0.5, (n - 1) * 0.95), abs=1e-6)


@pytest.mark.parametrize("group_rows", [10_000, 100])
def test_quantiles_up_to_a_bound(spark, group_rows):
    rng = np.random.default_rng(4)
    data = {"many": rng.random(3000), "none": 1 + rng.random(500)}
    rows = spark.createDataFrame([(k, float(v)) for k, d in data.items() for v in d], "k string, v double").repartition(4)
    got = {r.k: (r.a, r.b, r.c) for r in exact_quantiles(rows, ["k"], "v", {"a": 0.5, "b": 0.5, "c": 0.95}, group_rows, upto={"b": 0.3, "c": 0.3}).collect()}
    low = data["many"][data["many"] <= 0.3]
    assert got["many"] == pytest.approx((np.quantile(data["many"], 0.5), np.quantile(low, 0.5), np.quantile(low, 0.95)), abs=1e-12)
    assert got["none"][0] == pytest.approx(np.quantile(data["none"], 0.5), abs=1e-12) and got["none"][1:] == (None, None)


def ring_of(rng, x, y, size, lift, slope):
    xs, ys = [x, x + size, x + size, x], [y, y, y + size * 0.7, y + size * 0.7]
    return [[float(a), float(b), float(lift + slope * (a - x))] for a, b in zip(xs, ys)]


@pytest.mark.parametrize("slab", [0.3, 1.0, 50.0])
def test_ceilings_against_all_faces(spark, slab):
    rng = np.random.default_rng(1)
    faces = [(int(rng.integers(2)), ring_of(rng, *rng.uniform(-20, 20, 2), float(rng.choice([0.4, 3.0, 70.0])), float(rng.uniform(0, 30)), float(rng.choice([0, 0, 0.5, 9.0])))) for _ in range(300)]
    spots = [(int(rng.integers(2)), k, *map(float, rng.uniform(-22, 22, 2)), float(rng.uniform(-1, 25))) for k in range(400)]
    spots += [(0, 1000, 0.0, 0.0, None), (0, 1001, None, 0.0, 0.0)]
    points = spark.createDataFrame(spots, "scene int, point_id int, x double, y double, floor_z double")
    got = A.ceiling_above(points, spark.createDataFrame(faces, "scene int, polygon array<array<double>>"), scene=["scene"], slab_m=slab)
    found = {r.point_id: r.ceiling_z for r in got.collect()}
    assert len(found) == len(spots)
    for scene, k, x, y, floor in spots:
        heights = []
        for s, p in faces:
            if x is None or floor is None or s != scene or not (p[0][0] < x < p[1][0] and p[0][1] < y < p[2][1]):
                continue
            h = p[0][2] + (p[1][2] - p[0][2]) * (x - p[0][0]) / (p[1][0] - p[0][0])
            if h > floor:
                heights.append(h)
        assert found[k] == (pytest.approx(min(heights), abs=1e-9) if heights else None)


@pytest.mark.parametrize("reach", [None, 0.05, 100.0])
def test_supports_against_all_polygons(spark, reach):
    rng = np.random.default_rng(6)
    polygons = []
    for k in range(120):
        u = rng.normal(size=3)
        u /= np.linalg.norm(u)
        w = np.cross(u, rng.normal(size=3))
        w /= np.linalg.norm(w)
        o, a, b = rng.uniform(-5, 5, 3), rng.choice([0.5, 2.0, 12.0]), rng.choice([0.5, 3.0])
        polygons.append((int(k % 2), k, [(o + i * a * u + j * b * w).tolist() for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))], o, u, w, a, b))
    spots = [(int(k % 2), k, *map(float, rng.uniform(-6, 6, 3))) for k in range(300)]
    points = spark.createDataFrame(spots, "g int, id int, x double, y double, z double")
    rings = spark.createDataFrame([p[:3] for p in polygons], "g int, polygon_ordinal int, vertices array<array<double>>")
    got = {r.id: (r.supporting_polygon, r.residual_m) for r in S.nearest_support_polygon(points, rings, ["g"], ["id"], first_reach=reach).collect()}
    assert len(got) == len(spots)
    for g, k, *p in spots:
        best = None
        for pg, ordinal, _, o, u, w, a, b in polygons:
            r = np.array(p) - o
            if pg == g and 0 <= r @ u <= a and 0 <= r @ w <= b:
                d = r @ np.cross(u, w)
                if best is None or abs(d) < abs(best[1]):
                    best = (ordinal, d)
        assert got[k][0] == (best[0] if best else None)
        assert best is None or got[k][1] == pytest.approx(best[1], abs=1e-9)


def test_coplanar_pairs_far_from_the_origin(spark):
    """Large triangles far out share a plane only up to the rounding of their normals; stacked ones must not meet."""
    rng = np.random.default_rng(9)
    u, w = np.array([0.6, 0.0, 0.8]), np.array([0.0, 1.0, 0.0])
    n = np.cross(u, w)
    vertices, triangles, boxes = [], [], []
    for k in range(80):
        lift, size = float(rng.integers(0, 4)) * 0.05, float(rng.choice([0.5, 8.0]))
        s, t = rng.uniform(0, 12, 2)
        tilt = u + n * rng.uniform(-1e-8, 1e-8)
        corners = [np.array([900.0, -700.0, 800.0]) + lift * n + (s + i * size) * tilt + (t + j * size) * w for i, j in ((0, 0), (1, 0), (0, 1))]
        vertices += [(k, i, *map(float, c)) for i, c in enumerate(corners)]
        triangles.append((k, 0, 0, [0, 1, 2]))
        boxes.append((lift, np.min(corners, 0), np.max(corners, 0)))
    v = spark.createDataFrame(vertices, "object_id int, vertex int, x double, y double, z double")
    t = spark.createDataFrame(triangles, "object_id int, face int, triangle int, vertices array<int>")
    got = {tuple(sorted(r)) for r in M.coplanar_overlap_pairs(t, v, cell_m=2.0).select("p_object_id", "q_object_id").collect()}
    want = {(i, j) for i in range(80) for j in range(i) if boxes[i][0] == boxes[j][0] and (boxes[i][1] <= boxes[j][2] + 1e-5).all() and (boxes[j][1] <= boxes[i][2] + 1e-5).all()}
    assert got == {tuple(sorted(x)) for x in want}


def test_rings_of_many_edges(spark):
    n = 50_000
    corner = lambda i: F.array(F.cos(i * (2 * np.pi / n)) * 9, F.sin(i * (2 * np.pi / n)) * 9, F.lit(2.0))
    circle = cut_lineage(spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), corner).alias("vertices")))
    dent = F.transform("vertices", lambda p, i: F.when(i == 777, F.array(p[0] * -1.5, p[1] * -1.5, p[2])).otherwise(p))
    rings = circle.select(F.lit(1).alias("polygon_id"), "vertices").unionByName(circle.select(F.lit(2).alias("polygon_id"), dent.alias("vertices")))
    rings = cut_lineage(rings.unionByName(circle.select(F.lit(1).alias("polygon_id"), "vertices")))  # the same id again is another ring
    got = C.check_polygon_ring(rings).select("rule", "entity_id").collect()
    assert [tuple(r) for r in got] == [("ring_not_simple", "2")]
