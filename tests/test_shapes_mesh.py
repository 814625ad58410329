import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import appearance as A
from plumbline.operators import drawing as D
from plumbline.operators import mesh as M
from plumbline.operators import pixels as P
from plumbline.operators import shapes as S


def rectangles(spark, controls, u=(1.0, 0.0), fit=False):
    rect = spark.createDataFrame([("a", str(i), [[float(x) for x in p] for p in c]) for i, c in enumerate(controls)], "assembly_id string, id string, controls array<array<double>>")
    frames = spark.createDataFrame([("a", [0.0, 0.0], list(u), fit)], "assembly_id string, origin array<double>, u_axis array<double>, fit_orientation boolean")
    return rect, frames


def fitted(quad, u):
    """Centre, half sizes and corners of the least-squares rectangle with axes ``u`` and its normal."""
    q, u = np.array(quad, float), np.array(u)
    axes, signs = np.array([u, [-u[1], u[0]]]), np.array(S.SIGNS)
    half = ((q - q.mean(0)) @ axes.T * signs).sum(0) / 4
    return q.mean(0) + (signs * half) @ axes, 2 * half


def test_fixed_axes_rectangle(spark):
    quad = [[-2, 1], [3, 0], [4, 6], [-1, 4]]
    r = S.rectangle_fit(*rectangles(spark, [quad])).collect()[0]
    corners, size = fitted(quad, (1.0, 0.0))
    assert np.allclose(r.corners, corners) and np.allclose((r.width, r.height), size)
    assert np.allclose(r.errors, np.sqrt(((corners - quad) ** 2).sum(1)))


def test_fitted_orientation(spark):
    u, v = np.array([12, 5]) / 13, np.array([-5, 12]) / 13
    quad = lambda o, w, h: [o, o + w * u, o + w * u + h * v, o + h * v]
    rect, frames = rectangles(spark, [quad(np.array([1., -3.]), 6, 1), quad(np.array([-8., 2.]), 5, 7)], fit=True)
    axes = S.shared_orientation_fit(rect, frames).collect()[0]
    assert (axes.ux, axes.uy) == pytest.approx(tuple(u))
    got = sorted((round(r.width, 9), round(r.height, 9), round(max(r.errors), 9)) for r in S.rectangle_fit(rect, frames).collect())
    assert got == [(5, 7, 0), (6, 1, 0)]


def test_orientation_is_optimal_by_sweep(spark):
    rng = np.random.default_rng(0)
    quads = [np.array([[0, 0], [3, 0], [3, 2], [0, 2]]) + rng.normal(scale=.2, size=(4, 2)) for _ in range(3)]
    rect, frames = rectangles(spark, quads, fit=True)
    best = sum(sum(e * e for e in r.errors) for r in S.rectangle_fit(rect, frames).collect())
    for angle in np.linspace(-.5, .5, 201):
        u = np.array([np.cos(angle), np.sin(angle)])
        v = np.array([-u[1], u[0]])
        total, signs = 0, np.array(S.SIGNS)
        for q in quads:
            c = q.mean(0)
            half = ((q - c) @ np.column_stack([u, v]) * signs).sum(0) / 4
            total += ((c + (signs * half) @ np.array([u, v]) - q) ** 2).sum()
        assert best <= total + 1e-9


def test_rectangle_rules(spark):
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    rect, frames = rectangles(spark, [square, [[0, 0], [1, 1], [1, 0], [0, 1]], [[0, 0], [0, 0], [0, 0], [0, 0]], [[0, 0], [float("inf"), 0], [1, 1], [0, 1]]], u=(1.0, .1))
    found = {(r.rule, r.entity_id) for r in S.check_rectangles(rect, frames).collect()}
    assert {("controls_not_convex", "a/1"), ("controls_not_convex", "a/2"), ("controls_not_finite", "a/3"), ("axis_not_unit", "a")} <= found
    assert ("controls_not_convex", "a/0") not in found
    turned = [[0, 0], [0, 1], [-1, 1], [-1, 0]]  # as strong a vote for v as the square's for u
    rect, frames = rectangles(spark, [square, turned], fit=True)
    assert [r.rule for r in S.check_rectangles(rect, frames).collect()] == ["orientation_unresolved"]


def quad_mesh(spark, *offsets, reverse=()):
    vs, fs, ts = [], [], []
    for i, (dx, dz) in enumerate(offsets):
        vs += [(str(i), j, x + dx, y, dz) for j, (x, y) in enumerate([(0., 0.), (2., 0.), (2., 2.), (0., 2.)])]
        ring, tri = ([3, 2, 1, 0], [[3, 2, 1], [3, 1, 0]]) if i in reverse else ([0, 1, 2, 3], [[0, 1, 2], [0, 2, 3]])
        fs.append((str(i), 0, ring))
        ts += [(str(i), 0, k, t) for k, t in enumerate(tri)]
    return (spark.createDataFrame(vs, "object_id string, vertex int, x double, y double, z double"),
            spark.createDataFrame(fs, "object_id string, face int, vertices array<int>"),
            spark.createDataFrame(ts, "object_id string, face int, triangle int, vertices array<int>"))


def test_overlap_neighbours_and_contacts(spark):
    found, contacts = M.review_meshes(*quad_mesh(spark, (0., 0.), (1., 0.)))
    assert [(r.rule, float(r.detail)) for r in found.collect()] == [("coplanar_overlap", 2.0)] and contacts.count() == 0
    assert M.review_meshes(*quad_mesh(spark, (0., 0.), (2., 0.), (0., .01)))[0].count() == 0
    found, contacts = M.review_meshes(*quad_mesh(spark, (0., 0.), (0., 0.), reverse=(1,)))
    assert found.count() == 0 and [r.area_m2 for r in contacts.collect()] == [pytest.approx(4)]


def test_bad_faces(spark):
    v, f, t = quad_mesh(spark, (0., 0.))
    f = f.unionByName(spark.createDataFrame([("0", 1, [0, 1, 2]), ("0", 2, [0, 0, 1])], f.schema))
    assert {"degenerate_face", "inconsistent_winding_or_nonmanifold"} == {r.rule for r in M.review_meshes(v, f, t)[0].collect()}
    broken = v.withColumn("x", F.when(F.col("vertex") == 2, float("inf")).otherwise(F.col("x")))
    assert [r.rule for r in M.review_meshes(broken, f, t)[0].collect()] == ["nonfinite_vertices"]


def test_clip_areas_against_sampling():
    rng = np.random.default_rng(5)
    a, b = rng.uniform(size=(40, 3, 2)), rng.uniform(size=(40, 3, 2))
    ccw = lambda t: np.where((np.linalg.det(t[:, 1:] - t[:, :1]) < 0)[:, None, None], t[:, ::-1], t)
    a, b = ccw(a), ccw(b)
    g = (np.stack(np.meshgrid(np.arange(400), np.arange(400)), -1).reshape(-1, 2) + .5) / 400
    inside = lambda t: np.all([(t[(i + 1) % 3, 0] - t[i, 0]) * (g[:, 1] - t[i, 1]) - (t[(i + 1) % 3, 1] - t[i, 1]) * (g[:, 0] - t[i, 0]) >= 0 for i in range(3)], axis=0)
    want = [(inside(x) & inside(y)).mean() for x, y in zip(a, b)]
    assert np.allclose(M.clip_areas(a, b), want, atol=5e-3)


def test_triangles_keep_winding(spark):
    make = lambda *t: spark.createDataFrame([("o", *x) for x in t], "object_id string, i int, j int, k int")
    assert M.triangle_multiset_equal(make((0, 1, 2), (2, 3, 0)), make((1, 2, 0), (0, 2, 3))).count() == 0
    assert M.triangle_multiset_equal(make((0, 1, 2)), make((0, 2, 1))).count() == 2


def pieces(spark, *polys):
    return spark.createDataFrame([("g", i, [[float(c) for c in p] for p in poly]) for i, poly in enumerate(polys)], "group_id string, piece_id int, polygon array<array<double>>")


def test_boundary_of_pieces(spark):
    lower, left = [(0, 0, 0), (3, 0, 0), (3, 1, 0), (1, 1, 0), (0, 1, 0)], [(0, 1, 0), (1, 1, 0), (1, 3, 0), (0, 3, 0)]
    boundary, bad = D.shared_edge_match(pieces(spark, lower, left))
    assert boundary.count() == 7 and bad.count() == 0
    square = lambda x: [(x, 0, 0), (x + 1, 0, 0), (x + 1, 1, 0), (x, 1, 0)]
    assert D.shared_edge_match(pieces(spark, square(0), square(3)))[0].count() == 8
    assert D.shared_edge_match(pieces(spark, square(0), square(1)))[0].count() == 6
    assert D.shared_edge_match(pieces(spark, square(0), square(0), square(0)))[1].count() == 4


def test_clip_and_intersect(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 0.0], [2.0, 0.0, 0.0], [2.0, 2.0, 0.0], [0.0, 2.0, 0.0]],)], "p array<array<double>>")
    row = df.select(D.clip_halfspace(F.col("p"), F.lit(0), F.lit(.5), F.lit(True)).alias("c"), D.intersect_plane(F.col("p"), F.lit(1), F.lit(1.0)).alias("i"),
                    D.intersect_plane(F.col("p"), F.lit(1), F.lit(0.0)).alias("e")).collect()[0]
    assert sorted(map(tuple, row.c)) == [(0, 0, 0), (0, 2, 0), (.5, 0, 0), (.5, 2, 0)]
    assert sorted(map(tuple, row.i)) == [(0, 1, 0), (2, 1, 0)] and len(row.e) == 2


def test_projection_visibility_and_tiling(spark):
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate([(0, 0, -2), (1, 1, -2), (0, 0, 1), (0, 0, -3)])], "source_id string, id int, x double, y double, z double")
    cam = spark.createDataFrame([("s", 8, 8, 4.0, 4.0, 4.0, 4.0, [float(i % 5 == 0) for i in range(16)])], "source_id string, width int, height int, fx double, fy double, cx double, cy double, pose array<double>")
    depth = spark.createDataFrame([("s", v, u, 2000, 255) for v in range(4) for u in range(4)], "source_id string, v int, u int, depth_mm int, confidence int")
    out = A.depth_visibility(P.project_to_camera(points, cam, ["source_id"]), depth, ["source_id"], (4, 4), (8, 8)).orderBy("id").collect()
    assert [(r.px_u, r.px_v) for r in out[:2]] == [(4, 4), (6, 2)] and [r.accepted for r in out] == [True, True, False, False]
    mask = spark.createDataFrame([("s", 4, 4)], "source_id string, v int, u int")
    out = A.depth_visibility(P.project_to_camera(points, cam, ["source_id"]), depth, ["source_id"], (4, 4), (8, 8), mask=mask).orderBy("id").collect()
    assert [r.accepted for r in out] == [True, False, False, False]
    tiles = spark.createDataFrame([("m", x, 1.0, 0.0) for x in (.25, 1.75, 2.25)], "m string, x double, y double, z double")
    mapping = spark.createDataFrame([("m", [0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 2.0], 11, 21)], "m string, map_origin array<double>, map_u array<double>, map_v array<double>, size_m array<double>, tile_width int, tile_height int")
    assert all(np.allclose((r.tile_x, r.tile_y), (2.5, 10)) for r in A.repeat_coordinates(tiles, mapping, ["m"]).collect())


def test_sloped_ceiling_and_triangle_texels(spark):
    faces = spark.createDataFrame([([[0.0, 0.0, 1.0], [4.0, 0.0, 3.0], [4.0, 4.0, 3.0], [0.0, 4.0, 1.0]],)], "polygon array<array<double>>")
    points = spark.createDataFrame([(0, 3.0, 2.0, 0.0), (1, 5.0, 2.0, 0.0), (2, 3.0, 2.0, 2.6)], "point_id int, x double, y double, floor_z double")
    assert [r.ceiling_z for r in A.ceiling_above(points, faces).orderBy("point_id").collect()] == [2.5, None, None]
    tri = spark.createDataFrame([("o", 0, [[0.0, 0.0, 0.0], [3.0, 0.0, 0.0], [0.0, 4.0, 0.0]])], "object_id string, face int, polygon array<array<double>>")
    frame = A.face_frame(tri).collect()[0]
    assert (frame.extent_u, frame.extent_v, frame.area) == pytest.approx((5, 2.4, 6))
    texels = A.texel_grid(A.face_frame(tri), 8.0)
    assert texels.where("inside").count() / texels.count() == pytest.approx(.5, abs=.03)
    assert texels.where("inside AND (x < -1e-9 OR y < -1e-9 OR x / 3 + y / 4 > 1 + 1e-9)").count() == 0


def test_nearest_vertices_in_one_search(spark):
    native = [(1, 0.0), (1, 0.0), (1, 1.0), (1, 2.0), (2, 0.0), (3, 5.0), (3, 5.00001), (5, float("nan"))]
    exported = [(1, 0.0), (1, 1.00001), (1, 2.5), (3, 5.0), (4, 7.0)]
    make = lambda rows: spark.createDataFrame([(k, x, 0.0, 0.0) for k, x in rows], "object_id int, x double, y double, z double")
    found = M.nearest_vertex_match(make(native), make(exported))
    got = {r[0]: (r[1] and round(r[1], 9), r[2], r[3]) for r in found.collect()}
    assert got == {1: (1e-5, 1, 1), 2: (None, 1, 0), 3: (1e-5, 0, 0), 4: (None, 0, 1), 5: (None, 1, 0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
